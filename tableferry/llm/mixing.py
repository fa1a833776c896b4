"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableferry.llm.ranking import expanded, numbered

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, most: float, source: str = "source", size: str = "size") -> DataFrame:
    """source, source_size and target of every source, one row each.

    Sources in code-point order, NULL last, take the weights in turn and share
    ``share`` times all sizes; a target stops at ``most`` times its source's
    size and the excess goes to the others by weight.  That ends at one level:
    every target is the smaller of its limit and weight times level, found by
    adding up limits in the order in which sources reach them.  One row per
    source is all that meets in a task.
    """
    totals = sized.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1) % len(weights)
    every = Window.partitionBy(F.lit(0))
    s = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("all", F.sum("source_size").over(every) * F.lit(float(share)))
    filled = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    s = s.withColumn("full", F.coalesce(F.sum("limit").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("limit") / F.col("w"), F.struct("full", "level"))).over(every)["level"]
    return s.select("source", "source_size", F.coalesce(F.least(F.col("limit"), F.col("w") * level), F.col("limit")).alias("target"))


def pareto_mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", seed: int = 7) -> DataFrame:
    """Every row of ``sized`` (key, source, size) with source_size, target, times and taken.

    A document's expected number of copies is its source's target over the
    source's size.  The whole part is certain: every document is taken that
    often.  For the rest each document draws a uniform number from a hash of its
    key, and documents are ranked by the odds of that draw over the odds of
    their inclusion; they are taken in rank order while that brings the
    source nearer to its target, which fixes the size of the sample, and one
    document at most decides the difference.  A source's running sum is built
    from bins of the rank and inside the one bin where the target is met.

    No document is taken more than the next whole number above its expected copies.  A NULL
    size counts as 0; documents of size 0 are taken 0 words.  Equal keys draw
    equally; fully equal rows are ranked as one and then taken one by one.
    The result is the same on every run.
    """
    rows = sized.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("s"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("size"))
    rows = rows.groupBy("k", "s", "size").agg(F.count(F.lit(1)).alias("copies"))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    rows = rows.join(t, F.col("s").eqNullSafe(F.col("_s"))).drop("_s")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(expected + 1e-12)).withColumn("p", F.greatest(expected - F.col("whole"), F.lit(0.0)))
    draw = (F.shiftrightunsigned(F.xxhash64("k", "size", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    odds = F.when(F.col("p") > 1e-12, draw / (1 - draw) * (1 - F.col("p")) / F.col("p"))
    rows = rows.withColumn("rank", odds).withColumn("bin", F.floor(draw * BINS).cast("int"))
    rows = rows.withColumn("mass", F.col("size") * F.col("copies"))
    bins = rows.groupBy("s", "bin").agg(F.sum("mass").alias("in_bin"))
    before = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("s").alias("_s"), F.col("bin").alias("_bin"), F.coalesce(F.sum("in_bin").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("s", "bin").orderBy("rank", "k", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("mass").over(inside), F.lit(0)))
    rows = rows.join(bins, F.col("s").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_bin")))
    left = F.col("p") * F.col("source_size") - (F.col("below") + F.col("ahead"))
    fit = F.when((F.col("p") > 1e-12) & (F.col("size") > 0), F.round(left / F.col("size"))).otherwise(F.lit(0))
    rows = rows.withColumn("chosen", F.least(F.greatest(fit, F.lit(0)), F.col("copies")).cast("long"))
    times = F.col("whole") + (F.col("copy") < F.col("chosen")).cast("long")
    return expanded(rows).select(
        F.col("k").alias(key), F.col("s").alias(source), F.col("size").alias(size), "source_size", "target",
        times.alias("times"), (F.col("size") * times).alias("taken"),
    )


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source and size: the number of words of the whole text, 0 for NULL."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with all their columns.

    Documents of no words are taken as often as their source's whole copies.
    """
    named = docs.select("*", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"))
    sized = named.select("doc_id", "source", F.col("_size").alias("size"))
    taken = pareto_mix(sized, source_targets(sized, weights, share, most))
    # rows equal in these three share their copies: each the same number, one of them the rest
    plan = taken.groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n")).agg(
        F.sum("times").alias("_all"), F.count(F.lit(1)).alias("_rows")
    )
    match = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n"))
    joined = named.join(plan, match)
    each = joined.withColumn("_times", F.floor(F.col("_all") / F.col("_rows")))
    rest = joined.where("_rows > 1 AND _all % _rows > 0").dropDuplicates(["_d", "_s", "_n"]).withColumn("_times", F.col("_all") % F.col("_rows"))
    out = each.unionByName(rest).where("_times > 0")
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*[f"`{c}`" for c in docs.columns])
