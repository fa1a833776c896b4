"""Links inside groups of near copies, counted without meeting all pairs of a group.

A set ``i`` of size ``s`` that differs from a base set by the n-grams ``D`` gets the weight
``w = (num + den) |D| - (den - num) s`` for the threshold ``num / den``.  Two sets differ by
``|D_i| + |D_j| - 2 |D_i & D_j|`` n-grams, so they link exactly when

    w_i + w_j <= 2 (num + den) |D_i & D_j|.

Pairs of weights up to zero link whatever they share: they are counted from a histogram of
weights, and all of them hang on the set of least weight.  The others must share an n-gram
of ``D``.  Sets of equal weight and equal shared n-grams behave alike and are one class, so
that only classes meet, n-gram by n-gram, and the count of n-grams they share is exact.

This holds for any base.  A group forms around one of its sets; n-grams in which more
than half of the group differ from it are then taken into, or out of, the base.
A group whose sets differ from its base in up to ``SPAN`` n-grams, all told, lies in one
task, which finds those n-grams and the shared ones; only wider groups are shuffled by n-gram.
Groups only decide which pairs are counted here: pairs across groups are the caller's.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableferry.llm.arrow import map_batches
from tableferry.session import written

DIFFERENCES = "group long, id long, size long, diff array<long>"
APART = "group long, id long, size long, d long, own array<long>"
HOT = 16  # sets that share an n-gram
GRAMS = 4
PIVOTS = 8
ALONG = 128  # sets that a base is compared with in one block
SPAN = 1 << 20  # differences, of all sets of a group, that one task holds
FULL = 0.875  # of the differing parity bits of unlike sets; beyond it they tell no distance


def block_of(key: str, n):
    return F.pmod(F.xxhash64(key), n).cast("int")


def blocks(n, size: int):
    return F.ceil(n / size).cast("int")


def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of both sides (as ``l_`` and ``r_`` columns) with equal ``on``, a cell for each of ``nl`` times ``nr`` hash blocks of ``rid``."""
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.withColumn("bl", block_of("rid", F.col("nl"))).withColumn("br", all_("nr"))
    right = right.withColumn("br", block_of("rid", F.col("nr"))).withColumn("bl", all_("nl"))
    left, right = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in ("nl", "nr")]) for df, p in ((left, "l"), (right, "r")))
    same = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in (*on, "bl", "br")]
    return left.join(right, same)


def differing(x, y, longs: int):
    """How many bits of two arrays of longs differ."""
    return sum(F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(longs))


def near_groups(heads: DataFrame, spread: DataFrame, sets: DataFrame, parity: int, block: int) -> DataFrame:
    """(rid, group) of the sets that lie in a group of near copies; the group is the id of the set it forms around.

    A set knows up to ``PIVOTS`` sets, those of smallest hash, for each of the ``GRAMS`` most
    frequent n-grams of its prefix that ``HOT`` sets hold (``spread``: gram, n).  It goes to the
    one of smallest hash whose parities are near its own, and on to where that one went.
    """
    chosen = heads.join(spread.where(F.col("n") >= HOT), "gram").groupBy("rid").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "gram")), False), 1, GRAMS).alias("c"))
    chosen = chosen.join(sets.select(F.col("id").alias("rid"), "size", "bits"), "rid").select("rid", "size", "bits", F.explode("c").alias("c"))
    mine = written(chosen.select("rid", "size", "bits", "c.gram", blocks(F.col("c.n"), block).alias("nb")), "hot")
    first = mine.withColumn("h", F.xxhash64("rid")).withColumn("k", F.row_number().over(Window.partitionBy("gram").orderBy("h", "rid")))
    pivots = first.where(F.col("k") <= PIVOTS).groupBy("gram", "nb").agg(F.sort_array(F.collect_list(F.struct("h", "rid", "size", "bits"))).alias("pivots"))
    pivots = pivots.select("gram", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), "pivots")

    def near(p):
        share = 2.0 / parity * differing(F.col("bits"), p["bits"], parity // 64)
        return (share <= FULL) & (-parity / 2 * F.log(1 - share) <= (F.col("size") + p["size"]) / 4)

    placed = mine.withColumn("b", block_of("rid", F.col("nb"))).join(pivots, ["gram", "b"]).select("rid", F.get(F.filter("pivots", near), F.lit(0)).alias("p")).where("p IS NOT NULL")
    placed = written(placed.groupBy("rid").agg(F.min(F.struct("p.h", "p.rid"))["rid"].alias("group")), "placed")
    leaders = placed.select("group").distinct().join(placed.select(F.col("rid").alias("group"), F.col("group").alias("to")), "group")
    leaders = leaders.join(leaders.select(F.col("group").alias("to"), F.col("to").alias("top")), "to").select("group", "top")
    placed = placed.join(leaders, "group").select("rid", F.col("top").alias("group"))
    many = placed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    return placed.join(many, "group").select("rid", "group")


def differences(batches):
    """Of rows of :func:`by_group`, the n-grams that only one of a set and the base of its group holds."""
    base = None
    for b in batches:
        values, at = np.asarray(b.column("grams").values).view(np.uint64), np.asarray(b.column("grams").offsets)
        keep, made = [], []
        for i, (lead, own) in enumerate(zip(b.column("lead").to_pylist(), b.column("own").to_pylist())):
            grams = values[at[i] : at[i + 1]]
            if lead:
                base = grams.copy()
            if own:
                keep.append(i)
                made.append(np.setxor1d(grams, base, assume_unique=True))
        kept = pa.array(keep, pa.int64())
        sizes = pa.array(np.diff(at)[keep].astype(np.int64))
        offsets = pa.array(np.cumsum([0] + [len(x) for x in made]).astype(np.int32))
        diff = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("group").take(kept), b.column("id").take(kept), sizes, diff], ["group", "id", "size", "diff"])


def by_group(groups: DataFrame, whole: DataFrame) -> DataFrame:
    """The whole sets by group; the base comes once to each block of its group, ahead of the others."""
    sized = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("rid") == F.col("group")).alias("led")).withColumn("nb", blocks(F.col("n"), ALONG))
    others = groups.where("rid != group").join(sized, "group")
    others = others.select("group", block_of("rid", F.col("nb")).alias("b"), F.col("rid").alias("id"), F.lit(False).alias("lead"), F.lit(True).alias("own"))
    leads = sized.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    leads = leads.select("group", "b", F.col("group").alias("id"), F.lit(True).alias("lead"), (F.col("led") & (F.col("b") == block_of("group", F.col("nb")))).alias("own"))
    return others.union(leads).join(whole, "id").repartition("group", "b").sortWithinPartitions("group", "b", F.col("lead").desc())


def _apart(group: pa.Table) -> pa.RecordBatch:
    """Of one whole group, :func:`apart`."""
    diff = group.column("diff").combine_chunks()
    at = np.asarray(diff.offsets)
    n = len(group)
    grams, which, counts = np.unique(np.asarray(diff.values)[at[0] : at[-1]], return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), np.diff(at))
    flip = np.flatnonzero(2 * counts > n)
    turned = np.isin(which, flip)
    lacks = np.ones((n, len(flip)), bool)
    lacks[row[turned], np.searchsorted(flip, which[turned])] = False
    rows, flips = np.nonzero(lacks)
    rows, held = np.concatenate([row[~turned], rows]), np.concatenate([which[~turned], flip[flips]])
    shared = np.bincount(held, minlength=len(grams))[held] > 1
    order = np.lexsort((held[shared], rows[shared]))
    offsets = np.cumsum([0, *np.bincount(rows[shared], minlength=n)]).astype(np.int32)
    own = pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams[held[shared][order]]))
    d = pa.array(np.bincount(rows, minlength=n).astype(np.int64))
    return pa.RecordBatch.from_arrays([*(group.column(c).combine_chunks() for c in ("group", "id", "size")), d, own], ["group", "id", "size", "d", "own"])


def _groups_apart(batches):
    held = []
    for b in batches:
        groups = np.asarray(b.column("group"))
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1), len(groups)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and held[-1].column("group")[0].as_py() != groups[i]:
                yield _apart(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield _apart(pa.Table.from_batches(held))


def each_gram(diffs: DataFrame, *more: str) -> DataFrame:
    return diffs.select("group", *more, F.explode("diff").alias("e"))


def apart(diffs: DataFrame) -> DataFrame:
    """(group, id, size, d, own): how many n-grams a set differs in from the base that most of its group agree on, and those that another set of the group shares."""
    members = written(diffs.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("diff")).alias("span")), "members")
    small = diffs.join(members.where(F.col("span") <= SPAN).select("group"), "group").select(diffs.columns)
    small = map_batches(small.repartition("group").sortWithinPartitions("group"), _groups_apart, APART)

    members = members.where(F.col("span") > SPAN)
    wide = diffs.join(members.select("group"), "group").select(diffs.columns)
    often = each_gram(wide).groupBy("group", "e").agg(F.count(F.lit(1)).alias("c"))
    flips = often.join(members, "group").where("2 * c > n").groupBy("group").agg(F.collect_list("e").alias("flip"))
    moved = wide.join(flips, "group", "left").withColumn("flip", F.coalesce("flip", F.array().cast("array<long>")))
    moved = moved.withColumn("diff", F.concat(F.array_except("diff", "flip"), F.array_except("flip", "diff")))
    moved = written(moved.select(diffs.columns), "moved")
    each = each_gram(moved, "id")
    shared = each.groupBy("group", "e").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("group", "e")
    own = each.join(shared, ["group", "e"]).groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("own"))
    wide = moved.join(own, "id", "left").select("group", "id", "size", F.size("diff").cast("long").alias("d"), F.coalesce("own", F.array().cast("array<long>")).alias("own"))
    return small.union(wide)


def group_links(diffs: DataFrame, sets: DataFrame, t: Fraction, block: int) -> tuple[DataFrame, DataFrame]:
    """(id, p): the copies of the other sets of its group that a set links with; (a, b): links that join the same sets as all of them."""
    up, down = t.numerator + t.denominator, t.denominator - t.numerator
    nodes = apart(diffs).join(sets.select("id", "copies"), "id")
    nodes = written(nodes.select("group", "id", "copies", (up * F.col("d") - down * F.col("size")).alias("w"), "own"), "nodes")
    alike = ["group", "w", "own"]
    classes = nodes.groupBy(*alike).agg(F.min("id").alias("rid"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("sets"))
    classes = written(classes.withColumn("k", F.size("own")), "classes")

    # weights up to zero: at -w, the running sum over w of the copies
    weights = classes.groupBy("group", "w").agg(F.sum("all").alias("n"))
    points = weights.select("group", F.col("w").alias("at"), "n", F.lit(None).cast("long").alias("w"))
    points = points.union(weights.select("group", -F.col("w"), F.lit(0).cast("long"), "w"))
    upto = Window.partitionBy("group").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sure = points.withColumn("sure", F.sum("n").over(upto)).where("w IS NOT NULL").select("group", "w", "sure")
    hubs = classes.groupBy("group").agg(F.min(F.struct("w", "rid")).alias("h")).select("group", F.col("h.w").alias("hub_w"), F.col("h.rid").alias("hub"))

    # the others: classes that share enough
    each = classes.select("group", "rid", "w", "k", F.explode("own").alias("e"))
    cut = each.groupBy("group", "e").agg(blocks(F.count(F.lit(1)), block).alias("nl"), F.count(F.lit(1)).alias("c")).where("c > 1").select("group", "e", "nl", F.col("nl").alias("nr"))
    each = each.join(cut, ["group", "e"])
    total = F.col("l_w") + F.col("r_w")
    met = meet(each, each, ["group", "e"]).where((F.col("l_rid") < F.col("r_rid")) & (total > 0) & (total <= 2 * up * F.least("l_k", "r_k")))
    met = met.groupBy("l_rid", "r_rid", total.alias("total")).agg(F.count(F.lit(1)).alias("c")).where(F.col("total") <= 2 * up * F.col("c"))
    met = written(met.select(F.col("l_rid").alias("x"), F.col("r_rid").alias("y")), "classlinks")
    ends = met.union(met.select("y", "x"))
    other = ends.join(classes.select(F.col("rid").alias("y"), "all"), "y").groupBy(F.col("x").alias("rid")).agg(F.sum("all").alias("other"))

    within = (F.col("w") > 0) & (F.col("w") <= up * F.col("k"))
    told = classes.join(sure, ["group", "w"]).join(hubs, "group").join(other, "rid", "left")
    told = told.withColumn("within", within).select(
        "rid",
        (F.col("sure") + F.coalesce("other", F.lit(0)) + F.when(F.col("within"), F.col("all")).otherwise(0)).alias("p"),
        ((F.col("w") <= 0) | F.col("within")).alias("itself"),
        F.when(F.col("w") + F.col("hub_w") <= 0, F.col("hub")).alias("hub"),
        ((F.col("within") & (F.col("sets") > 1)) | F.col("other").isNotNull()).alias("tied"),
    )
    named = nodes.join(classes.select(*alike, "rid"), alike).select("id", "copies", "rid").join(told, "rid")
    named = written(named, "named")
    degrees = named.select("id", (F.col("p") - F.when(F.col("itself"), F.col("copies")).otherwise(0)).alias("p"))
    edges = named.where("hub != id").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    edges = edges.union(named.where("tied AND rid != id").select("id", "rid")).union(met)
    return degrees, edges
