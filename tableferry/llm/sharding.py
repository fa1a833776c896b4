"""Sharding by rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableferry.llm.ranking import expanded, numbered


def _cost(key: Sequence[Column], shard: Column, weight: Column) -> Column:
    """Exponential waiting time of a shard for a key: the smallest one owns the key."""
    draw = (F.shiftrightunsigned(F.xxhash64(*key, shard.cast("int")), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return F.try_divide(-F.log(draw), weight)


def _best(key: Sequence[Column], weights: Sequence[float]) -> Column:
    offers = F.transform(F.array(*[F.lit(float(w)) for w in weights]), lambda w, i: F.struct(_cost(key, i, w).alias("cost"), i.cast("int").alias("shard")))
    return F.array_min(F.filter(offers, lambda o: o["cost"].isNotNull()))


def assign_shards(df: DataFrame, key: Sequence[str], weights: Sequence[float], shard: str = "shard", grown: str | None = None, new_weight: float = 1.0) -> DataFrame:
    """Add the shard (0 to ``len(weights) - 1``) that owns each row.

    Each shard draws a waiting time from a hash of the key and its own number,
    divided by its weight, and the shortest time wins, so a shard gets keys in
    proportion to its weight and a further shard takes keys only into itself.
    ``grown`` names a column for the owner after one more shard of
    ``new_weight`` is added.  A projection: no shuffle, no state.

    Equal keys share a shard, NULL being a key like any other.  A shard of
    weight 0 owns nothing.  Every other column is passed through untouched.
    """
    if not weights or min(weights) < 0 or max(weights) == 0:
        raise ValueError("weights must be non-negative, with at least one above zero")
    cols = [F.col(f"`{c}`") for c in key]
    out = df.withColumn("_owner", _best(cols, weights))
    extra = []
    if grown:
        added = len(weights)
        cost = _cost(cols, F.lit(added), F.lit(float(new_weight)))
        extra = [F.when(cost < F.col("_owner.cost"), F.lit(added)).otherwise(F.col("_owner.shard")).alias(grown)]
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in (shard, grown)], F.col("_owner.shard").alias(shard), *extra)


def shard_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard gapless from 0, in blocks, so no shard meets in one task."""
    rows = expanded(numbered(df, [shard], list(order)))
    return rows.withColumn(slot, F.col("before") + F.col("copy")).drop("before", "copy", "copies")


def write_shards(df: DataFrame, path: str, key: Sequence[str], weights: Sequence[float]) -> None:
    """Write one folder per shard under ``path``; written from the scan, without a shuffle."""
    assign_shards(df, key, weights).write.partitionBy("shard").mode("overwrite").parquet(path)


def record_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8) and text_crc32 of every row; a NULL text has no bytes."""
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select("doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
