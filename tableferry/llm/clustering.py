"""Centroid clustering of integer vectors by a bisector tournament.

For two centroids ``a < b`` the point ``x`` lies on ``a``'s side of their
bisector when ``2 x.(c_b - c_a) <= |c_b|^2 - |c_a|^2``: an integer normal and an
integer threshold per pair, computed once per round from the small centroid
table.  A vector meets the centroids in number order; the current winner
faces the next centroid in one sign test and a zero keeps the smaller number,
so ``k - 1`` linear tests pick the nearest centroid (ties: smaller number)
and only the winner's squared distance is computed, exactly.

The vectors are read from a table written once in the shared folder; a round
is a scan with an Arrow function and an aggregate of component sums (partial
aggregation before the shuffle, so a cluster holding a third of all rows
costs no single task more than its share).  Only the ``k`` centroids reach the
driver, and ``k`` is a parameter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableferry.llm.arrow import map_batches
from tableferry.session import fresh_path

LIMIT = 1 << 24


def integer_vectors(df: DataFrame, vec: str = "embedding", key: str = "vec_id", dims: int = 64, scale: int = 256) -> DataFrame:
    """(``vec_id``, ``v`` array<long>) of the usable vectors: floor(scale * x), x as double.

    A vector takes part when it has exactly ``dims`` components, none NULL or
    non-finite, and every integer component lies within +-2^24 (so that every
    squared distance and component sum stays exact in 64 bits); all other rows,
    NULL vectors included, are left out.  NULL ``vec_id`` values are kept.
    Further input columns are dropped.
    """
    x = F.col(vec)
    usable = (
        x.isNotNull()
        & (F.size(x) == dims)
        & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    )
    ints = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    out = df.where(usable).select(F.col(key).cast("long").alias("vec_id"), F.when(usable, ints).alias("v"))
    return out.where(F.forall("v", lambda e: F.abs(e) <= LIMIT))


def first_centroids(vectors: DataFrame, k: int, seed: int = 2) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>``, in hash order (then vec_id, NULL last, then components).

    A top-k of a sort with per-partition limits: no task sees more than its
    partition and ``k`` rows.  Fewer usable vectors give fewer centroids.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    firsts = vectors.select(h.alias("h"), "vec_id", "v").orderBy("h", F.col("vec_id").asc_nulls_last(), "v").limit(k)
    return [list(r["v"]) for r in firsts.collect()]


def tournament(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(winner, squared distance) of every row of ``x`` (int64) against ``centroids`` by k - 1 sign tests."""
    k = len(centroids)
    sq = (centroids * centroids).sum(axis=1)
    win = np.zeros(len(x), dtype=np.int64)
    for c in range(1, k):
        normal = centroids[c][None, :] - centroids[win]
        threshold = sq[c] - sq[win]
        side = 2 * (x * normal).sum(axis=1) - threshold
        win = np.where(side > 0, c, win)
    diff = x - centroids[win]
    return win, (diff * diff).sum(axis=1)


def _assigner(centroids: list[list[int]]):
    table = np.array(centroids, dtype=np.int64)

    def run(batches):
        for b in batches:
            flat = b.column("v").combine_chunks() if isinstance(b, pa.Table) else b.column("v")
            x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(b), -1) if len(b) else np.zeros((0, table.shape[1]), np.int64)
            win, dist = tournament(x, table) if len(table) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), pa.array(win.astype(np.int32), pa.int32()), pa.array(dist, pa.int64())],
                ["vec_id", "v", "cluster", "distance"],
            )

    return run


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vectors`` with ``cluster`` int and ``distance`` long (squared, exact)."""
    return map_batches(vectors.select("vec_id", "v"), _assigner(centroids), "vec_id long, v array<long>, cluster int, distance long")


def updated(assigned: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every non-empty centroid replaced by floor(component sum / count); empty ones stay."""
    dims = len(centroids[0])
    sums = [F.sum(F.col("v")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    stats = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums)
    floors = [F.expr(f"CASE WHEN s{i} >= 0 THEN s{i} div n ELSE -((n - 1 - s{i}) div n) END").cast("long").alias(f"m{i}") for i in range(dims)]
    means = stats.select("cluster", *floors)
    out = [list(c) for c in centroids]
    for r in means.collect():
        out[r["cluster"]] = [int(r[f"m{i}"]) for i in range(dims)]
    return out


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, vec: str = "embedding", key: str = "vec_id", dims: int = 64, scale: int = 256) -> DataFrame:
    """Per usable vector: vec_id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string.

    Centroids start as :func:`first_centroids`; each of ``rounds`` rounds
    assigns every vector by :func:`tournament` and moves every non-empty
    centroid to the exact floor of its members' mean; then vectors are
    assigned once more.  ``centroid_sha256`` is the lowercase hex sha256 of
    the final centroid's components as decimal integers joined by ``,``.
    Repeated rows are clustered each on its own; a table without usable
    vectors gives no rows; input columns other than the key and the vector do
    not reach the result, so their names cannot clash.  Inertia sums that
    leave the long range are NULL.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "vectors")
    integer_vectors(df, vec, key, dims, scale).write.parquet(path)
    vectors = spark.read.parquet(path)
    centroids = first_centroids(vectors, k)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = updated(assign(vectors, centroids), centroids)
    path = fresh_path(spark, "assigned")
    assign(vectors, centroids).select("vec_id", "cluster", "distance").write.parquet(path)
    final = spark.read.parquet(path)
    per = {r["cluster"]: int(r["ci"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("ci")).collect()}
    total = sum(per.values())
    fits = lambda n: n if n < 1 << 63 else None
    facts = spark.createDataFrame(
        [(i, fits(per[i]), fits(total), hashlib.sha256(",".join(str(x) for x in c).encode()).hexdigest()) for i, c in enumerate(centroids) if i in per],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
