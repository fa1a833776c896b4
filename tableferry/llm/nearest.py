"""Exact top-k by inner product with a pivot table: bounds first, exact scores only where they can still matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableferry.llm.arrow import map_batches
from tableferry.session import ensure_checkpoints

PIVOTS = 32
SAMPLE = 1024
ROWS = 4096  # vectors in a block
LANES = 1024  # queries in a block
SAFE = 2**53
BLOCK = "block long, n long, ids binary, vectors binary, bounds binary"


def scaled(df: DataFrame, vec_id: str, vector: str, scale: int = 1024) -> DataFrame:
    """vec_id and v: floor(scale * x) of every component as a double; vectors with NULL or non-finite parts are left out.

    A NULL id takes no part either, and neither does an empty vector.
    """
    v = F.col(f"`{vector}`")
    fine = F.col(f"`{vec_id}`").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    usable = df.where(fine & ~F.exists(v, bad))
    return usable.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * float(scale)).cast("double")).alias("v")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    flat = np.asarray(column.flatten())
    size = np.asarray(pc.list_value_length(column))
    at = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(len(flat)) - at
    out[np.repeat(np.arange(len(column)), size), place] = flat
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from one another: each next one is the row farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [int(np.linalg.norm(sample - sample.mean(0), axis=1).argmax())]
    near = np.linalg.norm(sample - sample[chosen[0]], axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _lifted(m: np.ndarray, norm: float) -> np.ndarray:
    """One more component that brings every row to the same length, so that inner products order like distances."""
    rest = np.maximum(norm * norm - np.einsum("ij,ij->i", m, m), 0)
    return np.column_stack([m, np.sqrt(rest)])


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (m * m).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * m @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def top_k(df: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest integer inner products of every query, ties to the smaller vec_id.

    ``queries`` says which rows of ``df`` are queries; all rows but those of the
    query's own id are candidates, repeated rows as often as they occur.  A query id
    that occurs with several vectors asks with the smallest.  Shorter
    vectors count as if filled up with zeros.

    Rows are gathered into blocks that carry their distances to the pivots.
    Every block of candidates meets every block of queries; there the largest
    difference between the two pivot distances bounds each distance from below, hence
    each score from above, and candidates are scored in the order of their
    bounds until the next bound is below the k-th best score.  The pivots come
    from a sample of at most 1,024 rows; what they are changes the work, not the result.
    Raises where scores could leave the exact range of doubles.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    rows = scaled(df, vec_id, vector, scale)
    facts = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), F.count(F.lit(1))).first()
    width, most, total = int(facts[0] or 1), float(facts[1] or 0.0), int(facts[2])
    if most >= SAFE:
        raise ValueError("the vectors are too large for exact scores")
    norm = float(np.sqrt(most)) + 1.0
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    points = choose_pivots(_lifted(_matrix(picked, width), norm), pivots)

    def blocks_of(lift: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.asarray(batch.column("vec_id")).astype("<i8")
                m = _matrix(batch.column("v"), width)
                far = _distances(_lifted(m, norm) if lift else np.column_stack([m, np.zeros(len(m))]), points)
                size = ROWS if lift else LANES
                for at in range(0, len(ids), size):
                    part = slice(at, at + size)
                    values = [int(ids[at]), len(ids[part]), ids[part].tobytes(), m[part].astype("<f8").tobytes(), far[part].astype("<f8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names=["block", "n", "ids", "vectors", "bounds"])

        return run

    def gathered(data: DataFrame, count: int, lift: bool) -> DataFrame:
        parts = max(1, -(-count // (ROWS if lift else LANES)))
        return map_batches(data.repartition(parts), blocks_of(lift), BLOCK).withColumn("number", F.spark_partition_id())

    asked = df.where(queries)
    asked = scaled(asked, vec_id, vector, scale).groupBy("vec_id").agg(F.min("v").alias("v")).checkpoint()
    count = asked.count()
    lanes = max(1, -(-count // LANES))
    left = gathered(asked, count, False).withColumn("lane", F.pmod(F.xxhash64("block", "number"), F.lit(lanes)))
    right = gathered(rows, total, True).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    met = right.join(left.select("lane", *[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "vectors", "bounds")]), "lane")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = _search_block(row, width, k, norm)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["query_id", "vec_id", "score"])

    needed = ["n", "ids", "vectors", "bounds", "q_n", "q_ids", "q_vectors", "q_bounds"]
    found = map_batches(met.select(*needed).repartition(max(1, lanes * max(1, -(-total // ROWS)))), search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_block(row: dict, width: int, k: int, norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
    m, q = (np.frombuffer(row[c], "<f8").reshape(-1, width) for c in ("vectors", "q_vectors"))
    far, q_far = (np.frombuffer(row[c], "<f8").reshape(len(x), -1) for c, x in (("bounds", m), ("q_bounds", q)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    squares = np.einsum("ij,ij->i", q, q)
    for i in range(len(q)):
        apart = np.abs(far - q_far[i]).max(1) if far.shape[1] else np.zeros(len(m))
        highest = (squares[i] + norm * norm - np.maximum(apart - 1e-6 * norm, 0) ** 2) / 2 + 1e-6 * norm * norm + 1
        highest[ids == q_ids[i]] = -np.inf
        order = np.argsort(-highest, kind="stable")
        order = order[np.isfinite(highest[order])]
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 64
        while at < len(order):
            if len(best) >= k and highest[order[at]] < best[k - 1]:
                break
            some = order[at : at + step]
            at, step = at + step, min(4 * step, 4096)
            best_ids, best = np.concatenate([best_ids, ids[some]]), np.concatenate([best, m[some] @ q[i]])
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
        found.append((np.full(len(best), q_ids[i]), best_ids, best.astype(np.int64)))
    if not found:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return tuple(np.concatenate(x) for x in zip(*found))
