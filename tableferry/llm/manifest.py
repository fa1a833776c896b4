"""Merkle manifest of a table: a tree of SHA-256 digests whose parents keep copied hash states.

Every row becomes a leaf digest; per group (``source``) the leaves, ordered by
key, are folded three at a time into parents until one node, the group's
subroot, remains; the subroots, ordered by group, fold the same way into the
root.  A parent hashes its children's digests as hex text, and a 64-character
digest is exactly one SHA-256 block, so a parent keeps, for each child slot,
the 32-byte hash state before that child (the midstate).  Checking a changed
row never hashes a parent's left children again: it resumes the state of its
slot, feeds the replacement and the right siblings only, and pads.

The trees are built level by level with aggregates of at most three children;
leaves are numbered within their group after one range sort, so a group with
a third of all rows spreads over many tasks.  The per-row walk to the root is
one join a level with the parent table, each level written to the shared
folder.  Hashing of blocks runs in NumPy over Arrow batches, many rows at a
time; the leaves themselves are hashed by Spark's ``sha2``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableferry.llm.arrow import extended, map_batches
from tableferry.session import fresh_path

FAN = 3


def _primes(n: int) -> list[int]:
    out, k = [], 2
    while len(out) < n:
        if all(k % p for p in out if p * p <= k):
            out.append(k)
        k += 1
    return out


def _root(value: int, k: int) -> int:
    """floor(value ** (1/k)) for integers."""
    lo, hi = 0, 1 << (value.bit_length() // k + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if mid**k <= value:
            lo = mid
        else:
            hi = mid - 1
    return lo


# SHA-256's constants by their rule: first 32 fraction bits of the square roots
# of the first 8 primes (start state) and of the cube roots of the first 64 (rounds).
START = np.array([_root(p << 64, 2) & 0xFFFFFFFF for p in _primes(8)], dtype=np.uint32)
ROUNDS = np.array([_root(p << 96, 3) & 0xFFFFFFFF for p in _primes(64)], dtype=np.uint32)


def _rotr(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 compression of one 64-byte block per row: state (N, 8) and block (N, 16) of uint32."""
    n = len(state)
    w = np.empty((n, 64), dtype=np.uint32)
    w[:, :16] = block
    for t in range(16, 64):
        a, b = w[:, t - 15], w[:, t - 2]
        w[:, t] = w[:, t - 16] + (_rotr(a, 7) ^ _rotr(a, 18) ^ (a >> np.uint32(3))) + w[:, t - 7] + (_rotr(b, 17) ^ _rotr(b, 19) ^ (b >> np.uint32(10)))
    a, b, c, d, e, f, g, h = (state[:, i].copy() for i in range(8))
    for t in range(64):
        t1 = h + (_rotr(e, 6) ^ _rotr(e, 11) ^ _rotr(e, 25)) + ((e & f) ^ (~e & g)) + ROUNDS[t] + w[:, t]
        t2 = (_rotr(a, 2) ^ _rotr(a, 13) ^ _rotr(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = t1 + t2, a, b, c, d + t1, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def finish(state: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The digest of a message of ``length`` bytes, a multiple of 64, whose blocks gave ``state``."""
    pad = np.zeros((len(state), 16), dtype=np.uint32)
    pad[:, 0] = 0x80000000
    bits = length.astype(np.uint64) * np.uint64(8)
    pad[:, 14] = (bits >> np.uint64(32)).astype(np.uint32)
    pad[:, 15] = (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return compress(state, pad)


def blocks(digests: list[str]) -> np.ndarray:
    """Hex digests as text, one 64-byte block each."""
    raw = "".join(digests).encode("ascii")
    return np.frombuffer(raw, dtype=">u4").astype(np.uint32).reshape(len(digests), 16)


def states(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=">u4").astype(np.uint32).reshape(len(raw), 8)


def as_bytes(state: np.ndarray) -> list[bytes]:
    flat = state.astype(">u4").tobytes()
    return [flat[i * 32 : (i + 1) * 32] for i in range(len(state))]


def as_hex(state: np.ndarray) -> list[str]:
    return [s.hex() for s in as_bytes(state)]


def _parents(batches):
    """(grp, level, idx, kids) to the parent digest and the state before every child."""
    for b in batches:
        kids = b.column("kids").to_pylist()
        n = len(kids)
        width = np.array([len(k) for k in kids])
        state = np.tile(START, (n, 1))
        mids = [[] for _ in range(n)]
        for slot in range(FAN):
            has = np.nonzero(width > slot)[0]
            if not len(has):
                break
            for i, raw in zip(has, as_bytes(state[has])):
                mids[i].append(raw)
            state[has] = compress(state[has], blocks([kids[i][slot] for i in has]))
        digest = as_hex(finish(state, width * 64)) if n else []
        yield pa.RecordBatch.from_arrays(
            [b.column("grp"), b.column("level"), b.column("idx"), pa.array(digest, pa.string()), b.column("n"), b.column("kids"), pa.array(mids, pa.list_(pa.binary()))],
            ["grp", "level", "idx", "h", "n", "kids", "mids"],
        )


NODES = "grp string, level int, idx long, h string, n long, kids array<string>, mids array<binary>"


def tree(spark, leaves: DataFrame) -> list[DataFrame]:
    """Level tables of the trees over ``leaves`` (grp, idx, h, n: nodes of the group); level 0 is the leaves.

    Runs of ``FAN`` consecutive nodes (the last run may be shorter, even one)
    become parents while a group has more than one node.
    """
    level = leaves.select("grp", F.lit(0).alias("level"), "idx", "h", "n", F.lit(None).cast("array<string>").alias("kids"), F.lit(None).cast("array<binary>").alias("mids"))
    out = [level]
    depth = 0
    while level.where("n > 1").limit(1).count():
        depth += 1
        grouped = (
            level.where("n > 1")
            .groupBy("grp", F.floor(F.col("idx") / FAN).cast("long").alias("idx"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), F.col("h").alias("h")))).alias("k"), F.first("n").alias("m"))
            .select("grp", F.lit(depth).alias("level"), "idx", F.col("k.h").alias("kids"), F.ceil(F.col("m") / FAN).cast("long").alias("n"))
        )
        path = fresh_path(spark, f"merkle-{depth}")
        map_batches(grouped, _parents, NODES).write.parquet(path)
        level = spark.read.parquet(path)
        out.append(level)
    return out


def _positions(batches):
    """Within a sorted partition, the place of each row in its group."""
    last, count = None, 0
    for b in batches:
        grp = b.column("grp").to_pylist()
        local = []
        for g in grp:
            if g != last:
                last, count = g, 0
            local.append(count)
            count += 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64())], [*b.schema.names, "_local"])


def ranked(df: DataFrame, order: list) -> DataFrame:
    """``df`` with ``idx`` (place in its ``grp`` by ``order``, from 0) and ``n`` (rows of the group).

    One range sort; rows are counted per task and group, and the counts (one
    row per task and group) give each task's start, so no group meets in one task.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "ranked")
    sorted_ = df.sort("grp", *order).withColumn("_part", F.spark_partition_id())
    map_batches(sorted_, _positions, extended(sorted_.schema, "_local long")).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy("grp", "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "grp", "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), F.sum("_c").over(Window.partitionBy("grp")).alias("n")
    )
    return rows.join(starts, ["grp", "_part"]).withColumn("idx", F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")


def _field(c):
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(doc_id, source, lang, n_chars, text):
    """sha256 hex of the five fields, each ``-`` if NULL, else its UTF-8 byte count, ``:`` and its text."""
    return F.sha2(F.concat(_field(doc_id), _field(source), _field(lang), _field(n_chars), _field(text)), 256)


def _walk(batches):
    """One level up: fold ``val`` at its slot from the kept state, and feed the siblings to the proof state."""
    for b in batches:
        n = len(b)
        kids = b.column("kids").to_pylist()
        mids = b.column("mids").to_pylist()
        slot = np.array(b.column("slot").to_pylist(), dtype=np.int64)
        width = np.array([len(k) for k in kids], dtype=np.int64)
        val = b.column("val").to_pylist()
        proof = states(b.column("ps").to_pylist()) if n else np.zeros((0, 8), np.uint32)
        plen = np.array(b.column("pn").to_pylist(), dtype=np.int64)
        fold = states([mids[i][slot[i]] for i in range(n)]) if n else np.zeros((0, 8), np.uint32)
        fold = compress(fold, blocks(val)) if n else fold
        for j in range(1, FAN):
            has = np.nonzero(slot + j < width)[0]
            if len(has):
                fold[has] = compress(fold[has], blocks([kids[i][slot[i] + j] for i in has]))
        folded = as_hex(finish(fold, width * 64)) if n else []
        for j in range(FAN):
            has = np.nonzero((j < width) & (slot != j))[0]
            if len(has):
                proof[has] = compress(proof[has], blocks([kids[i][j] for i in has]))
                plen[has] += 64
        yield pa.RecordBatch.from_arrays(
            [b.column("rid"), b.column("grp"), b.column("level"), b.column("idx"), b.column("n"), pa.array(folded, pa.string()), pa.array(as_bytes(proof), pa.binary()), pa.array(plen, pa.int64())],
            ["rid", "grp", "level", "idx", "n", "val", "ps", "pn"],
        )


WALK = "rid long, grp string, level int, idx long, n long, val string, ps binary, pn long"


def _proof_digest(batches):
    for b in batches:
        n = len(b)
        st = states(b.column("ps").to_pylist()) if n else np.zeros((0, 8), np.uint32)
        out = as_hex(finish(st, np.array(b.column("pn").to_pylist(), dtype=np.int64))) if n else []
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("val"), pa.array(out, pa.string())], ["rid", "folded_root", "proof_sha256"])


def manifest(df: DataFrame, after: Column | None = None) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``df`` has doc_id, source, lang, n_chars and text (other columns are not
    read, so no name can clash); ``after`` is an expression over ``df`` giving
    each row's text as it is checked (default: the text itself).  Leaves ascend by doc_id within a source (NULL first, equal keys by
    leaf digest); subroots ascend by source, NULL first, UTF-8 bytewise.
    ``proof_sha256`` is the digest of the siblings' digests, level by level up
    to the root, left to right (of nothing: the digest of empty text).
    ``folded_root`` is the root recomputed from the row's leaf of
    ``after`` and the stored sibling states; ``verified`` tells whether
    it equals the root.  Repeated rows are leaves each; an empty table gives no rows.
    """
    spark = df.sparkSession
    src = F.col("source").cast("string")
    text_after = F.col("text") if after is None else after
    leaves = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        src.alias("source"),
        F.when(src.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), src)).alias("grp"),
        leaf_digest(F.col("doc_id"), src, F.col("lang"), F.col("n_chars"), F.col("text")).alias("h"),
        leaf_digest(F.col("doc_id"), src, F.col("lang"), F.col("n_chars"), text_after).alias("after"),
    )
    leaves = ranked(leaves, [F.col("doc_id").asc_nulls_first(), "h", "after"]).withColumn("rid", F.monotonically_increasing_id())
    path = fresh_path(spark, "leaves")
    leaves.write.parquet(path)
    leaves = spark.read.parquet(path)

    inner = tree(spark, leaves.select("grp", "idx", "h", "n"))
    tops = None
    for level in inner:
        top = level.where("n = 1").select("grp", F.col("h").alias("subroot"))
        tops = top if tops is None else tops.unionByName(top)
    subroots = tops.select("grp", "subroot", F.when(F.col("grp") == "n", F.lit(None)).otherwise(F.expr("substring(grp, 2)")).alias("source"))
    upper = ranked(subroots.select(F.lit("r").alias("grp"), F.col("grp").alias("owner"), "source", F.col("subroot").alias("h")), [F.col("source").asc_nulls_first()])
    outer = tree(spark, upper.select("grp", "idx", "h", "n"))
    root = outer[-1].where("n = 1").select("h").first()
    root = root[0] if root else None

    parents = spark.createDataFrame([], "grp string, level int, pidx long, kids array<string>, mids array<binary>")
    for level in [*inner[1:], *outer[1:]]:
        parents = parents.unionByName(level.select("grp", (F.col("level") - 1).alias("level"), F.col("idx").alias("pidx"), "kids", "mids"))
    start = F.unhex(F.lit("".join(f"{x:08x}" for x in START)))
    cur = leaves.select("rid", "grp", F.lit(0).alias("level"), "idx", "n", F.col("after").alias("val"), start.alias("ps"), F.lit(0).cast("long").alias("pn"))
    switch = upper.select(F.col("owner").alias("grp"), F.col("idx").alias("_ridx"), F.col("n").alias("_rn"))
    done = []
    while cur.limit(1).count():
        up = cur.where("n > 1")
        top = cur.where("n = 1")
        done.append(top.where("grp = 'r'"))
        moved = top.where("grp != 'r'").join(switch, "grp").select(
            "rid", F.lit("r").alias("grp"), F.lit(0).alias("level"), F.col("_ridx").alias("idx"), F.col("_rn").alias("n"), "val", "ps", "pn"
        )
        pidx = F.floor(up.idx / FAN).cast("long")
        step = up.join(parents, (up.grp == parents.grp) & (up.level == parents.level) & (pidx == parents.pidx)).select(
            "rid", up.grp, (up.level + 1).alias("level"), pidx.alias("idx"), F.ceil(up.n / FAN).cast("long").alias("n"),
            "val", "ps", "pn", (up.idx % FAN).cast("int").alias("slot"), "kids", "mids",
        )
        path = fresh_path(spark, "walk")
        map_batches(step, _walk, WALK).unionByName(moved).write.parquet(path)
        cur = spark.read.parquet(path)
    finished = spark.createDataFrame([], "rid long, val string, ps binary, pn long")
    for d in done:
        finished = finished.unionByName(d.select("rid", "val", "ps", "pn"))
    proofs = map_batches(finished.select("rid", "val", "ps", "pn"), _proof_digest, "rid long, folded_root string, proof_sha256 string")
    return (
        leaves.join(subroots.select("grp", "subroot"), "grp")
        .join(proofs, "rid")
        .select(
            "doc_id", "source", F.col("h").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
            (F.col("folded_root") == F.lit(root)).alias("verified"),
        )
    )
