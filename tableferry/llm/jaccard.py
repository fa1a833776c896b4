"""Near-duplicate join on sets of word n-grams by rare-first prefix filtering.

Every n-gram is ordered by how many rows hold n-grams of its hash bucket
(rarest first, then by its 64-bit hash): the counts of ``BUCKETS`` buckets are a
sketch of bounded size, any order that all sets share keeps the filter exact,
and a frequent n-gram makes its bucket frequent.  Two sets of sizes ``a`` and ``b`` reach the threshold ``t`` only if
they share one of the first ``a - ceil(t a) + 1`` n-grams of each (the prefix),
so only prefix n-grams are joined.  A candidate pair must pass the length
filter (``t max <= min``), the positional filter at its first shared prefix
n-gram (one plus the shorter rest must reach the needed overlap), a parity
filter (1,024 parity bits per set; more differing bits than n-grams may differ
rule a pair out before its texts are sought) and a suffix filter (a lower bound of the symmetric difference of the rests, by splitting
both at a probe n-gram, two levels deep); the pair is then verified once,
by an exact count of shared n-grams.

Whole sets are never shuffled or kept: a pass over the texts counts the
buckets, a second one keeps the prefix of each set, and the sets of candidates
alone are made again from their texts for the verification, where a set comes
once to each cell of pairs instead of once to each pair.

Identical sets (by a 128-bit digest of their n-grams) are one set before the
join: their members are linked to each other anyway, so a group of thousands
of exact copies costs one row.
A prefix n-gram shared by very many sets is cut into hash blocks, and block
pairs meet in their own tasks, so no task holds a frequent n-gram's list.
Pairs inside a group of near copies are not joined: their links are counted from
how each set differs from a base of the group (:mod:`tableferry.llm.neargroups`).
Components of the verified links come from rounds of joins
(:mod:`tableferry.llm.links`).  N-grams are compared by a 64-bit hash of their text.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableferry.llm.arrow import map_batches
from tableferry.llm.links import components
from tableferry.llm.neargroups import DIFFERENCES, blocks, by_group, differences, differing, group_links, meet, near_groups
from tableferry.llm.repeats import _batched, grams, word_hashes
from tableferry.session import ensure_checkpoints, written

BLOCK = 2048
DEPTH = 2
BUCKETS = 1 << 18
PARITY = 1024  # bits
CELL = ("low", "bx", "by")
CELL_PAIRS = 1 << 12


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The distinct ``width``-word shingles (sorted 64-bit hashes) of each text with A-Z lower-cased.

    Fewer words give the whole sequence as one shingle; no words, or NULL text, the empty set.
    """
    lowered = [(t or "").encode().lower() for t in texts]
    for a, b in _batched(np.array([len(t) for t in lowered])):
        words, begins = word_hashes(lowered[a:b])
        runs = grams(words, width)
        for first, end in zip(begins, begins[1:]):
            n = end - first
            yield np.unique(runs[first : end - width + 1] if n >= width else grams(words[first:end], n) if n else words[:0])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many n-grams of all sets fall into each bucket: a sketch of document frequencies, of the same size for any input."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            found = list(shingle_sets(batch.column("text").to_pylist(), width))
            if found:
                total += np.bincount(_bucket(np.concatenate(found)), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    counted = map_batches(docs.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def _rare_first(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return hashes[np.lexsort((hashes, counts[_bucket(hashes)]))]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _parities(hashes: np.ndarray) -> np.ndarray:
    """For each of ``PARITY`` classes of hashes, whether the set holds an odd number of it, packed into longs.

    An n-gram that only one of two sets holds turns one bit, so the bits that differ
    are at most as many as the n-grams that differ.
    """
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _prefixes(width: int, t: Fraction, counts: np.ndarray):
    """Per text the size, digest and parities of its set, and the n-grams of its prefix in order."""

    def run(batches):
        for batch in batches:
            sizes, digests, heads, bits = [], [], [], []
            for grams_ in shingle_sets(batch.column("text").to_pylist(), width):
                n = len(grams_)
                sizes.append(n)
                digests.append(hashlib.blake2b(grams_.tobytes(), digest_size=16).digest())
                keep = n + (-n * t.numerator) // t.denominator + 1 if n else 0
                heads.append(_rare_first(grams_, counts)[:keep])
                bits.append(_parities(grams_))
            marks = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            made = [pa.array(sizes, pa.int64()), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), _lists(heads), _lists(bits)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "t1", "t2")), *made], ["doc_id", "t1", "t2", "size", "f1", "f2", "heads", "bits"])

    return run


def _whole(width: int, counts: np.ndarray):
    def run(batches):
        for batch in batches:
            made = [_rare_first(s, counts) for s in shingle_sets(batch.column("text").to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(made)], ["id", "grams"])

    return run


def _ceil_times(size, t: Fraction):
    """``ceil(t size)`` in integers."""
    return F.floor((size * t.numerator + (t.denominator - 1)) / t.denominator).cast("long")


def _hamming_bound(x: list, y: list, depth: int) -> int:
    """A lower bound of the size of the symmetric difference of sorted lists ``x`` and ``y``.

    Split ``y`` at its middle element ``w`` and ``x`` where ``w`` would stand: the
    parts left of ``w`` can only meet each other, so can the parts right of it,
    and ``w`` missing from ``x`` adds one.
    """
    if depth == 0 or not x or not y:
        return abs(len(x) - len(y))
    m = len(y) // 2
    w = y[m]
    k = bisect.bisect_left(x, w)
    found = k < len(x) and x[k] == w
    left = _hamming_bound(x[:k], y[:m], depth - 1)
    right = _hamming_bound(x[k + found :], y[m + 1 :], depth - 1)
    return left + right + (0 if found else 1)


def _verifier(t: Fraction, counts: np.ndarray):
    num, den = t.numerator, t.denominator

    def ordered(hashes: np.ndarray) -> list:
        return list(zip(counts[_bucket(hashes)].tolist(), hashes.tolist()))

    def linked(ax: np.ndarray, ay: np.ndarray, p: int, q: int) -> bool:
        sx, sy = len(ax), len(ay)
        # overlap o links when o / (sx + sy - o) >= t, i.e. o >= t (sx + sy) / (1 + t)
        need = -(-num * (sx + sy) // (num + den))
        hmax = sx + sy - 2 * need - (p + q)
        if hmax < 0 or _hamming_bound(ordered(ax[p + 1 :]), ordered(ay[q + 1 :]), DEPTH) > hmax:
            return False
        common = len(np.intersect1d(ax, ay, assume_unique=True))
        return den * common >= num * (sx + sy - common)

    def run(batches):
        cell, held = None, {}
        for b in batches:
            values, at = np.asarray(b.column("grams").values).view(np.uint64), np.asarray(b.column("grams").offsets)
            keep = []
            for i, (*own, x, y, p, q) in enumerate(zip(*(b.column(c).to_pylist() for c in (*CELL, "x", "y", "px", "py")))):
                if own != cell:
                    cell, held = own, {}
                if y is None:
                    held[x] = values[at[i] : at[i + 1]].copy()
                elif linked(held[x], held[y], p, q):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep, pa.int64())) for c in ("x", "y")], ["a", "b"])

    return run


def _in_cells(pairs: DataFrame) -> DataFrame:
    """The pairs (x < y) with the cell that verifies each.

    A pair goes by the smallest partner of its ``x`` that is below it, so that the
    pairs of a group of near copies go together; a group of more than
    ``CELL_PAIRS`` pairs is cut into hash blocks of sets, a cell for two of them.
    """
    low = pairs.groupBy(F.col("y").alias("x")).agg(F.min("x").alias("low"))
    pairs = pairs.join(low, "x", "left").withColumn("low", F.coalesce("low", "x"))
    cut = pairs.groupBy("low").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / CELL_PAIRS)).alias("n"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("n"))
    return pairs.join(cut, "low").select("low", block("x").alias("bx"), block("y").alias("by"), "x", "y", "px", "py")


def jaccard_components(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles`` long, ``component_id``, ``n_links`` long.

    Two rows link when their shingle sets (see :func:`shingle_sets`) have
    ``|A & B| >= threshold |A | B|``; ``component_id`` is the smallest key
    reachable over links, the row's own included (NULL keys take no part in
    the minimum; a component of NULL keys only has NULL).  Empty sets (no
    words, NULL text) link with nothing.  ``n_links`` counts the other rows a
    row links with; rows with identical sets are counted one by one, although
    the join meets their set once.  Repeated rows are rows of their
    own that link with each other.  Input columns other than ``key`` and
    ``text`` are dropped, so no name can clash.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    t = Fraction(threshold)
    key_, text_ = F.col(f"`{key}`"), F.col(f"`{text}`")
    # two hashes stand for a text, so that only the texts of candidates are sought again
    docs = df.select(key_.cast("long").alias("doc_id"), F.xxhash64(text_).alias("t1"), F.xxhash64(F.lit(1), text_).alias("t2"), text_.alias("text"))
    counts = bucket_counts(docs, width)
    schema = "doc_id long, t1 long, t2 long, size long, f1 long, f2 long, heads array<long>, bits array<long>"
    rows = written(map_batches(docs, _prefixes(width, t, counts), schema), "prefixes")

    # identical non-empty sets collapse into one
    mark = ["f1", "f2", "size"]
    alike = rows.where("size > 0").groupBy(*mark).agg(
        F.first("heads").alias("heads"), F.first("bits").alias("bits"), F.min(F.struct("t1", "t2")).alias("t"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    sets = written(alike.withColumn("id", F.monotonically_increasing_id()), "sets")

    heads = sets.select(F.col("id").alias("rid"), "size", F.posexplode("heads").alias("pos", "gram"))
    spread = written(heads.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "spread")
    groups = written(near_groups(heads, spread, sets, PARITY, BLOCK), "groups")
    # of the sets that hold a gram, those of its largest group meet the others only
    heads = heads.join(groups, "rid", "left")
    largest = heads.where("group IS NOT NULL").groupBy("gram", "group").agg(F.count(F.lit(1)).alias("m")).groupBy("gram").agg(F.max(F.struct("m", "group")).alias("largest"))
    spread = spread.join(largest, "gram", "left").withColumn("rest", F.col("n") - F.coalesce("largest.m", F.lit(0))).where("rest > 0")
    spread = spread.select("gram", F.col("largest.group").alias("most"), blocks(F.col("rest"), BLOCK).alias("nl"), blocks(F.col("n"), BLOCK).alias("nr"))
    heads = heads.join(spread, "gram").withColumn("most", F.coalesce(F.col("group") == F.col("most"), F.lit(False))).withColumn("group", F.coalesce("group", -1 - F.col("rid")))
    heads = written(heads, "lists")
    need = _ceil_times(F.col("l_size") + F.col("r_size"), Fraction(t.numerator, t.numerator + t.denominator))
    pairs = meet(heads.where("NOT most"), heads, ["gram"]).where(
        (F.col("l_group") != F.col("r_group"))
        & (F.col("r_most") | (F.col("l_rid") < F.col("r_rid")))
        & (F.least("l_size", "r_size") * t.denominator >= F.greatest("l_size", "r_size") * t.numerator)
        & (1 + F.least(F.col("l_size") - F.col("l_pos") - 1, F.col("r_size") - F.col("r_pos") - 1) >= need)
    )
    ahead = F.col("l_rid") < F.col("r_rid")
    sides = ((F.when(ahead, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")), F.when(ahead, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}"))) for c in ("rid", "size", "pos"))
    pairs = pairs.select(*[of.alias(name) for names, ofs in zip((("x", "y"), ("l_size", "r_size"), ("px", "py")), sides) for name, of in zip(names, ofs)])
    firsts = pairs.groupBy("x", "y", "l_size", "r_size").agg(F.min("px").alias("px"), F.min("py").alias("py"))
    xs, ys = (sets.select(F.col("id").alias(c), F.col("bits").alias(f"{c}_bits")) for c in "xy")
    differ = differing(F.col("x_bits"), F.col("y_bits"), PARITY // 64)
    near = firsts.join(xs, "x").join(ys, "y").where(differ <= F.col("l_size") + F.col("r_size") - 2 * need)
    firsts = written(near.select("x", "y", "px", "py"), "pairs")
    grouped = groups.select("rid").union(groups.select("group"))
    wanted = firsts.select(F.col("x").alias("id")).union(firsts.select("y")).union(grouped).distinct().join(sets.select("id", "t.t1", "t.t2"), "id")
    # copies of a text become one before they are shuffled
    texts = docs.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(wanted, ["t1", "t2"]).select("id", "text")
    whole = written(map_batches(texts, _whole(width, counts), "id long, grams array<long>"), "whole")
    diffs = written(map_batches(by_group(groups, whole), differences, DIFFERENCES), "differences")
    degrees, ties = group_links(diffs, sets, t, BLOCK)
    # a set comes once to each cell, ahead of the cell's pairs
    pairs = written(_in_cells(firsts), "cells")
    members = pairs.select(*CELL, F.col("x").alias("id")).union(pairs.select(*CELL, "y")).distinct().join(whole, "id")
    no = F.lit(None)
    came = members.select(*CELL, F.col("id").alias("x"), no.cast("long").alias("y"), no.cast("int").alias("px"), no.cast("int").alias("py"), "grams")
    came = came.union(pairs.select(*CELL, "x", "y", "px", "py", F.array().cast("array<long>").alias("grams")))
    laid = came.repartition(*CELL).sortWithinPartitions(*CELL, F.col("y").asc_nulls_first())
    links = written(map_batches(laid, _verifier(t, counts), "a long, b long"), "links")

    roots = components(links.union(ties))
    plain = sets.select("id", *mark, "least", "copies")
    labelled = plain.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    ends = links.select("a", "b").union(links.select("b", "a"))
    partners = ends.join(plain.select(F.col("id").alias("b"), "copies"), "b").select(F.col("a").alias("id"), F.col("copies").alias("p"))
    partners = partners.union(degrees).groupBy("id").agg(F.sum("p").alias("p"))
    linked = (
        labelled.join(smallest, "root")
        .join(partners, "id", "left")
        .select(*mark, "component_id", (F.col("copies") - 1 + F.coalesce("p", F.lit(0))).alias("n_links"))
    )
    return rows.select("doc_id", *mark).join(linked, mark, "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
