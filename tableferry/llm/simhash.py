"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableferry.llm.links import components
from tableferry.llm.arrow import extended, map_batches
from tableferry.session import ensure_checkpoints

SEED = 42
PARTS = 65536  # shingles counted at a time


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of the lower-cased words' shingles, repeats counted; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change case, only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    stops = list(itertools.accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *map((1).__add__, stops)]
    span = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops[span - 1 :])]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PARTS):
        part = np.array(hashes[at : at + PARTS], "<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the fingerprint (a signed long) of every row; a NULL text counts as one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=[key, "mark"])

    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    return map_batches(rows, run, extended(rows.select(key).schema, "mark long"))


class GrayIndex:
    """Fingerprints in Gray order, with nodes above them that hold the bits shared by all below.

    Neighbours in Gray order differ in few bits, so the nodes of ``fan``
    consecutive entries share long patterns.  A node is (pattern, mask): the
    bits set in the mask are equal in everything below.
    """

    def __init__(self, marks: np.ndarray, fan: int = 16):
        rank = marks.copy()
        for shift in (1, 2, 4, 8, 16, 32):  # position of a word in the Gray sequence
            rank ^= rank >> np.uint64(shift)
        self.marks = marks[np.argsort(rank)]
        self.fan = fan
        full = np.full(len(marks), np.uint64(0xFFFFFFFFFFFFFFFF))
        self.levels = [(self.marks, full)]
        while len(self.levels[-1][0]) > fan:
            pattern, mask = self.levels[-1]
            at = np.arange(0, len(pattern), fan)
            all_one = np.bitwise_and.reduceat(pattern & mask, at)
            all_zero = np.bitwise_and.reduceat(~pattern & mask, at)
            self.levels.append((all_one, all_one | all_zero))

    def pairs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of pairs that differ in at most ``most`` bits, in pieces of bounded size.

        Pairs of nodes are followed from the top down; a pair is dropped with
        everything below it once its shared bits differ in too many places.
        """
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        a, b = np.triu_indices(n)
        stack = [(top, a, b)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > 1 << 14 and level:
                stack += [(level, a[i : i + (1 << 14)], b[i : i + (1 << 14)]) for i in range(0, len(a), 1 << 14)]
                continue
            pattern, mask = self.levels[level]
            near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= most
            a, b = a[near], b[near]
            if level == 0:
                other = a < b
                yield a[other], b[other]
            elif len(a):
                below = len(self.levels[level - 1][0])
                step = np.arange(self.fan)
                x = (a[:, None, None] * self.fan + step[None, :, None]).repeat(self.fan, 2).ravel()
                y = (b[:, None, None] * self.fan + step[None, None, :]).repeat(self.fan, 1).ravel()
                ok = (x <= y) & (y < below) & (x < below)
                stack.append((level - 1, x[ok], y[ok]))


def _stars(marks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its component) for members other than the smallest."""
    index = GrayIndex(marks)
    root = np.arange(len(marks))
    for a, b in index.pairs(most):
        while len(a):
            ra, rb = root[a], root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(root, above := root[root]):
                root = above
    least = np.full(len(marks), np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, root, index.marks)
    own = least[root]
    far = own != index.marks
    return index.marks[far], own[far]


def links(marks: DataFrame, most: int) -> DataFrame:
    """(a, b): enough links of distance at most ``most`` to join everything that such links join.

    ``marks`` holds different fingerprints.  The 64 bits are cut into
    ``most + 4`` blocks; two fingerprints within ``most`` bits agree in all but
    ``most`` of them, so each fingerprint is sent once for every choice of the
    other four.  Only ``most`` blocks of bits are free inside a group, 22 bits
    for a distance of 2, so a group has a bound whatever the number of documents.
    """
    cuts = [round(i * 64 / (most + 4)) for i in range(most + 5)]
    blocks = [sum(1 << k for k in range(a, b)) for a, b in itertools.pairwise(cuts)]
    masks = [sum(c) for c in itertools.combinations(blocks, 4)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = marks.select(
        "mark",
        F.posexplode(F.array(*[F.col("mark").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("choice", "shared"),
    )
    keyed = keyed.repartition("choice", "shared").sortWithinPartitions("choice", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group: list[np.ndarray] = []
        group = None

        def close() -> tuple[np.ndarray, np.ndarray]:
            return _stars(np.concatenate(open_group), most)

        for batch in batches:
            mark, choice, shared = (np.asarray(c) for c in batch.columns)
            if not len(mark):
                continue
            edge = np.flatnonzero((choice[1:] != choice[:-1]) | (shared[1:] != shared[:-1])) + 1
            begin = np.concatenate([[0], edge])
            end = np.append(edge, len(mark))
            several = np.flatnonzero(end - begin > 1)
            found = []
            for k in sorted({0, len(begin) - 1, *several.tolist()}):  # the first and the last may go on in other batches
                this = (choice[begin[k]], shared[begin[k]])
                if this != group:
                    if sum(map(len, open_group)) > 1:
                        found.append(close())
                    open_group, group = [], this
                open_group.append(mark[begin[k] : end[k]].view(np.uint64))
            if found:
                yield _pairs(found)
        if sum(map(len, open_group)) > 1:
            yield _pairs([close()])

    return map_batches(keyed.select("mark", "choice", "shared"), run, "a long, b long")


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hexadecimal digits) and component_id of every row.

    Fingerprints that differ in at most ``most`` bits are linked;
    ``component_id`` is the smallest key reachable.  Texts without words, NULL
    ones included, have fingerprint zero and are linked like any other.  NULL
    keys never name a component unless it has no other key.  Repeated rows
    give repeated rows; other columns are not read.
    """
    ensure_checkpoints(docs.sparkSession)
    marked = fingerprints(docs, width, key, text).checkpoint()
    distinct = marked.groupBy("mark").agg(F.min(key).alias("least"))
    joined = components(links(distinct.select("mark"), most))
    roots = distinct.join(joined, distinct["mark"] == joined["node"], "left").select("mark", "least", F.coalesce("root", "mark").alias("root"))
    owners = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(owners, "root").select("mark", "component_id")
    return marked.join(named, "mark").select(key, F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
