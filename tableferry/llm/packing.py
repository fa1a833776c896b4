"""Packing documents into training sequences by cutting-stock column generation."""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tableferry.llm import tokens
from tableferry.llm.ranking import expanded, numbered
from tableferry.llm.arrow import extended, map_batches
from tableferry.session import ensure_checkpoints

LENGTH = 1024
GRAIN = 8  # lengths are planned in steps of so many tokens
ROUNDS = 4000
KNOWN = 200_000  # pre-tokens remembered by a worker
GAP = 0.001  # distance from the bound at which the program is good enough


class _Encoder:
    """Token ids of pre-tokens by the tokenizers library, those of short ones remembered."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = next(iter(t.content for t in self.library.get_added_tokens_decoder().values()), None)
        self.mark = self.library.token_to_id(self.special) if self.special else None
        self.newline = self.library.token_to_id("Ċ")
        self.known: dict[int, bytes] = {}

    def one(self, piece: str) -> bytes:
        if piece == tokens.MARK:
            return np.array([self.mark], "<u4").tobytes()
        return np.array(self.library.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def several(self, pieces: list[str]) -> list[bytes]:
        """Encoded in one call, each on a line of its own; a line end never joins what stands around it."""
        plain = [i for i, p in enumerate(pieces) if p != tokens.MARK and not p.isspace() and "\n" not in p]
        ids = np.array(self.library.encode("\n".join(pieces[i] for i in plain), add_special_tokens=False).ids, "<u4")
        ends = np.append(np.flatnonzero(ids == self.newline), len(ids))
        out = [b""] * len(pieces)
        begin = 0
        for i, end in zip(plain, ends.tolist()):
            out[i] = ids[begin:end].tobytes()
            begin = end + 1
        for i in set(range(len(pieces))) - set(plain):
            out[i] = self.one(pieces[i])
        return out

    def table(self, pieces: tokens.Pieces) -> list[bytes]:
        keys = pieces.key.tolist()
        out = [self.known.get(k) for k in keys]
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            texts = pieces.some(new)
            for i, text, ids in zip(new, texts, self.several(texts)):
                out[i] = ids
                if len(text) <= 64 and len(self.known) < KNOWN:
                    self.known[keys[i]] = ids
        return out


@functools.cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def token_ids(texts: list[str], path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, ids) of every text, a long one in several parts; the ids the library gives for the whole text.

    Byte-level BPE never joins across pre-tokens, so each different pre-token
    is encoded once.
    """
    e = _encoder(path)
    for numbers, group in tokens.slices(texts, e.special):
        p = tokens.Pieces(group, e.special)
        each = e.table(p)
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        mine = size[p.kind]
        stop = np.cumsum(mine)
        offset = (np.cumsum(size) - size)[p.kind]
        ids = flat[np.repeat(offset - (stop - mine), mine) + np.arange(stop[-1] if len(stop) else 0)]
        bounds = np.concatenate([[0], stop])[np.searchsorted(p.text, np.arange(len(group) + 1))]
        for k, number in enumerate(numbers.tolist()):
            yield number, ids[bounds[k] : bounds[k + 1]]


def cut_documents(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: key, start, length, ids_crc32 and doc_tokens.

    A document is its ids followed by ``end_id``; as many pieces of ``length``
    as fit are cut from its start and the rest is its last piece.  A NULL text
    is empty: one piece of one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            own: list[tuple[int, int, int]] = []
            held, at, open_text = np.zeros(0, "<u4"), 0, -1

            def close() -> None:
                nonlocal held
                held = np.append(held, np.array([end_id], "<u4"))
                cut(0)
                rows.extend((open_text, *piece, at) for piece in own)
                own.clear()

            def cut(least: int) -> None:
                nonlocal held, at
                used = 0
                while len(held) - used > least:
                    part = held[used : used + length]
                    own.append((at, len(part), zlib.crc32(part.tobytes())))
                    used, at = used + len(part), at + len(part)
                held = held[used:]

            for i, ids in token_ids(texts, path):
                if i != open_text:
                    if open_text >= 0:
                        close()
                    held, at, open_text = np.zeros(0, "<u4"), 0, i
                held = np.concatenate([held, ids]) if len(held) else ids
                cut(length)
            if open_text >= 0:
                close()
            which, start, size, crc, total = (list(x) for x in zip(*rows)) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))],
                names=[key, "start", "length", "ids_crc32", "doc_tokens"],
            )

    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    return map_batches(rows, run, extended(rows.select(key).schema, "start long, length long, ids_crc32 long, doc_tokens long"))


def _knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, Counter]:
    """The most valuable multiset of sizes that fits, by dynamic programming over the room."""
    value, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        value[c] = value[c - 1]
        fit = int(np.searchsorted(sizes, c, "right"))
        if fit:
            offers = value[c - sizes[:fit]] + prices[:fit]
            k = int(offers.argmax())
            if offers[k] > value[c] + 1e-12:
                value[c], pick[c] = offers[k], k
    chosen, c = Counter(), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            chosen[int(pick[c])] += 1
            c -= int(sizes[pick[c]])
    return float(value[room]), chosen


def patterns(demand: dict[int, int], room: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(pattern, how often): patterns {size: pieces} that hold every demanded piece, in few bins of ``room``.

    The linear program over patterns is solved by the simplex method; the
    knapsack finds the pattern that its prices make most worthwhile, until none
    pays, the bound is met within ``GAP`` or ``rounds`` are over.  Counts are rounded down, and what is then left,
    a few pieces for each size at most, goes first-fit by falling size.
    """
    sizes = np.array(sorted(demand), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    columns = [Counter({k: int(room // s)}) for k, s in enumerate(sizes)]
    inverse = np.diag(1.0 / (room // sizes))
    amount = inverse @ need
    cost = np.ones(len(sizes))
    center, bound = sizes / room, float(need @ sizes) / room  # no sequence holds more than the room: a first bound
    for _ in range(rounds):
        prices = cost @ inverse
        if amount.sum() <= bound * (1 + GAP):
            break
        for pull in (0.8, 0.0):  # prices drawn towards those of the best bound swing less
            guess = pull * center + (1 - pull) * prices
            worth, pattern = _knapsack(sizes, guess, room)
            reach = float(need @ guess) / max(worth, 1)
            if reach > bound:
                center, bound = guess / max(worth, 1), reach
            pays = sum(prices[k] * n for k, n in pattern.items()) > 1 + 1e-7
            if pays:
                break
        if not pays:
            break
        column = np.zeros(len(sizes))
        column[list(pattern)] = list(pattern.values())
        move = inverse @ column
        up = move > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, move, 1), np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        amount -= step * move
        amount[leave] = step
        inverse[leave] /= move[leave]
        other = np.arange(len(sizes)) != leave
        inverse[other] -= np.outer(move[other], inverse[leave])
        columns[leave] = pattern
    left = Counter({int(s): int(n) for s, n in zip(sizes, need)})
    out: list[tuple[dict[int, int], int]] = []
    for pattern, x in sorted(zip(columns, amount), key=lambda c: -c[1]):
        named = {int(sizes[k]): n for k, n in pattern.items()}
        times = min([int(x + 1e-6), *(left[s] // n for s, n in named.items())])
        if times > 0:
            out.append((named, times))
            for s, n in named.items():
                left[s] -= n * times
    by_room: dict[int, list[Counter]] = {}
    for s in sorted(left, reverse=True):
        for _ in range(left[s]):
            free = next((r for r in range(s, room + 1) if by_room.get(r)), None)
            held = by_room[free].pop() if free is not None else Counter()
            held[s] += 1
            by_room.setdefault((room if free is None else free) - s, []).append(held)
    same = Counter(tuple(sorted(b.items())) for held in by_room.values() for b in held)
    return out + [(dict(p), n) for p, n in sorted(same.items())]


def pack(pieces: DataFrame, length: int = LENGTH, grain: int = GRAIN, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to pieces (any key columns, start, length, ...) of at most ``length``.

    The histogram of lengths, rounded up to the grain, has one row per length
    and is all that the driver sees; it gives the patterns.  Pieces are ranked inside their length class, and
    a table of (class, ranks from, pattern) says which copy of which pattern a
    rank belongs to.  Offsets are running sums of the true lengths, so a
    sequence has no gaps.  Sequences are shorter than ``length`` only where no
    combination of pieces fills them; equal input is packed equally.
    """
    pieces = pieces.withColumn("_class", (F.ceil(F.col("length") / grain)).cast("int"))
    room = length // grain
    demand = {r["_class"]: r["n"] for r in pieces.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, used, first = [], Counter(), 0
    for pattern, times in patterns(demand, room, rounds):
        for size, n in pattern.items():
            plan.append((size, used[size], used[size] + n * times, n, first))
            used[size] += n * times
        first += times
    spark = pieces.sparkSession
    slots = spark.createDataFrame(plan, "_size int, _from long, _to long, _per long, _first long")
    ranked = expanded(numbered(pieces, ["_class"], [c for c in pieces.columns if c not in ("_class",)]))
    ranked = ranked.withColumn("_rank", F.col("before") + F.col("copy")).drop("before", "copy", "copies")
    # the plan is bounded by the classes and rounds above, whatever the number of pieces
    at = ranked.join(F.broadcast(slots), (F.col("_class") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    at = at.withColumn("sequence_id", F.col("_first") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_per")))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_class", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")
    return at.withColumn("offset", offset).drop("_class", "_rank", "_size", "_from", "_to", "_per", "_first")


def packed_documents(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of every document.

    Repeated rows give repeated pieces, each with a place of its own.
    """
    ensure_checkpoints(docs.sparkSession)
    return pack(cut_documents(docs, path, end_id).checkpoint())
