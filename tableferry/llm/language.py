"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableferry.llm.arrow import extended, map_batches

UNKNOWN = "und"
ROWS_PER_LANGUAGE = 400
CHARS_PER_ROW = 1000
CHARS_PER_LANGUAGE = 12_000
BLOCK = 512
CODES = sys.maxunicode + 1


class Parser(NamedTuple):
    """``steps[state + own[k, symbols[code]]]`` is twice the next state plus 1 if a phrase began.

    A state is where its row begins.  The rows of language ``k`` have one entry for each of its own
    symbols, and entry 0 for all code points that its sample lacks.
    """

    languages: list[str]
    symbols: np.ndarray
    own: np.ndarray
    steps: np.ndarray
    starts: np.ndarray
    chars: np.ndarray


def fold(text: str) -> np.ndarray:
    """Lower-cased code points, runs of anything but letters as one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    small = codes.astype(np.int64)
    small[~_letters()[codes]] = 32
    keep = np.ones(len(small), bool)
    keep[1:] = (small[1:] != 32) | (small[:-1] != 32)
    return small[keep]


_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(i).isalpha() for i in range(CODES)), bool, CODES))
    return _TABLE[0]


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence: it reads exactly the substrings, from state 0."""
    moves: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in codes:
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        new, at, last = len(moves) - 1, last, len(moves) - 1
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at < 0:
            continue
        target = moves[at][c]
        if length[target] == length[at] + 1:
            link[new] = target
            continue
        moves.append(dict(moves[target]))
        length.append(length[at] + 1)
        link.append(link[target])
        copy = len(moves) - 1
        link[new] = link[target] = copy
        while at >= 0 and moves[at].get(c) == target:
            moves[at][c] = copy
            at = link[at]
    return moves


def build(samples: dict[str, list[str]], chars: int = CHARS_PER_LANGUAGE) -> Parser:
    """A parser over the first ``chars`` folded characters of every language's sample; a short one leaves the others whole."""
    folded = {k: np.concatenate([np.append(fold(t), 32) for t in v])[:chars] for k, v in sorted(samples.items())}
    seen = np.unique(np.concatenate([np.array([32]), *folded.values()]))
    symbols = np.zeros(CODES, np.int32)
    symbols[seen] = np.arange(1, len(seen) + 1)  # symbol 0: never seen in a sample
    own = np.zeros((len(folded), len(seen) + 1), np.int32)
    tables, starts, base = [], [], 0
    for k, codes in enumerate(folded.values()):
        used = np.unique(symbols[codes])
        own[k, used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        moves = automaton(own[k, symbols[codes]].tolist())
        void = len(moves)  # from here every character begins a phrase
        if base + (void + 1) * width >= 1 << 30:
            raise ValueError("the samples are too large; lower the number of characters")
        table = np.full((void + 1, width), -1, np.int32)
        for state, out in enumerate(moves):
            table[state, list(out)] = list(out.values())
        dead = table < 0
        restart = np.where(table[0] < 0, void, table[0]).astype(np.int32)
        table = np.where(dead, restart[None, :], table)
        table *= width
        table += base
        table <<= 1
        table |= dead
        tables.append(table.ravel())
        starts.append(base + void * width)
        base += (void + 1) * width
    steps = np.concatenate(tables) if tables else np.zeros(0, np.int32)
    return Parser(list(folded), symbols, own, steps, np.array(starts, np.int32), np.array([len(v) for v in folded.values()]))


def phrases(parser: Parser, texts: list[np.ndarray]) -> np.ndarray:
    """Phrases of every text against every language, blocks of all texts stepping through the automata side by side.

    A phrase is the longest match with the language's sample, or one unseen
    character; it also ends with a block of ``BLOCK`` characters.
    """
    langs = len(parser.languages)
    counts = np.zeros((len(texts), langs), np.int64)
    if not langs or not texts:
        return counts
    size = np.array([len(t) for t in texts])
    blocks = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(size) - size, blocks) + nth * BLOCK
    length = np.minimum(BLOCK, size[owner] - nth * BLOCK)
    symbols = parser.own[:, parser.symbols[np.concatenate(texts)]]
    order = np.argsort(-length, kind="stable")
    begin, length, owner = begin[order], length[order], owner[order]
    state = np.repeat(parser.starts[:, None], len(begin), 1)
    total = np.zeros((langs, len(begin)), np.int32)
    live = len(begin)
    for step in range(int(length[0]) if len(length) else 0):
        while length[live - 1] <= step:
            live -= 1
        took = parser.steps[state[:, :live] + symbols[:, begin[:live] + step]]
        total[:, :live] += took & 1
        state[:, :live] = took >> 1
    for k in range(langs):
        counts[:, k] = np.bincount(owner, total[k], len(texts)).astype(np.int64)
    return counts


def sample(docs: DataFrame, key: str, text: str, label: str, rows: int = ROWS_PER_LANGUAGE, chars: int = CHARS_PER_ROW) -> DataFrame:
    """Up to ``rows`` labelled rows of every language by hash order of the key, each with its first ``chars`` characters."""
    order = F.xxhash64(F.col(f"`{key}`"), F.lit("sample"))
    salted = docs.select(F.col(f"`{label}`").alias("label"), F.substring(F.col(f"`{text}`"), 1, chars).alias("text"), order.alias("rank"))
    salted = salted.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("salt", F.pmod("rank", F.lit(64)))
    near = salted.withColumn("n", F.row_number().over(Window.partitionBy("label", "salt").orderBy("rank", "text"))).where(F.col("n") <= rows)
    return near.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("rank", "text"))).where(F.col("n") <= rows).select("label", "text", "rank")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", chars: int = CHARS_PER_LANGUAGE) -> Parser:
    """Fit on a bounded sample: ``chars`` characters of each language, from at most 400 rows of 1,000 characters.

    The sample and the automata, bounded for each language, are the only rows
    that the driver sees.  Rows without a label or a letter teach nothing.
    """
    samples: dict[str, list[str]] = {}
    for r in sorted(sample(docs, key, text, label).collect(), key=lambda r: (r["rank"], r["text"])):
        samples.setdefault(r["label"], []).append(r["text"])
    return build(samples, chars)


def identify(docs: DataFrame, parser: Parser, text: str = "text", pred: str = "lang_pred", score: str = "score", rate: str = "phrase_rate") -> DataFrame:
    """Add the language whose sample parses the whole text into fewest normalised phrases.

    A phrase costs the bits of a place in the sample and of one letter out of all
    learned, so a language with a short sample is not at a disadvantage, and one
    that hardly has a sample does not win by it; ties go to the smaller name.
    ``score`` is the runner-up's share of the two best counts, 0.5 for a tie
    and nearer 1 the clearer the decision; ``rate`` is phrases per character
    of the winner.  A NULL text, or one without a letter, is ``und`` with score 0 and
    no rate, and so is every text if nothing was learned.  Other columns pass through.
    """
    weight = np.log2(np.maximum(parser.chars, 2)) + np.log2(parser.own.shape[1])
    names = np.array([*parser.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            sizes = np.asarray(pc.fill_null(pc.utf8_length(column), 0)).cumsum()
            cuts = [0, *np.flatnonzero(np.diff(sizes >> 19)) + 1, batch.num_rows]
            best, share, speed = [], [], []
            for a, b in zip(cuts, cuts[1:]):
                folded = [fold(t or "") for t in column.slice(a, b - a).to_pylist()]
                plain = np.array([bool((t != 32).any()) for t in folded], bool)
                found = phrases(parser, folded)
                cost = found * weight
                if not len(parser.languages):
                    plain[:] = False
                    cost = np.zeros((len(folded), 1))
                top = cost.argmin(1) if len(folded) else np.zeros(0, int)
                least = cost.min(1) if len(folded) else np.zeros(0)
                second = np.partition(cost, 1, 1)[:, 1] if cost.shape[1] > 1 else np.full(len(folded), np.inf)
                with np.errstate(invalid="ignore", divide="ignore"):
                    own = np.where(np.isinf(second), 1.0, second / (least + second))
                best += np.where(plain, top, len(parser.languages)).tolist()
                share += np.where(plain, own, 0.0).tolist()
                chars = np.maximum([len(t) for t in folded], 1)
                speed += [found[i, k] / chars[i] if plain[i] else None for i, k in enumerate(top)]
            extra = [pa.array(names[best].tolist(), pa.string()), pa.array(share, pa.float64()), pa.array(speed, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, pred, score, rate])

    rows = docs.drop(pred, score, rate)
    return map_batches(rows, run, extended(rows.schema, f"`{pred}` string, `{score}` double, `{rate}` double"))


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: a fifth of the keys, by the CRC-32 of the key as text."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
