"""Exact token counts at every prefix of a text, by dynamic programming over prefixes."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from tableferry.llm.arrow import extended, map_batches

#: Fixed values of byte-level BPE: white space, and the contractions cut off before letters.
WHITE = "\t\n\v\f\r \x85\xa0                　"
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

LETTER, NUMBER, OTHER, SPACE, STOP = range(5)
END, MARK = "\U0010ffff", "\U0010fffe"  # stand for the end of a text and for the special token
CHUNK = 1 << 19
KNOWN = 600_000
BASE = 0x9E3779B97F4A7C15 | 1
_BREAK = re.compile(rf"[^{WHITE}](?=[{WHITE}])")


@functools.cache
def kinds() -> np.ndarray:
    """The kind of every code point, by the letters and numbers the tokenizers library knows.

    Where two Unicode tables disagree, the library itself is asked.
    """
    table = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c in "LN":
            table[i] = LETTER if c == "L" else NUMBER
    other = np.full(0x110000, OTHER, np.uint8)
    text = "".join(chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            other[m.start() : m.end()] = kind
    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for i in np.flatnonzero(table != other).tolist():
        table[i] = next((k for k, lead in ((LETTER, "a"), (NUMBER, "1")) if len(cut(lead + chr(i))) == 1), OTHER)
    for c in WHITE:
        table[ord(c)] = SPACE
    table[[ord(END), ord(MARK)]] = STOP
    return table


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""
    return _powers(2 * CHUNK)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(BASE), run(pow(BASE, -1, 1 << 64))


class Pieces:
    """The pre-tokens of many texts, found by comparing neighbouring characters instead of matching a pattern.

    ``start`` and ``end`` index ``chars`` (code points of all texts, each text
    closed by one stop character), ``text`` is each piece's text number, ``kind`` numbers the different pieces and ``key`` is
    their 64-bit hash.  A special token is the piece ``MARK``.
    """

    def __init__(self, texts: list[str], special: str | None):
        if special:
            texts = [t.replace(special, MARK) if special in t else t for t in texts]
        self.chars = chars = np.frombuffer((END.join(texts) + END).encode("utf-32-le"), np.uint32)
        kind = kinds()[chars]
        n = len(chars)
        stop = kind == STOP
        same = np.empty(n, bool)
        same[0] = False
        same[1:] = kind[1:] == kind[:-1]
        same &= ~stop
        start = ~same
        blank = kind == SPACE
        follows = np.append(kind[1:], STOP)
        last = blank & (follows != SPACE) & (follows != STOP)  # last blank before a word
        start |= last
        joins = np.zeros(n, bool)
        joins[1:] = last[:-1] & (chars[:-1] == 32)  # a word takes the blank before it
        start &= ~joins
        quote = np.flatnonzero((chars == 39) & start & ~joins)
        quote = quote[(follows[quote] == LETTER)]
        if len(quote):
            padded = np.append(chars, np.zeros(3, np.uint32))
            one, two = padded[quote + 1], padded[quote + 2]
            start_after = np.zeros(len(quote), np.int64)
            for s in SHORT:
                start_after[one == ord(s)] = 2
            for s in LONG:
                start_after[(one == ord(s[0])) & (two == ord(s[1]))] = 3
            hit = start_after > 0
            begin, after = quote[hit], quote[hit] + start_after[hit]
            start[begin + 1] = False
            more = after[kind[after] == LETTER]
            start[more] = True
        at = np.flatnonzero(start)
        end = np.append(at[1:], n)
        keep = chars[at] != ord(END)
        ends = np.cumsum(chars == ord(END))
        self.start, self.end = at[keep], end[keep]
        self.text = ends[self.start] if len(self.start) else np.zeros(0, np.int64)
        self.text_end = np.flatnonzero(chars == ord(END))
        up, down = powers() if n < 2 * CHUNK else _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        mixed = (sums[self.end] - sums[self.start]) * down[self.start]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (self.end - self.start).astype(np.uint64)
        self.key, self.first, self.kind = np.unique(mixed, return_index=True, return_inverse=True)
        self.marked = bool((chars == ord(MARK)).any())

    def distinct(self, i: int) -> str:
        """The i-th of the different pieces."""
        k = self.first[i]
        return self.chars[self.start[k] : self.end[k]].tobytes().decode("utf-32-le")

    def some(self, which: list[int]) -> list[str]:
        """Several of the different pieces, decoded together."""
        k = self.first[which]
        begin, size = self.start[k], self.end[k] - self.start[k]
        stop = np.cumsum(size)
        at = np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
        text = self.chars[at].tobytes().decode("utf-32-le")
        return [text[a:b] for a, b in zip((stop - size).tolist(), stop.tolist())]


def slices(texts: list[str], special: str | None) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The texts in groups of about ``CHUNK`` characters, each with its number; a longer text is cut before white space."""
    ids: list[int] = []
    group: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            cut = _BREAK.search(t, at + CHUNK) if len(t) - at > 2 * CHUNK else None
            to = cut.end() if cut else len(t)
            ids.append(i)
            group.append(t[at:to] if at or cut else t)
            size += to - at
            at = to
            if size >= CHUNK:
                yield np.array(ids), group
                ids, group, size = [], [], 0
            if at >= len(t):
                break
    if ids:
        yield np.array(ids), group


class Vocabulary:
    """Merges of a byte-level BPE file, and the prefix programme over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        plain = lambda s: bytes(byte[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ids = {bytes([b]): b for b in range(256)}
        self.halves, self.joined = [], {}
        for k, (a, b) in enumerate(pairs):
            left, right = plain(a), plain(b)
            self.halves.append((self.ids[left], self.ids[right]))
            self.joined[self.halves[-1]] = 256 + k
            self.ids[left + right] = 256 + k
        self.longest = max(map(len, self.ids))
        added = [t["content"] for t in spec.get("added_tokens", [])]
        if len(added) > 1 or any(c in (END, MARK) for t in added for c in t):
            raise ValueError("one special token is supported")
        self.special = added[0] if added else None
        self.counts: dict[int, bytes] = {}
        self.joins: dict[tuple[int, int], bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when they stand side by side.

        The later of the two merges at the border is undone again and again; a
        merge across the border that would have come before it joins them.
        """
        limit = len(self.halves) + 256
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < limit:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                limit, left = left, self.halves[left - 256][1]
            else:
                limit, right = right + 1, self.halves[right - 256][0]

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes encode to that token."""
        if token < 256:
            return True
        left, right = self.halves[token - 256]
        del_limit = self.joined.pop((left, right))
        ok = self.fits(left, right)
        self.joined[left, right] = del_limit
        return ok and self.whole(left) and self.whole(right)

    def run(self, data: bytes, last: list[int], counts: list[int]) -> None:
        """Continue the programme to the end of ``data``: last token and number of tokens of every prefix.

        The last token of a prefix is the one token that ends there and fits
        the last token of the prefix before it.
        """
        ids, joins, longest = self.ids, self.joins, self.longest
        for end in range(len(last), len(data) + 1):
            for begin in range(max(0, end - longest), end):
                token = ids.get(data[begin:end])
                if token is not None:
                    pair = (last[begin], token)
                    ok = joins.get(pair)
                    if ok is None:
                        ok = joins[pair] = self.whole(token) if begin == 0 else self.fits(*pair)
                    if ok:
                        last.append(token)
                        counts.append(counts[begin] + 1)
                        break

    def prefix(self, piece: str, last: list[int] | None = None, counts: list[int] | None = None) -> array:
        """Tokens of every prefix of a piece, by code points."""
        if piece == MARK:
            return array("i", [1])
        data = piece.encode()
        last, counts = ([-1], [0]) if last is None else (last, counts)
        self.run(data, last, counts)
        out = array("i", counts)
        if len(piece) > 2 and piece[0] == "'" and piece[1:] in LONG:
            out[2] = 2  # cut before the second letter, the quote stands alone
        return out[1:] if len(data) == len(piece) else array("i", [out[n] for n in itertools.accumulate(len(c.encode()) for c in piece)])

    def table(self, pieces: Pieces) -> list[bytes]:
        """Prefix counts of the different pieces; those of short ones are remembered, and neighbours share their common start."""
        for memory in (self.counts, self.joins):
            if len(memory) > KNOWN:
                memory.clear()
        keys = pieces.key.tolist()
        out = [self.counts.get(k) for k in keys]
        last, counts, before = [-1], [0], b""
        new = [i for i, x in enumerate(out) if x is None]
        for piece, i in sorted(zip(pieces.some(new), new)):
            data = b"" if piece == MARK else piece.encode()
            common = os.path.commonprefix([before, data])
            del last[len(common) + 1 :], counts[len(common) + 1 :]
            out[i] = found = self.prefix(piece, last, counts).tobytes()
            before = data
            if len(piece) <= 64:
                self.counts[keys[i]] = found
        return out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def prefix_counts(texts: list[str], path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, tokens of every prefix of the text by code points, without the empty one), a long text in several parts.

    Counts of later parts go on from the part before.  A prefix that ends
    inside a blank run or a special token is cut into pieces differently from
    the whole text; those prefixes are counted from the last piece they share.
    """
    v = vocabulary(path)
    carried, before = -1, 0
    for ids, group in slices(texts, v.special):
        odd = [i for i, t in enumerate(group) if END in t or MARK in t]
        if odd:
            raise ValueError("a text holds one of the two highest code points, which are no characters")
        p = Pieces(group, v.special)
        each = v.table(p)
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.int32)
        offset = np.cumsum(size) - size
        total = flat[offset + size - 1].astype(np.int64)
        mine, whole = size[p.kind], total[p.kind]
        running = np.concatenate([[0], np.cumsum(whole)])
        place = np.concatenate([[0], np.cumsum(mine)])
        inner = flat[np.repeat(offset[p.kind] - place[:-1], mine) + np.arange(place[-1])] if len(p.kind) else flat
        counts = np.repeat(running[:-1], mine) + inner
        blank = kinds()[p.chars[p.start]] == SPACE if len(p.start) else np.zeros(0, bool)
        alone = (p.end - p.start) == 1
        pure = blank & (alone | (kinds()[p.chars[np.minimum(p.end, len(p.chars)) - 1]] == SPACE)) if len(p.start) else blank
        twice = np.flatnonzero(blank[1:] & pure[:-1] & (p.text[1:] == p.text[:-1])) + 1 if len(blank) > 1 else []
        for k in twice:
            run = p.distinct(p.kind[k - 1]) + chr(p.chars[p.start[k]])
            counts[place[k]] = running[k - 1] + v.prefix(run)[-1]
        first = np.searchsorted(p.text, np.arange(len(group) + 1))
        for t in range(len(group)):
            a, b = first[t], first[t + 1]
            base = before if ids[t] == carried else 0
            own = counts[place[a] : place[b]] - running[a] + base
            if p.marked:
                own = _inside_special(v, p, a, b, own, running, base)
            yield int(ids[t]), own
            carried, before = ids[t], base + int(running[b] - running[a])


def _inside_special(v: Vocabulary, p: Pieces, a: int, b: int, own: np.ndarray, running: np.ndarray, base: int) -> np.ndarray:
    """Put in the counts of prefixes that end inside a special token, where it is ordinary text."""
    out, at = [], 0
    for k in range(a, b):
        n = 1 if p.chars[p.start[k]] == ord(MARK) else p.end[k] - p.start[k]
        if p.chars[p.start[k]] == ord(MARK):
            back = k - 1 if k > a and p.chars[p.start[k - 1]] != ord(MARK) else k
            lead = p.distinct(p.kind[back]) if back < k else ""
            settled = base + running[back] - running[a]
            for j in range(1, len(v.special)):
                tail = Pieces([lead + v.special[:j]], None)
                out.append(np.array([settled + sum(int(v.prefix(tail.distinct(q))[-1]) for q in tail.kind)]))
        out.append(own[at : at + n])
        at += n
    return np.concatenate(out) if out else own


def token_prefixes(df: DataFrame, path: str, text: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """Add an array: the number of tokens of every prefix of the text, by code points, from the empty one on.

    ``path`` is a byte-level BPE file of the tokenizers library.  Questions
    about limits are then answered by ``longest_prefix`` and
    ``tokens_at`` from the stored array, without encoding again.  A NULL text
    gives the array of an empty one, ``[0]``.  Other columns pass through.
    """

    def run(batches):
        for batch in batches:
            found: dict[int, list] = {}
            for i, counts in prefix_counts([t or "" for t in batch.column(text).to_pylist()], path):
                found.setdefault(i, [np.zeros(1, np.int64)]).append(counts)
            arrays = [np.concatenate(found[i]).astype(np.int32) for i in range(batch.num_rows)]
            yield batch.append_column(out, pa.array(arrays, pa.list_(pa.int32())))

    kept = df.drop(out)
    return map_batches(kept, run, extended(kept.schema, f"`{out}` array<int>"))


def tokens_at(prefixes: Column, length: Column | int) -> Column:
    """Tokens of the first ``length`` code points."""
    return F.get(prefixes, length if isinstance(length, Column) else F.lit(length))


def longest_prefix(prefixes: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return F.array_max(F.transform(prefixes, lambda n, i: F.when(n <= budget, i)))


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars (the longest prefix within the limit, in code points).

    The prefix counts of each text are made and asked inside the task and not
    kept.  A NULL text counts as empty.  Repeated rows give repeated rows.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            total, fit, seen = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, counts in prefix_counts(texts, path):
                if len(counts):
                    total[i] = counts[-1]
                    inside = np.flatnonzero(counts <= limit)
                    if len(inside):
                        fit[i] = seen[i] + inside[-1] + 1
                    seen[i] += len(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(total), pa.array(total > limit), pa.array(fit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    schema = extended(docs.select("doc_id").schema, "n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return map_batches(docs.select("doc_id", "text"), run, schema)
