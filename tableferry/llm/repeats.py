"""Repeated passages across documents, by a sparse suffix array over content-selected positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableferry.llm.arrow import extended, map_batches
from tableferry.session import written

LEAST = 50  # words of a passage
GRAM = 20  # words of the suffix that neighbours share at least
BYTES = 1 << 20
ODD, ODD_WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums modulo 2**64 and the powers that shift a difference of two back to its start."""
    n = len(values) + 1
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(n, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, and the number of words before each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    white = _WHITE[data]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    sums, down = _sums(data.astype(np.uint64) + np.uint64(1), ODD)
    words = _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return words, np.searchsorted(start, begins)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    sums, down = _sums(words, ODD_WORD)
    return _mixed((sums[size:] - sums[:-size]) * down[: len(words) - size + 1])


def selected(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest hash of some ``window`` consecutive ones, the leftmost if equal."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    at, width = np.arange(len(hashes)), 1
    while width < window:
        step = min(width, window - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(hashes[left] <= hashes[right], left, right)
        width += step
    return np.unique(at)


def _batched(sizes: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // BYTES)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, two hashes that stand for the row, and its text."""
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    return docs.select(k.alias("doc_id"), F.xxhash64(k, t).alias("u1"), F.xxhash64(F.lit(1), t).alias("u2"), t.alias("text"))


def sparse_suffixes(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """u1, u2, pos and gram hash of the minimiser positions.

    Of every ``least - gram + 1`` consecutive runs of ``gram`` words the one
    with the smallest hash is kept: any two equal passages of ``least``
    words keep the same run at the same place inside them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            for a, b in _batched(np.array([len(t) for t in texts])):
                words, begins = word_hashes(texts[a:b])
                hashes = grams(words, gram)
                doc, pos, value = [], [], []
                for i in range(b - a):
                    own = hashes[begins[i] : max(begins[i], begins[i + 1] - gram + 1)]
                    at = selected(own, least - gram + 1)
                    doc.append(np.full(len(at), a + i))
                    pos.append(at)
                    value.append(own[at])
                which = pa.array(np.concatenate(doc), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("u1").take(which), batch.column("u2").take(which), pa.array(np.concatenate(pos), pa.int32()), pa.array(np.concatenate(value).view(np.int64))],
                    names=["u1", "u2", "pos", "gram"],
                )

    return map_batches(rows.select("u1", "u2", "text"), run, "u1 long, u2 long, pos int, gram long")


def with_contexts(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """Each wanted position with the word hashes to its right, and to its left in reverse, as far as a passage of ``least`` words can reach."""
    reach = least - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            for a, b in _batched(np.array([len(t) for t in texts])):
                words, begins = word_hashes(texts[a:b])
                hashes = grams(words, gram)
                short = (words >> np.uint64(32)).astype(">u4")
                doc, pos, value, right, left = [], [], [], [], []
                for i in range(b - a):
                    own = short[begins[i] : begins[i + 1]]
                    for p in sorted(batch.column("wanted")[a + i].as_py()):
                        doc.append(a + i)
                        pos.append(p)
                        value.append(hashes[begins[i] + p])
                        right.append(own[p + gram : p + gram + reach].tobytes())
                        left.append(own[max(0, p - reach) : p][::-1].tobytes())
                which = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(which) for c in ("doc_id", "u1", "u2")), pa.array(pos, pa.int32()), pa.array(np.array(value, np.uint64).view(np.int64)), pa.array(right, pa.binary()), pa.array(left, pa.binary())],
                    names=["doc_id", "u1", "u2", "pos", "gram", "right_words", "left_words"],
                )

    schema = extended(rows.select("doc_id").schema, "u1 long, u2 long, pos int, gram long, right_words binary, left_words binary")
    return map_batches(rows.select("doc_id", "u1", "u2", "text", "wanted"), run, schema)


def _padded(column: pa.Array, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes as a matrix, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    size = (offsets[1:] - offsets[:-1]) // 4
    words = np.zeros((len(column), reach), np.uint32)
    words[np.arange(reach)[None, :] < size[:, None]] = flat[offsets[0] : offsets[-1]].view(">u4")
    return words, size


def _leading(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    same = (a == b) & (np.arange(a.shape[1])[None, :] < size[:, None])
    return np.where(same.all(1), a.shape[1], same.argmin(1)) if a.shape[1] else np.zeros(len(a), int)


def _common(column: pa.Array, reach: int) -> np.ndarray:
    """Leading words that each row shares with the next one."""
    words, size = _padded(column, reach)
    return _leading(words[1:], words[:-1], np.minimum(size[1:], size[:-1]))


def _shared(left: pa.Array, right: pa.Array, reach: int) -> np.ndarray:
    """Leading words that two columns share in each row."""
    (a, m), (b, n) = _padded(left, reach), _padded(right, reach)
    return _leading(a, b, np.minimum(m, n))


def _neighbours(least: int, gram: int, edges: bool):
    """Compare sorted suffixes with their neighbours; with ``edges``, also hand on the first and the last row of the task.

    A suffix that shares fewer than ``least`` words with both has an empty span at its position.
    """
    reach = least - gram
    names = ["doc_id", "u1", "u2", "pos", "gram", "right_words", "left_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = None
        carried = None  # extents that the last row of the batch before has from its own predecessor

        def out(rows: pa.Table | pa.RecordBatch, left: np.ndarray, right: np.ndarray, edge: int) -> pa.RecordBatch:
            pos = np.asarray(rows.column("pos"))
            linked = left >= 0
            spans = [pa.array(np.where(linked, x, pos), pa.int32()) for x in (pos - left, pos + gram + right)]
            mark = pa.array(np.full(len(pos), 2 * part + edge if edge >= 0 else -1), pa.int64())
            return pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *spans, mark], names=[*names, "start", "stop", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if edges and last is None:
                yield out(batch.slice(0, 1), np.zeros(1, int), np.zeros(1, int), 0)
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            value = np.asarray(batch.column("gram"))
            left, right = (_common(batch.column(c), reach) for c in ("left_words", "right_words"))
            linked = (value[1:] == value[:-1]) & (left + right + gram >= least)
            best_left, best_right = np.full(len(value), -1), np.full(len(value), -1)
            if carried is not None:
                best_left[0], best_right[0] = carried
            for own in (slice(1, None), slice(None, -1)):
                best_left[own] = np.maximum(best_left[own], np.where(linked, left, -1))
                best_right[own] = np.maximum(best_right[own], np.where(linked, right, -1))
            last = batch.slice(batch.num_rows - 1)
            carried = (best_left[-1], best_right[-1])
            yield out(batch.slice(0, batch.num_rows - 1), best_left[:-1], best_right[:-1], -1)
        if last is not None:
            yield out(last, np.array([carried[0]]), np.array([carried[1]]), -1)
            if edges:
                yield out(last, np.zeros(1, int), np.zeros(1, int), 1)

    return run


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder; sorted rows with equal words beside one another take little room there."""
    return written(df, label, compression="zstd")


def matches(docs: DataFrame, least: int = LEAST, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, u1, u2, pos, gram, right_words, left_words, start, stop: every suffix with what it shares with its neighbours.

    Only positions whose run of ``gram`` words occurs again anywhere become
    suffixes. They are range-partitioned and sorted by what follows, then by
    what stands before, then by document; ties included, so even a passage
    found everywhere is cut over many tasks.  Each is compared with the one
    before and the one after it, across the borders of tasks too, and the match
    is extended word by word to the right and to the left.
    """
    rows = named(docs, key, text)
    positions = sparse_suffixes(rows, least, gram)
    # written, so that the join below meets two plain shuffles and a gram found everywhere can be split
    again = _written(positions.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    # written too, so that the shuffled positions are gone when the texts are shuffled
    wanted = _written(positions.join(again, "gram", "left_semi").groupBy("u1", "u2").agg(F.collect_set("pos").alias("wanted")), "wanted")
    suffixes = with_contexts(rows.join(wanted, ["u1", "u2"]), least, gram)
    order = ["gram", "right_words", "left_words", "doc_id", "u1", "u2", "pos"]
    ordered = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = extended(suffixes.schema, "start int, stop int, edge long")
    found = _written(map_batches(ordered, _neighbours(least, gram, True), schema), "suffixes")
    # two rows per task, in the order of tasks: the last one of a task stands before the first one of the next
    edges = found.where("edge >= 0").repartition(1).sortWithinPartitions("edge").select(*suffixes.columns)
    across = map_batches(edges, _neighbours(least, gram, False), schema)
    return found.where("edge < 0").unionByName(across).drop("edge")


_PLACE = ("doc_id", "u1", "u2", "pos")


def _place():
    return F.struct(F.col("doc_id").isNull().alias("none"), *_PLACE)


def _merged(spans: DataFrame, own: list[str]) -> DataFrame:
    """Overlapping and touching spans of each document as one; a document's own spans bound the group."""
    spans = spans.select(*own, "start", "stop").distinct()
    order = Window.partitionBy(*own).orderBy("start", "stop")
    spans = spans.withColumn("_new", (F.col("start") > F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    spans = spans.withColumn("_island", F.sum("_new").over(order))
    return spans.groupBy(*own, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def _beside_owner(found: DataFrame, least: int, gram: int) -> DataFrame:
    """Each place and gram with the span to report, ``duplicate``, and ``meets``: whether it shares ``least`` words with its gram's owner.

    The owner is the gram's place in the smallest doc_id (NULL last), and there the first; it
    keeps the span it shares with its neighbours, and all others have what they share with it.
    """
    reach = least - gram
    owners = found.groupBy("gram").agg(F.min_by(F.struct(_place().alias("owner"), F.col("right_words").alias("r0"), F.col("left_words").alias("l0")), _place()).alias("o"))
    beside = found.join(owners, "gram").select("gram", *_PLACE, "start", "stop", "right_words", "left_words", (_place() != F.col("o.owner")).alias("duplicate"), "o.r0", "o.l0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, other = np.asarray(batch.column("pos")), batch.column("duplicate").to_numpy(zero_copy_only=False)
            right, left = (_shared(batch.column(a), batch.column(b), reach) for a, b in (("right_words", "r0"), ("left_words", "l0")))
            start = np.where(other, pos - left, np.asarray(batch.column("start")))
            stop = np.where(other, pos + gram + right, np.asarray(batch.column("stop")))
            spans = [pa.array(x, pa.int32()) for x in (start, stop)]
            names = ["gram", *_PLACE, "duplicate"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *spans, pa.array(stop - start >= least)], names=[*names, "start", "stop", "meets"])

    schema = extended(beside.select("gram", *_PLACE, "duplicate").schema, "start int, stop int, meets boolean")
    return map_batches(beside, run, schema)


def _by_window(found: DataFrame, several: DataFrame, least: int, gram: int) -> DataFrame:
    """The place, ``duplicate`` and span of every run of exactly ``least`` words around a gram that is found again around the same one of ``several`` grams.

    Places with the same words around them count as one, so copies are not spread into windows one by one.
    """
    reach = least - gram
    around = F.xxhash64("right_words", "left_words").alias("around")
    # kinds and reaches are written, so that the shuffles of each step are gone when the next one begins
    kinds = found.join(several, "gram", "left_semi").groupBy("gram", "right_words", "left_words").agg(F.count(F.lit(1)).alias("copies"), F.min(_place()).alias("first"))
    kinds = _written(kinds, "kinds")
    left = lambda n: F.substring("left_words", F.lit(1), 4 * n)
    fits = F.filter(
        F.sequence(F.lit(0), F.lit(reach)),
        lambda n: (F.octet_length("left_words") >= 4 * n) & (F.octet_length("right_words") >= 4 * (reach - n)),
    )
    spots = kinds.select("gram", around, "copies", "first", "right_words", "left_words", F.explode(fits).alias("n"))
    window = F.xxhash64("n", left(F.col("n")), F.substring("right_words", F.lit(1), 4 * (reach - F.col("n"))))
    spots = spots.select("gram", "around", "copies", "first", "n", window.alias("window"))
    again = spots.groupBy("gram", "window").agg(F.sum("copies").alias("all"), F.min("first").alias("owner")).where("all > 1")
    met = spots.select("gram", "around", "n", "window").join(again, ["gram", "window"])
    # all windows of a place hold its gram, so together they are one span
    reaches = _written(met.groupBy("gram", "around", "owner").agg(F.min("n").alias("low"), F.max("n").alias("high")), "reaches")
    places = found.select("gram", around, *_PLACE).join(reaches, ["gram", "around"])
    return places.select(*_PLACE, (_place() != F.col("owner")).alias("duplicate"), (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + least).alias("stop"))


def passage_spans(docs: DataFrame, least: int, gram: int, key: str, text: str) -> DataFrame:
    """doc_id, u1, u2, start, stop and duplicate of what every matched place shares, extended word by word on both sides.

    Where all places of a gram share a passage with its first one, that one owns it.
    Other grams stand in several passages, and the sorted neighbours of a suffix
    need not be its nearest on both sides; their windows of ``least`` words are compared exactly.
    Owners come earlier in the order of places, so whatever is removed stays in some document.
    """
    found = matches(docs, least, gram, key, text)
    beside = _written(_beside_owner(found, least, gram), "spans")
    several = beside.where("NOT meets").select("gram").distinct()
    own = ["doc_id", "u1", "u2", "start", "stop", "duplicate"]
    exact = _by_window(found, several, least, gram)
    return beside.where("meets").select(*own).unionByName(exact.select(*own))


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start_word, n_words and duplicate of every passage of at least ``least`` words found more than once.

    Words are runs of anything but ASCII white space, and passages are as long
    as the repetition.  ``duplicate`` is false for the copy in the smallest key, which
    is to stay, and true for the others; where several documents own parts of
    a passage it may come in several rows.  Texts of fewer words, empty and NULL
    ones have no passage.  Repeated rows repeat each other.  Other columns are not read.
    """
    spans = passage_spans(docs, least, gram, key, text)
    return _merged(spans, ["doc_id", "u1", "u2", "duplicate"]).select(F.col("doc_id").alias(key), F.col("start").cast("long").alias("start_word"), (F.col("stop") - F.col("start")).cast("long").alias("n_words"), "duplicate")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word ranges and the white space after them."""
    data = text.encode()
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for a, b in sorted(spans):
        begin, end = starts[a], starts[min(b, len(starts) - 1)]
        if begin > at:
            out.append(data[at:begin])
        at = max(at, end)
    out.append(data[at:])
    return b"".join(out).decode()


def without_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every duplicate passage cut out of the texts; a document of which no word stays is left out.

    All other columns and all other rows are passed through as they are.
    """
    gone = _merged(passage_spans(docs, least, gram, key, text).where("duplicate"), ["u1", "u2"])
    spans = _written(gone.groupBy(F.col("u1").alias("_u1"), F.col("u2").alias("_u2")).agg(F.collect_set(F.struct("start", "stop")).alias("_spans")), "cuts")
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = docs.withColumns({"_a": F.xxhash64(k, t), "_b": F.xxhash64(F.lit(1), t)})
    joined = rows.join(spans, (F.col("_a") == F.col("_u1")) & (F.col("_b") == F.col("_u2")), "left").drop("_a", "_b", "_u1", "_u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, keep = batch.column(at).to_pylist(), []
            for i, spans in enumerate(batch.column("_spans").to_pylist()):
                if spans:
                    texts[i] = cut_words(texts[i], [(s["start"], s["stop"]) for s in spans])
                if not spans or _WORD.search(texts[i].encode()):
                    keep.append(i)
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield out.drop_columns(["_spans"]).take(pa.array(keep, pa.int64()))

    return map_batches(joined, run, docs.schema)
