"""WARC archives as chunked record tables: written, read back and digested chunk by chunk."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm.arrow import map_batches
from tableferry.session import ensure_checkpoints

#: Fixed values of the WARC format and of base32.
VERSION = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CHUNK = 1 << 20
STAMP = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """The upper-case base32 SHA-1 of a binary column, without prefix."""
    hexed = F.sha1(data)
    digits = []
    for part in range(4):  # 40 bits at a time
        bits = F.conv(F.substring(hexed, 10 * part + 1, 10), 16, 10).cast("long")
        digits += [F.substring(F.lit(BASE32), (F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*digits)


def record_table(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", smallest: int = 0) -> DataFrame:
    """One row per record to write: key, url, payload_bytes, payload_digest, record_type, refers_to, and the payload of responses.

    Of the pages with equal payloads of at least ``smallest`` bytes, the one with
    the smallest key (then the smallest url) is the response, and the others
    revisit it.  Equal payloads meet as one in each task before the shuffle, so
    a payload found very often takes one place, and each payload is shuffled once.
    A NULL payload is empty, a NULL key sorts last; fully equal rows are one
    response and revisits of it.
    """
    ensure_checkpoints(pages.sparkSession)
    body = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    p = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), body.alias("body"))
    p = p.withColumn("payload_digest", base32_sha1(F.col("body"))).withColumn("payload_bytes", F.octet_length("body").cast("long"))
    own = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("url").isNull().alias("no_url"), F.col("url").alias("url"))
    large = p.where(F.col("payload_bytes") >= smallest)
    firsts = large.groupBy("payload_digest", "payload_bytes").agg(F.min(own).alias("first"), F.any_value("body").alias("body"))
    responses = firsts.select(F.col("first.key").alias("key"), F.col("first.url").alias("url"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(p.schema["key"].dataType).alias("refers_to"), "body")
    same = large.groupBy("key", "url", "payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    origin = same.groupBy("payload_digest", "payload_bytes").agg(F.min(own).alias("first"))
    others = same.join(origin, ["payload_digest", "payload_bytes"])
    first = F.col("key").eqNullSafe(F.col("first.key")) & F.col("url").eqNullSafe(F.col("first.url"))
    others = others.withColumn("n", F.col("n") - first.cast("long")).where("n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    revisits = others.select("key", "url", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("first.key").alias("refers_to"), F.lit(None).cast("binary").alias("body"))
    out = responses.unionByName(revisits)
    if smallest > 0:
        small = p.where(F.col("payload_bytes") < smallest)
        out = out.unionByName(small.select("key", "url", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(p.schema["key"].dataType).alias("refers_to"), "body"))
    return out


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of (record, chunk number): the records with ``chunk_no`` from 1, ``chunks`` and ``block``.

    A payload is cut into blocks of ``chunk`` bytes, and once more inside
    every text that looks like the start of a record, so that no block holds one.
    A record without payload has one empty block.
    """
    body = F.coalesce(F.col("body"), F.lit(b""))
    size = F.octet_length(body)
    grid = F.transform(F.sequence(F.lit(0), F.greatest((size - 1) / chunk, F.lit(0)).cast("int")), lambda i: i * chunk)
    # byte positions of look-alikes: Latin-1 keeps bytes and characters one to one
    looks = F.split(F.decode(body, "ISO-8859-1"), r"(?<=WARC/1)(?=\.1\r\n)")
    inner = F.aggregate(
        F.slice(looks, 1, F.size(looks) - 1), F.array(F.lit(0)),
        lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(s))),
    )
    held = F.locate("WARC/1.1\r\n", F.decode(body, "ISO-8859-1")) > 0
    cuts = F.when(held, F.array_sort(F.array_distinct(F.concat(grid, inner)))).otherwise(grid)
    rows = records.withColumn("_cuts", cuts)
    ends = F.get("_cuts", F.col("_i") + 1)
    rows = rows.select("*", F.posexplode("_cuts").alias("_i", "_at"))
    block = F.substring(body, F.col("_at") + 1, (F.coalesce(ends, size) - F.col("_at")).cast("int"))
    return rows.select(*[c for c in records.columns if c != "body"], (F.col("_i") + 1).alias("chunk_no"), F.size("_cuts").alias("chunks"), block.alias("block"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _name(key: Column) -> Column:
    """A record is named by its payload and its page, so a page that occurs with several payloads stays several records."""
    return F.concat(F.lit("<urn:page:"), F.col("payload_digest"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def warc_lines(chunks: DataFrame) -> DataFrame:
    """One column ``value``: each chunk as a WARC/1.1 record without its last line end.

    The first chunk of a record is the response or revisit, with the HTTP header
    before the payload; later chunks are its continuation segments.
    """
    name = _name(F.col("key"))
    first = F.col("chunk_no") == 1
    whole = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), whole, F.lit("\r\n\r\n"))
    head = F.when(first, http).otherwise(F.lit(""))
    length = F.octet_length(head) + F.octet_length("block")
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]+", "%20")
    several = F.col("chunks") > 1
    fields = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.when(first, F.col("record_type")).otherwise(F.lit("continuation"))),
        _line("WARC-Record-ID", F.when(first, name).otherwise(F.concat(F.rtrim(name, F.lit(">")), F.lit("#"), F.col("chunk_no").cast("string"), F.lit(">")))),
        _line("WARC-Target-URI", uri),
        _line("WARC-Date", F.lit(STAMP)),
        F.when(first, _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))).otherwise(F.lit("")),
        F.when(F.col("record_type") == "revisit", F.concat(
            _line("WARC-Profile", F.lit(PROFILE)),
            _line("WARC-Refers-To", _name(F.col("refers_to"))),
        )).otherwise(F.lit("")),
        F.when(several, _line("WARC-Segment-Number", F.col("chunk_no").cast("string"))).otherwise(F.lit("")),
        F.when(several & ~first, _line("WARC-Segment-Origin-ID", name)).otherwise(F.lit("")),
        F.when(several & (F.col("chunk_no") == F.col("chunks")), _line("WARC-Segment-Total-Length", (F.octet_length(http) + F.col("payload_bytes")).cast("string"))).otherwise(F.lit("")),
        F.when(first, _line("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(F.lit("")),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        head,
    )
    return chunks.select(F.concat(F.encode(fields, "UTF-8"), F.col("block"), F.encode(F.lit("\r\n"), "UTF-8")).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK, smallest: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a WARC record per page as gzip archives under ``path``, one for each task."""
    lines = warc_lines(chunked(record_table(pages, key, url, html, smallest), chunk))
    lines.write.mode("overwrite").option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the archives: origin, record_type, refers_to, digest, chunk_no, chunks known to be one, payload_bytes, block.

    Archives are read as text parted at record starts, so a long record is
    never held whole.  Raises where a block is shorter than its header says.
    """
    raw = spark.read.option("lineSep", VERSION).text(path).where("value <> ''")
    head = F.substring_index("value", "\r\n\r\n", 1)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))
    rows = raw.select(head.alias("head"), F.col("value").cast("binary").alias("data"))
    rows = rows.select(
        "data", (F.octet_length("head") + 4).alias("at"), field("WARC-Type").alias("kind"), field("WARC-Record-ID").alias("id"), field("WARC-Refers-To").alias("refers"),
        field("WARC-Payload-Digest").alias("digest"), field("WARC-Segment-Number").cast("int").alias("segment"), field("WARC-Segment-Origin-ID").alias("origin"),
        field("Content-Length").cast("int").alias("length"),
    )
    block = F.substring(F.col("data"), F.col("at") + 1, F.col("length"))
    rows = rows.select("kind", "refers", "digest", "segment", "length", F.coalesce("origin", "id").alias("record"), block.alias("block"))
    whole = F.when(F.octet_length("block") == F.col("length"), F.col("block")).otherwise(F.raise_error(F.lit("a WARC block is shorter than its Content-Length")).cast("binary"))
    rows = rows.withColumn("block", whole)
    http = F.when(F.col("kind").isin("response", "revisit"), F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1))
    rows = rows.withColumn("_http", http)
    payload = F.when(F.col("_http").isNull(), F.col("block")).otherwise(F.substring(F.col("block"), F.octet_length("_http") + 5, F.col("length")))
    told = F.regexp_extract("_http", r"(?m)^Content-Length: (\d+)", 1).cast("long")
    return rows.select(
        "record", "kind", "refers",
        F.regexp_replace("digest", "^sha1:", "").alias("digest"), "segment", told.alias("payload_bytes"), payload.alias("payload"),
    )


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows in order of record and chunk number: one row per record, its digest carried from chunk to chunk."""
    names = ["record", "kind", "refers", "digest", "payload_bytes", "seen_bytes", "computed"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    first, state, seen = None, hashlib.sha1(), 0

    def row() -> pa.RecordBatch:
        values = [*first, seen, base64.b32encode(state.digest()).decode()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("record", "kind", "refers", "digest", "payload_bytes")]
        for i, chunk in enumerate(batch.column("payload")):
            if columns[1][i] != "continuation":
                if first is not None:
                    yield row()
                first, state, seen = [c[i] for c in columns], hashlib.sha1(), 0
            data = chunk.as_buffer()
            state.update(data)
            seen += len(data)
    if first is not None:
        yield row()


def read_records(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record in the archives.

    The digest of a response is computed from what was read.  A record of one
    block is digested where it is read; the chunks of a longer one are
    brought together in order and pass one by one through a running digest.
    Raises where a digest or length differs from what the record says.
    """
    chunks = read_chunks(spark, path)
    single = chunks.where("segment IS NULL")
    one = single.withColumn("computed", base32_sha1(F.col("payload"))).withColumn("seen_bytes", F.octet_length("payload").cast("long"))
    cols = ["record", "kind", "refers", "digest", "payload_bytes", "seen_bytes", "computed"]
    several = chunks.where("segment IS NOT NULL").repartition("record").sortWithinPartitions("record", "segment")
    schema = "record string, kind string, refers string, digest string, payload_bytes long, seen_bytes long, computed string"
    rows = one.select(*cols).unionByName(map_batches(several, _stream_digests, schema))
    fine = (F.col("kind") == "revisit") | ((F.col("computed") == F.col("digest")) & (F.col("seen_bytes") == F.col("payload_bytes")))
    checked = F.when(fine, F.when(F.col("kind") == "revisit", F.col("digest")).otherwise(F.col("computed"))).otherwise(F.raise_error(F.lit("a WARC payload differs from its digest")))
    page = lambda name: F.nullif(F.regexp_extract(name, "<urn:page:[A-Z2-7]{32}:(.*)>", 1), F.lit("")).cast(key_type)
    return rows.select(
        page("record").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), F.col("kind").alias("record_type"),
        page("refers").alias("refers_to"),
    )
