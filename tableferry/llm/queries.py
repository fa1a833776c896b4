"""Named queries of the operators: each over its whole table."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm import clustering, jaccard, language, manifest, mixing, nearest, packing, quality, repeats, sharding, simhash, tokens, warc
from tableferry.session import fresh_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = 24
QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register(fn) if fn else register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sharding.record_sizes(table(spark, sf_dir, "documents")).withColumn("law", F.lit("key"))
    placed = sharding.assign_shards(sizes, ["doc_id"], [1.0] * SHARDS, grown="grown_shard")
    return sharding.shard_slots(placed, "shard", ["doc_id", "text_crc32", "size"])


@query
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    parser = language.train(docs.where("NOT held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), parser).select("doc_id", "held_out", "lang_pred", "score")


WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
    SELECT page_id, octet_length(encode(body)) AS payload_bytes, unhex(sha1(body))::BIT::VARCHAR AS bits,
        row_number() OVER (PARTITION BY body ORDER BY page_id NULLS LAST) AS n, min(page_id) OVER (PARTITION BY body) AS first
    FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
    list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (1 + list_sum(list_transform(range(5), lambda k: substr(bits, (5 * i + k + 1)::BIGINT, 1)::INT * (16 >> k::INT))))::BIGINT, 1)), lambda a, b: a || b) AS payload_digest,
    CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN n > 1 THEN first END AS refers_to
FROM d
"""


@query(sql=WARC_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, sf_dir, "documents"))
    mixed = mixing.pareto_mix(sized, mixing.source_targets(sized, (3, 1, 2), 1.5, 2.0))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


QUALITY_SQL = r"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
),
spots AS (SELECT doc_id, t, words, unnest(range(1, len(words) - 1)) AS i FROM w),
windows AS (SELECT doc_id, t, i, list_aggregate(words[i : i + 2], 'string_agg', ' ') AS win FROM spots),
twice AS (SELECT doc_id, t, i, count(*) OVER (PARTITION BY doc_id, t, win) AS n FROM windows),
covered AS (SELECT doc_id, t, count(DISTINCT j) AS c FROM (SELECT doc_id, t, unnest([i, i + 1, i + 2]) AS j FROM twice WHERE n > 1) GROUP BY ALL),
m AS (
    SELECT w.doc_id, w.t, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(w.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(c, 0)::BIGINT AS n_repeat_words, len(string_split(w.t, chr(10))) AS all_lines,
        len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) AS bare,
        len(list_filter(string_split(w.t, chr(10)), lambda l: regexp_matches(l, '^[ \t]*[-*•]'))) AS bullets,
        len(list_filter(string_split(w.t, chr(10)), lambda l: regexp_matches(l, '(\.\.\.|…)[ \t]*$'))) AS dots
    FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id AND w.t = covered.t
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 4 * n_symbols > n_words OR 3 * n_dup_lines > all_lines
        OR 10 * bare > 4 * n_words OR 10 * bullets > 9 * all_lines OR 10 * dots > 3 * all_lines) AS kept
FROM b
"""


@query(sql=QUALITY_SQL)
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


NEAREST_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@query(sql=NEAREST_SQL)
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, most=2)


@query
def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), TOKENIZER, 512)


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds unrolled: every vector against every centroid, nearest by (distance, number)."""
    parts = [
        """v AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: abs(floor(256 * x::DOUBLE)) > 16777216)) = 0
)""",
        f"""c0 AS (
    SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), vec_id NULLS LAST, v) - 1)::INT AS cluster, v AS c FROM v QUALIFY cluster < {k}
)""",
    ]
    for r in range(1, rounds + 2):
        parts.append(
            f"""a{r} AS (
    SELECT rid, vec_id, v, cluster, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS distance
    FROM v, c{r - 1} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1
)"""
        )
        if r <= rounds:
            parts.append(
                f"""u{r} AS (SELECT cluster, i, sum(v[i]::HUGEINT) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL),
c{r} AS (
    SELECT cluster, list((CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END)::BIGINT ORDER BY i) AS c FROM u{r} GROUP BY cluster
    UNION ALL SELECT cluster, c FROM c{r - 1} WHERE cluster NOT IN (SELECT cluster FROM a{r})
)"""
            )
    last = rounds + 1
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT a.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
    (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{last} a JOIN c{rounds} c ON a.cluster = c.cluster
"""
    )


@query(sql=_clustering_sql())
def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
g AS (
    SELECT rid, doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[]
        ELSE list_distinct(list_transform(range(1, greatest(len(words) - 1, 2)), lambda i: array_to_string(words[i : i + 2], ' '))) END AS g
    FROM w
),
s AS (SELECT rid, len(g) AS n, unnest(g) AS sh FROM g),
p AS (
    SELECT a.rid AS x, b.rid AS y, count(*) AS common, any_value(a.n) AS nx, any_value(b.n) AS ny
    FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
    GROUP BY a.rid, b.rid
),
l AS (SELECT x, y FROM p WHERE 100 * common >= 90 * (nx + ny - common)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT rid, rid FROM g UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT r.a AS rid, min(g.doc_id) AS component_id FROM r JOIN g ON r.b = g.rid GROUP BY r.a),
d AS (SELECT a AS rid, count(*) AS n_links FROM e GROUP BY a)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, CASE WHEN len(g.g) > 0 THEN c.component_id ELSE g.doc_id END AS component_id,
    coalesce(d.n_links, 0)::BIGINT AS n_links
FROM g JOIN c ON g.rid = c.rid LEFT JOIN d ON g.rid = d.rid
"""


@query(sql=JACCARD_SQL)
def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, threshold=Fraction(9, 10))


@query
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    after = F.when(chosen, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    return manifest.manifest(docs, after).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "source")
