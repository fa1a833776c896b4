"""Schema matching, relationships and stored mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableferry.functions import legacy_columns as lc
from tableferry.functions import similarity as sim
from tableferry.operators import mappings as mp
from tableferry.operators import matching as mt
from tableferry.sources import legacy
from tableferry.suite import sqltext as q
from tableferry.suite.registry import query

CATALOGS = q.with_(q.CATALOGS)


def sides(spark, d):
    return legacy.catalog_src(spark, d), legacy.catalog_tgt(spark, d)


@query(
    f"""SELECT p_partkey, round({q.name_score('a', 'b')}, 6) AS score FROM
        (SELECT p_partkey, p_name AS a, CASE p_size % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(' ', split_part(p_name, ' ', 1), ' ')
         WHEN 2 THEN '' ELSE concat(p_brand, p_type) END AS b FROM part)"""
)
def string_similarity(spark, d):
    other = F.expr(
        """CASE p_size % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(' ', split_part(p_name, ' ', 1), ' ') WHEN 2 THEN '' ELSE concat(p_brand, p_type) END"""
    )
    pairs = legacy.table(spark, d, "part").select("p_partkey", "p_name", other.alias("other"))
    return sim.with_similarity(pairs, "p_name", "other", "score").select("p_partkey", F.round("score", 6).alias("score"))


@query(
    CATALOGS
    + f"""SELECT s.table_name, s.ordinal, s.type AS source_type, t.type AS target_type, CAST({q.type_score('s.type', 't.type')} AS DOUBLE) AS score
          FROM catalog_src s JOIN catalog_tgt t ON concat('NEW_', s.table_name) = t.table_name AND s.ordinal = t.ordinal"""
)
def type_similarity(spark, d):
    src, tgt = sides(spark, d)
    pair = src.alias("s").join(
        tgt.alias("t"), (F.concat(F.lit("NEW_"), F.col("s.table_name")) == F.col("t.table_name")) & (F.col("s.ordinal") == F.col("t.ordinal"))
    )
    return pair.select(
        "s.table_name",
        "s.ordinal",
        F.col("s.type").alias("source_type"),
        F.col("t.type").alias("target_type"),
        sim.type_similarity(F.col("s.type"), F.col("t.type")).alias("score"),
    )


_COMPATIBLE = """((s.type = 'VARCHAR' AND t.type IN ('TEXT','CHAR','STRING')) OR (s.type = 'INTEGER' AND t.type IN ('BIGINT','SMALLINT','NUMERIC'))
    OR (s.type = 'REAL' AND t.type IN ('DOUBLE','FLOAT','NUMERIC')) OR (s.type = 'TEXT' AND t.type IN ('VARCHAR','CHAR','BLOB'))
    OR (s.type = 'BLOB' AND t.type IN ('TEXT','VARCHAR')))"""


def _compat(sp, tp):
    return f"""round(least(1.0, 0.5 + CASE WHEN s.type = t.type THEN 0.4 WHEN {_COMPATIBLE} THEN 0.2 ELSE 0.0 END
               + CASE WHEN {sp} <> 0 AND {sp} = {tp} THEN 0.1 ELSE 0.0 END), 2)"""


@query(
    CATALOGS
    + f"""SELECT s.table_name, s.ordinal, CAST({_compat('s.precision', 't.precision')} AS DOUBLE) AS score, {_COMPATIBLE} AS compatible
          FROM catalog_src s JOIN catalog_tgt t ON concat('NEW_', s.table_name) = t.table_name AND s.ordinal = t.ordinal"""
)
def compat_score(spark, d):
    src, tgt = sides(spark, d)
    pair = src.alias("s").join(
        tgt.alias("t"), (F.concat(F.lit("NEW_"), F.col("s.table_name")) == F.col("t.table_name")) & (F.col("s.ordinal") == F.col("t.ordinal"))
    )
    st, tt = F.col("s.type"), F.col("t.type")
    score = sim.compatibility_score(st, tt, F.col("s.precision"), F.col("t.precision"))
    return pair.select("s.table_name", "s.ordinal", F.round(score, 2).alias("score"), sim.types_compatible(st, tt).alias("compatible"))



def _pieces(x: str) -> str:
    """The name, its words and every run of three characters."""
    return (
        f"list_distinct(list_concat([{x}], list_filter(regexp_split_to_array({x}, '[^a-z0-9]+'), lambda w: w <> ''), "
        f"CASE WHEN length({x}) >= 3 THEN list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3)) ELSE [] END))"
    )


# Candidates: names that share a piece, or a name of one or two characters inside the other.
_X, _Y = "trim(lower(a))", "trim(lower(b))"
_CANDIDATE = (
    f"(len(list_intersect({_pieces(_X)}, {_pieces(_Y)})) > 0 OR (length({_X}) BETWEEN 1 AND 2 AND contains({_Y}, {_X}))"
    f" OR (length({_Y}) BETWEEN 1 AND 2 AND contains({_X}, {_Y})))"
)

def _pairs(which: str) -> str:
    """Scores of the distinct name pairs, all or those that ``which`` selects, with all type pairs."""
    return f""", sn AS (SELECT DISTINCT column_name AS a FROM catalog_src), tn AS (SELECT DISTINCT column_name AS b FROM catalog_tgt),
np AS MATERIALIZED (SELECT a, b, {q.name_score('a', 'b')} AS ns FROM sn, tn{which}),
st AS (SELECT DISTINCT type AS a FROM catalog_src), tt AS (SELECT DISTINCT type AS b FROM catalog_tgt),
tp AS MATERIALIZED (SELECT a, b, {q.type_score('a', 'b')} AS ts FROM st, tt),
sc AS MATERIALIZED (SELECT s.table_name AS st, s.column_name AS sc, t.table_name AS tt, t.column_name AS tc, t.ordinal,
       floor((CAST(np.ns AS DOUBLE) * 0.7 + CAST(tp.ts AS DOUBLE) * 0.3) * 1e6 + 0.5) / 1e6 AS score
FROM catalog_src s JOIN np ON np.a = s.column_name JOIN catalog_tgt t ON t.column_name = np.b JOIN tp ON tp.a = s.type AND tp.b = t.type)"""


_PAIRS = _pairs(f" WHERE {_CANDIDATE}")
_ALL_PAIRS = _pairs("")

_TABLES = f""", best AS (SELECT st, sc, tt, max(score) AS m FROM sc GROUP BY 1, 2, 3),
structure AS (SELECT st, tt, CAST(sum(CAST(m AS DECIMAL(10,6))) AS DOUBLE) / count(*) AS structure FROM best GROUP BY 1, 2),
cs AS (SELECT table_name AS st, count(*) AS n FROM catalog_src GROUP BY 1), ct AS (SELECT table_name AS tt, count(*) AS m FROM catalog_tgt GROUP BY 1),
tm AS (SELECT st, tt, CAST({q.name_score('st', 'tt')} AS DOUBLE) AS ns, CAST(least(n, m) AS DOUBLE) / greatest(n, m) AS ratio, structure
       FROM structure JOIN cs USING (st) JOIN ct USING (tt)),
scored AS (SELECT st AS source_table, tt AS target_table, floor(ns * 1e6 + 0.5) / 1e6 AS name_score, floor(ratio * 1e6 + 0.5) / 1e6 AS count_ratio,
       floor(structure * 1e6 + 0.5) / 1e6 AS structure_score, floor((ns * 0.4 + ratio * 0.2 + structure * 0.4) * 1e6 + 0.5) / 1e6 AS score FROM tm)"""


@query(
    CATALOGS[:-1]
    + _PAIRS
    + """SELECT st AS source_table, sc AS source_column, tt AS target_table, tc AS target_column, score FROM (
         SELECT *, row_number() OVER (PARTITION BY st, sc ORDER BY score DESC, tt, ordinal) AS rn FROM sc WHERE score > 0.5) WHERE rn = 1"""
)
def column_match(spark, d):
    return mt.column_match(*sides(spark, d))


@query(CATALOGS[:-1] + _ALL_PAIRS + _TABLES + "SELECT * FROM scored")
def table_match(spark, d):
    return mt.table_match(*sides(spark, d))


@query(
    CATALOGS[:-1]
    + _ALL_PAIRS
    + _TABLES
    + """SELECT source_table, target_table, score, row_number() OVER (PARTITION BY source_table ORDER BY score DESC, target_table) AS rank,
         CASE WHEN score > 0.9 THEN 'name very similar and structure compatible' WHEN score > 0.7 THEN 'column structure compatible'
         WHEN score > 0.5 THEN 'some similar columns' ELSE 'possible match by structure' END AS reason FROM scored WHERE score > 0.3"""
)
def table_suggestions(spark, d):
    return mt.table_suggestions(*sides(spark, d))


@query(
    CATALOGS[:-1]
    + _ALL_PAIRS
    + _TABLES
    + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_table ORDER BY score DESC, target_table) AS rn FROM scored)
           WHERE rn = 1 AND score >= 0.7)
         SELECT concat(st, '_to_', tt) AS mapping_id, st AS source_table, sc AS source_column, tt AS target_table, tc AS target_column,
         round(score * 100, 2) AS confidence, round(table_score * 100, 2) AS table_confidence FROM (
         SELECT sc.*, top.score AS table_score, row_number() OVER (PARTITION BY st, sc ORDER BY sc.score DESC, ordinal) AS rn
         FROM sc JOIN top ON st = source_table AND tt = target_table WHERE sc.score > 0.5) WHERE rn = 1"""
)
def auto_map(spark, d):
    return mt.auto_map(*sides(spark, d))


_LIKE = "(lower({a}) = lower({b}) OR contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})))"
_CONTAINED = f""", tmap AS (SELECT s.table_name AS st, min(t.table_name) AS tt FROM (SELECT DISTINCT table_name FROM catalog_src) s,
    (SELECT DISTINCT table_name FROM catalog_tgt) t WHERE {_LIKE.format(a='s.table_name', b='t.table_name')} GROUP BY 1),
cmap AS (SELECT * FROM (SELECT s.table_name AS source_table, s.column_name AS source_column, t.table_name AS target_table, t.column_name AS target_column,
    s.type AS source_type, t.type AS target_type, CAST({_compat('s.precision', 't.precision')} AS DOUBLE) AS score,
    row_number() OVER (PARTITION BY s.table_name, s.column_name ORDER BY t.ordinal) AS rn
    FROM catalog_src s JOIN tmap ON st = s.table_name JOIN catalog_tgt t ON t.table_name = tt
    WHERE {_LIKE.format(a='s.column_name', b='t.column_name')}) WHERE rn = 1)"""


@query(CATALOGS[:-1] + _CONTAINED + "SELECT * EXCLUDE (rn) FROM cmap")
def name_containment_map(spark, d):
    return mt.name_containment_map(*sides(spark, d))


@query(
    CATALOGS[:-1]
    + _CONTAINED
    + """, m AS (SELECT source_table, count(*) AS n, avg(score) AS mean FROM cmap GROUP BY 1), s AS (SELECT table_name, count(*) AS total FROM catalog_src GROUP BY 1)
         SELECT table_name AS source_table, coalesce(n, 0) AS matched_columns, total AS total_columns,
         CAST(coalesce(floor(round(mean * 100, 6) + 0.5), 85) AS BIGINT) AS confidence, round(coalesce(n, 0) / total, 4) AS matched_share
         FROM s LEFT JOIN m ON source_table = table_name"""
)
def mapping_confidence(spark, d):
    src, tgt = sides(spark, d)
    return mt.mapping_confidence(mt.name_containment_map(src, tgt), src)


@query(q.with_(q.FK_CATALOGS) + "SELECT * FROM relationships")
def fk_detect(spark, d):
    return mt.detect_foreign_keys(legacy.catalog_fk_src(spark, d), legacy.catalog_fk_tgt(spark, d))


@query(
    q.with_(q.FK_CATALOGS)
    + """, maps AS (SELECT DISTINCT concat(s.table_name, '_to_', t.table_name) AS mapping_id, s.table_name AS source_table, t.table_name AS target_table
           FROM fk_src s JOIN fk_tgt t ON ends_with(s.column_name, concat('_', lower(t.table_name), '_CODE')))
         SELECT DISTINCT mapping_id, r.source_table AS from_table, source_column, r.target_table AS to_table, target_column, join_type
         FROM maps m JOIN relationships r ON r.source_table = m.source_table OR r.target_table = m.target_table"""
)
def apply_relationships(spark, d):
    src, tgt = mt.settled(legacy.catalog_fk_src(spark, d)), legacy.catalog_fk_tgt(spark, d)
    codes = src.where("column_name LIKE '%_CODE'").select(
        F.col("table_name").alias("source_table"), F.expr("split_part(column_name, '_', 2)").alias("target_table")
    )
    maps = codes.distinct().select(F.concat_ws("_to_", "source_table", "target_table").alias("mapping_id"), "source_table", "target_table")
    return mp.apply_relationships(maps, mt.settled(mt.detect_foreign_keys(src, tgt)))


_BROKEN = """, cols AS (SELECT concat(table_name, '_map') AS mapping_id, CASE WHEN table_name IN ('T_3', 'T_7') THEN concat(table_name, '_GONE') ELSE table_name END AS source_table,
    CASE WHEN ordinal % 11 = 0 THEN concat(column_name, '_x') ELSE column_name END AS source_column,
    CASE WHEN table_name = 'T_5' THEN 'NOWHERE' ELSE concat('NEW_', table_name) END AS target_table, column_name AS target_column FROM catalog_src),
maps AS (SELECT DISTINCT mapping_id, source_table, target_table FROM cols)"""


@query(
    CATALOGS[:-1]
    + _BROKEN
    + """SELECT mapping_id, 'source table not found' AS error, source_table AS item FROM maps WHERE source_table NOT IN (SELECT table_name FROM catalog_src)
         UNION ALL SELECT mapping_id, 'target table not found', target_table FROM maps WHERE target_table NOT IN (SELECT table_name FROM catalog_tgt)
         UNION ALL SELECT mapping_id, 'source column not found', concat(source_table, '.', source_column) FROM cols
           WHERE source_table IN (SELECT table_name FROM catalog_src) AND (source_table, source_column) NOT IN (SELECT (table_name, column_name) FROM catalog_src)
         UNION ALL SELECT mapping_id, 'target column not found', concat(target_table, '.', target_column) FROM cols
           WHERE target_table IN (SELECT table_name FROM catalog_tgt) AND (target_table, target_column) NOT IN (SELECT (table_name, column_name) FROM catalog_tgt)"""
)
def mapping_errors(spark, d):
    src, tgt = (mt.settled(c) for c in sides(spark, d))
    columns = src.select(
        F.concat("table_name", F.lit("_map")).alias("mapping_id"),
        F.expr("CASE WHEN table_name IN ('T_3', 'T_7') THEN concat(table_name, '_GONE') ELSE table_name END").alias("source_table"),
        F.expr("CASE WHEN ordinal % 11 = 0 THEN concat(column_name, '_x') ELSE column_name END").alias("source_column"),
        F.expr("CASE WHEN table_name = 'T_5' THEN 'NOWHERE' ELSE concat('NEW_', table_name) END").alias("target_table"),
        F.col("column_name").alias("target_column"),
    )
    maps = columns.select("mapping_id", "source_table", "target_table").distinct()
    return mp.mapping_errors(maps, columns, src, tgt)


@query(
    CATALOGS
    + """SELECT table_name, column_name, original_type, type FROM (SELECT table_name, column_name, type,
         CASE type WHEN 'VARCHAR' THEN 'A' WHEN 'DECIMAL' THEN 'N' WHEN 'BOOLEAN' THEN 'L' ELSE type END AS original_type FROM catalog_src) WHERE length(original_type) = 1"""
)
def legacy_column_inventory(spark, d):
    original = F.expr("CASE type WHEN 'VARCHAR' THEN 'A' WHEN 'DECIMAL' THEN 'N' WHEN 'BOOLEAN' THEN 'L' ELSE type END")
    columns = legacy.catalog_src(spark, d).withColumn("original_type", original)
    return columns.where(lc.is_legacy_type(F.col("type"), F.col("original_type"))).select("table_name", "column_name", "original_type", "type")


# -- the mapping store ------------------------------------------------------


def mapping_log(spark, d):
    """Changes to stored mappings: one per event, keyed by user, errors delete."""
    return legacy.table(spark, d, "events").select(
        F.concat(F.lit("map_"), F.col("user_id")).alias("id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.concat(F.lit("SRC_"), F.col("user_id") % 7).alias("source_table"),
        F.concat(F.lit("TGT_"), F.col("event_type")).alias("target_table"),
        (F.col("value") > 10).alias("enabled"),
        F.col("value").alias("confidence"),
    )


_LOG = """SELECT concat('map_', user_id) AS id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
    concat('SRC_', user_id % 7) AS source_table, concat('TGT_', event_type) AS target_table, value > 10 AS enabled, value AS confidence FROM events"""


@query(
    f"""SELECT id, seq, source_table, target_table, enabled, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ({_LOG}))
        WHERE rn = 1 AND op <> 'delete'"""
)
def mapping_upsert(spark, d):
    return mp.latest_mappings(mapping_log(spark, d))


_UPDATES = f"""SELECT id, seq, CASE WHEN seq % 5 = 0 THEN 'put' WHEN op = 'delete' AND seq % 3 = 0 THEN 'delete' ELSE 'update' END AS op,
    CASE WHEN seq % 5 = 0 OR seq % 2 = 0 THEN source_table END AS source_table, CASE WHEN seq % 5 = 0 OR seq % 2 = 1 THEN confidence END AS confidence FROM ({_LOG})"""


@query(
    f"""WITH u AS ({_UPDATES}), r AS (SELECT id, max(seq) AS f, arg_max(op, seq) AS o FROM u WHERE op <> 'update' GROUP BY 1)
        SELECT u.id, max(seq) AS seq, arg_max(source_table, seq) FILTER (WHERE source_table IS NOT NULL) AS source_table,
        arg_max(confidence, seq) FILTER (WHERE confidence IS NOT NULL) AS confidence
        FROM u JOIN r ON u.id = r.id AND o = 'put' AND seq >= f GROUP BY 1"""
)
def mapping_partial_update(spark, d):
    log = mapping_log(spark, d).selectExpr(
        "id",
        "seq",
        "CASE WHEN seq % 5 = 0 THEN 'put' WHEN op = 'delete' AND seq % 3 = 0 THEN 'delete' ELSE 'update' END AS op",
        "CASE WHEN seq % 5 = 0 OR seq % 2 = 0 THEN source_table END AS source_table",
        "CASE WHEN seq % 5 = 0 OR seq % 2 = 1 THEN confidence END AS confidence",
    )
    return mp.merge_updates(log)


@query(f"SELECT id, source_table, target_table, enabled, confidence, 1 AS column_count, concat('c', seq % 10) AS first_column FROM ({_LOG})")
def mapping_json_roundtrip(spark, d):
    """Export every mapping version to JSON text and read it back."""
    column = F.struct(F.concat(F.lit("c"), F.col("seq") % 10).alias("source_column"), F.col("target_table").alias("target_column"))
    docs = mp.encode_mappings(
        mapping_log(spark, d).select("id", "source_table", "target_table", "enabled", "confidence", F.array(column).alias("columns"))
    )
    back = mp.decode_mappings(docs)
    return back.select(
        "id",
        "source_table",
        "target_table",
        "enabled",
        "confidence",
        F.size("columns").alias("column_count"),
        F.col("columns")[0]["source_column"].alias("first_column"),
    )
