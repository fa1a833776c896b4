"""Schema matching: which source table and column corresponds to which target.

Every step works on distinct names rather than on catalog rows.  Equal and
contained names are found by equi-joins.  Columns are matched over a whole
catalog among names that share a piece (the whole name, a word or three
characters in a row) with each other, found by an inverted index of pieces;
frequent pieces are spread over several tasks.  Tables are matched by all
their columns: every distinct source name meets every distinct target name
once, block against block, and only the best column per table leaves a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableferry.functions.similarity import (
    AUTO_MAP_THRESHOLD,
    COLUMN_THRESHOLD,
    COUNT_WEIGHT,
    NAME_WEIGHT,
    SAME_GROUP,
    STRUCTURE_WEIGHT,
    SUGGESTION_THRESHOLD,
    TABLE_NAME_WEIGHT,
    TYPE_WEIGHT,
    compatibility_score,
    plain_name,
    plain_similarity,
    similarity_reason,
    six_digits,
    type_group,
    type_similarity,
    with_similarity,
)
from tableferry.session import ensure_checkpoints

SPREAD_ROWS = 4096
SOURCE_BLOCKS, TARGET_BLOCKS = 16, 64
ONE = 1_000_000  # a score of 1 in whole millionths


def settled(catalog: DataFrame) -> DataFrame:
    """A catalog written once to the shared folder: matching reads it many times."""
    ensure_checkpoints(catalog.sparkSession)
    return catalog.checkpoint()


def name_pieces(name: Column) -> Column:
    """The pieces of a plain name: the name itself, its words (runs of a-z and 0-9) and every run of three characters."""
    words = F.filter(F.split(name, "[^a-z0-9]+"), lambda w: w != "")
    size = F.char_length(name)
    threes = F.transform(F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))), lambda i: F.substring(name, i, 3))
    return F.array_distinct(F.concat(F.array(name), words, F.when(size >= 3, threes).otherwise(F.array().cast("array<string>"))))


def _short_pieces(name: Column) -> Column:
    """Every substring of one or two characters."""
    size = F.char_length(name)
    ones = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(name, i, 1))
    twos = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.substring(name, i, 2))
    return F.filter(F.array_distinct(F.concat(ones, twos)), lambda p: p != "")


def _index(names: DataFrame, col: str, short_kind: str, sub_kind: str) -> DataFrame:
    """(kind, piece, name): kind ``p`` for shared pieces; a name of one or two characters under ``short_kind``, its
    one- and two-character substrings under ``sub_kind``."""
    c = F.col(col)
    short = F.when(F.char_length(c).between(1, 2), F.array(c)).otherwise(F.array().cast("array<string>"))
    tagged = F.concat(
        F.transform(name_pieces(c), lambda p: F.struct(F.lit("p").alias("kind"), p.alias("piece"))),
        F.transform(short, lambda p: F.struct(F.lit(short_kind).alias("kind"), p.alias("piece"))),
        F.transform(_short_pieces(c), lambda p: F.struct(F.lit(sub_kind).alias("kind"), p.alias("piece"))),
    )
    return names.select(col, F.explode(tagged).alias("k")).select(F.col("k.kind").alias("kind"), F.col("k.piece").alias("piece"), col)


def candidate_names(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """Distinct (name, t_name) that share a piece, or where a name of one or two characters stands inside the other.

    An inverted index of pieces on both sides, joined by piece.  A piece that
    very many target names hold is cut into parts by a hash of the name and the
    source rows of that piece are copied to every part, so no task holds a
    frequent piece's whole list.
    """
    left = _index(wanted.select("name").distinct(), "name", "q", "r")
    right = _index(offered.select("t_name").distinct(), "t_name", "r", "q")
    crowd = right.groupBy("kind", "piece").agg(F.ceil(F.count(F.lit(1)) / SPREAD_ROWS).cast("int").alias("parts"))
    right = right.join(crowd, ["kind", "piece"]).withColumn("part", F.pmod(F.xxhash64("t_name"), F.col("parts")).cast("int"))
    left = left.join(crowd, ["kind", "piece"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return left.join(right, ["kind", "piece", "part"]).select("name", "t_name").distinct()


def best_matches(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Best target column for every distinct source ``(name, type)`` among its candidates.

    Candidates are the target columns whose plain name shares a piece with the
    source name (see :func:`candidate_names`); each is scored by name
    (built-in ``levenshtein``) and type.  Returns ``name, type, score,
    tgt_table, tgt_ordinal, tgt_column``: one row per source with a
    candidate.  Ties go to the first target in (table, ordinal) order.
    """
    wanted = src.select(plain_name(F.col("column_name")).alias("name"), F.upper("type").alias("type")).distinct()
    # Of the target columns with one name and type only the first can win.
    offered = (
        tgt.groupBy(plain_name(F.col("column_name")).alias("t_name"), F.upper("type").alias("t_type"))
        .agg(F.min(F.struct("table_name", "ordinal", "column_name")).alias("first"))
        .select(
            "t_name",
            "t_type",
            F.col("first.table_name").alias("t_table"),
            F.col("first.ordinal").alias("t_ordinal"),
            F.col("first.column_name").alias("t_column"),
        )
    )
    names = candidate_names(wanted, offered)
    names = names.withColumn("ns", plain_similarity(F.col("name"), F.col("t_name")))
    scored = (
        wanted.join(names, "name")
        .join(offered, "t_name")
        .select(
            "name",
            "type",
            "t_table",
            "t_ordinal",
            "t_column",
            six_digits(F.col("ns") * NAME_WEIGHT + type_similarity(F.col("type"), F.col("t_type")) * TYPE_WEIGHT).alias("score"),
        )
    )
    best = scored.groupBy("name", "type").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), F.col("t_table").alias("tbl"), F.col("t_ordinal").alias("ord"), F.col("t_column").alias("col"))).alias("b")
    )
    return best.select(
        "name",
        "type",
        (-F.col("b.neg")).alias("score"),
        F.col("b.tbl").alias("tgt_table"),
        F.col("b.ord").alias("tgt_ordinal"),
        F.col("b.col").alias("tgt_column"),
    )


def placed_columns(tgt: DataFrame) -> DataFrame:
    """``t_table, t_name, t_type, t_column, place``: the first column of every table with a name and type, numbered in the table's order."""
    # Of a table's columns with one name and type only the first can win.
    first = tgt.groupBy(
        F.col("table_name").alias("t_table"), plain_name(F.col("column_name")).alias("t_name"), F.upper("type").alias("t_type")
    ).agg(F.min(F.struct("ordinal", "column_name")).alias("first"))
    place = F.row_number().over(Window.partitionBy("t_table").orderBy("first"))
    return first.where("t_name IS NOT NULL").select("t_table", "t_name", "t_type", F.col("first.column_name").alias("t_column"), place.alias("place"))


def best_per_table(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Best column of every target table for every distinct source ``(name, type)``.

    Returns ``name, type, tgt_table, score, place``, the place being that of
    :func:`placed_columns`; ties go to the first column of the table.

    All pairs of distinct names are scored, each once: names are dealt into
    blocks by a hash, every block of source names meets every block of target
    names in a task of its own, and a target name carries the tables that have it
    (cut into parts when very many do).  A pair is folded into its best by
    ``score and place`` as one number while the blocks meet, so no pair is kept.
    """
    wanted = src.select(plain_name(F.col("column_name")).alias("name"), F.upper("type").alias("type")).distinct().where("name IS NOT NULL")
    placed = placed_columns(tgt)
    crowd = placed.groupBy("t_name").agg(F.ceil(F.count(F.lit(1)) / SPREAD_ROWS).alias("parts"))
    offered = (
        placed.join(crowd, "t_name")
        .groupBy("t_name", "t_type", F.pmod(F.xxhash64("t_table"), F.col("parts")).alias("part"))
        .agg(F.collect_list(F.struct("t_table", "place")).alias("owners"))
    )
    tasks = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = wanted.select(
        "name",
        "type",
        type_group(F.col("type")).alias("kind"),
        F.pmod(F.xxhash64("name"), F.lit(SOURCE_BLOCKS)).cast("int").alias("sb"),
        F.explode(F.sequence(F.lit(0), F.lit(TARGET_BLOCKS - 1))).alias("tb"),
    ).repartition(tasks, "sb", "tb")
    right = offered.select(
        "t_name",
        "t_type",
        type_group(F.col("t_type")).alias("t_kind"),
        "owners",
        F.explode(F.sequence(F.lit(0), F.lit(SOURCE_BLOCKS - 1))).alias("sb"),
        F.pmod(F.xxhash64("t_name", "part"), F.lit(TARGET_BLOCKS)).cast("int").alias("tb"),
    ).repartition(tasks, "sb", "tb")
    alike = F.when(F.col("type") == F.col("t_type"), 1.0).when(F.col("kind") == F.col("t_kind"), SAME_GROUP).otherwise(0.0)
    millionths = F.floor((plain_similarity(F.col("name"), F.col("t_name")) * NAME_WEIGHT + alike * TYPE_WEIGHT) * 1e6 + 0.5)
    scored = left.join(right, ["sb", "tb"]).select("name", "type", F.shiftleft(ONE - millionths, 32).alias("below"), F.explode("owners").alias("o"))
    best = scored.groupBy("name", "type", F.col("o.t_table").alias("tgt_table")).agg(F.min(F.col("below") + F.col("o.place")).alias("code"))
    return best.select(
        "name",
        "type",
        "tgt_table",
        ((ONE - F.shiftright("code", 32)) / 1e6).alias("score"),
        F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place"),
    )


def column_match(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Best target column among its candidates of every source column, where the score exceeds 0.5.

    Several source columns may share a target.  Confidence is the score x 100.
    """
    src, tgt = settled(src), settled(tgt)
    best = best_matches(src, tgt).where(F.col("score") > COLUMN_THRESHOLD)
    keyed = src.select(
        F.col("table_name").alias("source_table"),
        F.col("column_name").alias("source_column"),
        plain_name(F.col("column_name")).alias("name"),
        F.upper("type").alias("type"),
    )
    return keyed.join(best, ["name", "type"]).select(
        "source_table",
        "source_column",
        F.col("tgt_table").alias("target_table"),
        F.col("tgt_column").alias("target_column"),
        "score",
    )


def _table_scores(src: DataFrame, best: DataFrame, tgt: DataFrame) -> DataFrame:
    per_column = src.select(
        F.col("table_name").alias("source_table"), plain_name(F.col("column_name")).alias("name"), F.upper("type").alias("type")
    ).join(best, ["name", "type"])
    structure = per_column.groupBy("source_table", F.col("tgt_table").alias("target_table")).agg(
        (F.sum(F.col("score").cast("decimal(10,6)")).cast("double") / F.count(F.lit(1))).alias("structure")
    )
    n_src = src.groupBy(F.col("table_name").alias("source_table")).agg(F.count(F.lit(1)).alias("n_src"))
    n_tgt = tgt.groupBy(F.col("table_name").alias("target_table")).agg(F.count(F.lit(1)).alias("n_tgt"))
    scored = with_similarity(
        structure.join(n_src, "source_table").join(n_tgt, "target_table"), "source_table", "target_table", "name_score"
    )
    name_score = F.col("name_score")
    ratio = F.coalesce(F.try_divide(F.least("n_src", "n_tgt"), F.greatest("n_src", "n_tgt")), F.lit(0.0))
    total = name_score * TABLE_NAME_WEIGHT + ratio * COUNT_WEIGHT + F.col("structure") * STRUCTURE_WEIGHT
    return scored.select(
        "source_table",
        "target_table",
        six_digits(name_score).alias("name_score"),
        six_digits(ratio).alias("count_ratio"),
        six_digits(F.col("structure")).alias("structure_score"),
        six_digits(total).alias("score"),
    )


def table_match(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Score of every pair of tables: name, column count and column structure.

    Structure averages over source columns only, so it is not symmetric.
    """
    src, tgt = settled(src), settled(tgt)
    return _table_scores(src, best_per_table(src, tgt), tgt)


def table_suggestions(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Ranked target tables per source table, with scores above 0.3."""
    order = Window.partitionBy("source_table").orderBy(F.desc("score"), "target_table")
    return (
        table_match(src, tgt)
        .where(F.col("score") > SUGGESTION_THRESHOLD)
        .select(
            "source_table",
            "target_table",
            "score",
            F.row_number().over(order).cast("bigint").alias("rank"),
            similarity_reason(F.col("score")).alias("reason"),
        )
    )


def auto_map(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Tables whose best suggestion reaches 0.7, with their column mappings."""
    src, tgt = settled(src), settled(tgt)
    best = best_per_table(src, tgt)
    winners = (
        _table_scores(src, best, tgt)
        .groupBy("source_table")
        .agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("target_table").alias("tbl"))).alias("b"))
        .select("source_table", F.col("b.tbl").alias("target_table"), (-F.col("b.neg")).alias("table_score"))
        .where(F.col("table_score") >= AUTO_MAP_THRESHOLD)
    )
    columns = src.select(
        F.col("table_name").alias("source_table"),
        F.col("column_name").alias("source_column"),
        plain_name(F.col("column_name")).alias("name"),
        F.upper("type").alias("type"),
    )
    places = placed_columns(tgt).select(F.col("t_table").alias("target_table"), "place", F.col("t_column").alias("target_column"))
    return (
        columns.join(winners, "source_table")
        .join(best.withColumnRenamed("tgt_table", "target_table"), ["name", "type", "target_table"])
        .where(F.col("score") > COLUMN_THRESHOLD)
        .join(places, ["target_table", "place"])
        .select(
            F.concat_ws("_to_", "source_table", "target_table").alias("mapping_id"),
            "source_table",
            "source_column",
            "target_table",
            "target_column",
            F.round(F.col("score") * 100, 2).alias("confidence"),
            F.round(F.col("table_score") * 100, 2).alias("table_confidence"),
        )
    )


def substrings(c: Column) -> Column:
    """All distinct substrings of a name, the name itself included."""
    size = F.char_length(c)
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), size),
                lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(c, i, n)),
            )
        )
    )


def contained_names(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Distinct ``(a, b)`` where one name contains the other, by equi-joins.

    A name contains another exactly when the other is one of its substrings, so
    each side's substrings are joined to the other side's names.
    """
    x = left.select(F.col(a)).where(F.col(a) != "").distinct()
    y = right.select(F.col(b)).where(F.col(b) != "").distinct()
    down = x.select(a, F.explode(substrings(F.col(a))).alias("piece")).join(y, F.col("piece") == F.col(b)).select(a, b)
    up = y.select(b, F.explode(substrings(F.col(b))).alias("piece")).join(x, F.col("piece") == F.col(a)).select(a, b)
    return down.unionByName(up).distinct()


def name_containment_map(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Map by equal or contained names: first target table, then first column.

    Returns one row per mapped source column with its compatibility score.
    """
    src, tgt = settled(src), settled(tgt)
    s_tables = src.select("table_name").distinct().select(F.col("table_name").alias("source_table"), F.lower("table_name").alias("s_key"))
    t_tables = tgt.select("table_name").distinct().select(F.col("table_name").alias("target_table"), F.lower("table_name").alias("t_key"))
    pairs = contained_names(s_tables, "s_key", t_tables, "t_key")
    tables = (
        s_tables.join(pairs, "s_key").join(t_tables, "t_key").groupBy("source_table").agg(F.min("target_table").alias("target_table"))
    )
    s_cols = src.select(
        F.col("table_name").alias("source_table"),
        F.col("column_name").alias("source_column"),
        F.lower("column_name").alias("s_name"),
        F.col("type").alias("source_type"),
        F.col("precision").alias("source_precision"),
    ).join(tables, "source_table")
    t_cols = tgt.select(
        F.col("table_name").alias("target_table"),
        F.col("column_name").alias("target_column"),
        F.lower("column_name").alias("t_name"),
        F.col("type").alias("target_type"),
        F.col("precision").alias("target_precision"),
        "ordinal",
    )
    names = contained_names(s_cols, "s_name", t_cols, "t_name")
    first = (
        s_cols.join(names, "s_name")
        .join(t_cols, ["target_table", "t_name"])
        .groupBy("source_table", "target_table", "source_column", "source_type", "source_precision")
        .agg(F.min(F.struct("ordinal", "target_column", "target_type", "target_precision")).alias("t"))
    )
    return first.select(
        "source_table",
        "source_column",
        "target_table",
        F.col("t.target_column").alias("target_column"),
        "source_type",
        F.col("t.target_type").alias("target_type"),
        F.round(
            compatibility_score(F.col("source_type"), F.col("t.target_type"), F.col("source_precision"), F.col("t.target_precision")), 2
        ).alias("score"),
    )


def mapping_confidence(mapped: DataFrame, src: DataFrame) -> DataFrame:
    """Confidence per source table: mean column score, and share of columns mapped.

    A table without any mapped column gets the default of 85.
    """
    scores = mapped.groupBy("source_table").agg(F.count(F.lit(1)).alias("matched"), F.avg("score").alias("mean"))
    totals = src.groupBy(F.col("table_name").alias("source_table")).agg(F.count(F.lit(1)).alias("total"))
    return totals.join(scores, "source_table", "left").select(
        "source_table",
        F.coalesce("matched", F.lit(0)).cast("bigint").alias("matched_columns"),
        F.col("total").alias("total_columns"),
        F.coalesce(F.floor(F.round(F.col("mean") * 100, 6) + 0.5), F.lit(85)).cast("bigint").alias("confidence"),
        F.round(F.coalesce("matched", F.lit(0)) / F.col("total"), 4).alias("matched_share"),
    )


def detect_foreign_keys(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Likely foreign keys by naming convention.

    The column name ends in ID and contains the target table's name, the types
    are alike, and the target column is a key.  Table names are looked up among
    the substrings of the column names, so no pairs are tried in vain.
    """
    ids = src.where(F.upper("column_name").endswith("ID")).select(
        F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), F.col("type").alias("source_type")
    )
    pieces = ids.select("source_column").distinct().select(
        "source_column", F.explode(substrings(F.lower("source_column"))).alias("piece")
    )
    keys = tgt.where("is_pk").select(
        F.lower("table_name").alias("piece"),
        F.col("table_name").alias("target_table"),
        F.col("column_name").alias("target_column"),
        F.col("type").alias("target_type"),
    )
    named = pieces.join(keys, "piece").drop("piece")
    return (
        ids.join(named, "source_column")
        .where(type_similarity(F.col("source_type"), F.col("target_type")) >= SAME_GROUP)
        .select("source_table", "source_column", "target_table", "target_column", F.lit("INNER").alias("join_type"))
    )


def combined_columns(catalog: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """The column lists of several tables as one, names prefixed by their table."""
    if tables:
        catalog = catalog.where(F.col("table_name").isin(tables))
    return catalog.select(F.concat_ws(".", "table_name", "column_name").alias("column_name"), "type", "ordinal")
