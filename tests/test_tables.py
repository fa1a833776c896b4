import json
import random

import pytest
from pyspark.sql import functions as F

from tableferry.functions.dialects import Rule
from tableferry.operators import ddl, loading, numbering, restructure
from tableferry.operators import mappings as mp
from tableferry.plans.migrate import FolderTarget, migrate
from tableferry.plans.model import ColumnMapping, JoinCondition, MigrationPlan, TableMapping
from tableferry.session import fresh_path, shared_folder
from tableferry.sources import catalog, tables
from tableferry.streaming.replay import batch_counts, replay, replayed


def test_rename_order_and_clash(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert restructure.rename_columns(df, {"c": "x", "a": "b"}).columns == ["x", "b"]
    assert [tuple(r) for r in restructure.rename_columns(df, {"c": "x", "a": "b"}).collect()] == [(3, 1)]
    assert restructure.rename_columns(df, {}).columns == ["a", "b", "c"]


def test_join_needs_two_tables_and_merges_conditions(spark):
    with pytest.raises(ValueError):
        restructure.join_chain({}, TableMapping("m", ("a",), "t", ()))
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, n int, v string")
    b = spark.createDataFrame([(1, 1, "p"), (1, 2, "q")], "k int, n int, w string")
    mapping = TableMapping(
        "m", ("a", "b"), "t", (ColumnMapping("a.v", "v", direct=True), ColumnMapping("b.w", "w", direct=True)), "many-to-one",
        (JoinCondition("a", "k", "b", "k"), JoinCondition("a", "n", "b", "n")),
    )
    got = restructure.compile_mapping({"a": a, "b": b}, mapping)
    assert sorted(tuple(r) for r in got.collect()) == [("x", "p"), ("y", "q")]


def test_split_then_join_is_the_input(spark):
    df = spark.range(50).selectExpr("id", "id % 7 AS a", "id % 3 AS b")
    parts = restructure.split_table(df, {"x": ["id", "a"], "y": ["id", "b"]})
    assert parts["x"].join(parts["y"], "id").select("id", "a", "b").exceptAll(df).count() == 0
    with pytest.raises(ValueError):
        restructure.split_table(df, {"x": ["id"]})


def test_lookup_never_multiplies_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (9,)], "k int")
    lookup = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    got = restructure.lookup_table(df, "k", lookup, "k", "v", "out", "?").orderBy("k")
    assert [tuple(r) for r in got.collect()] == [(1, "a"), (2, "c"), (9, "?")]


def test_keep_computed_keeps_nulls_and_types(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "id int, v string").withColumn("ok", F.col("id") != 3)
    got = restructure.keep_computed(df, F.col("ok"))
    assert got.columns == ["id", "v", "ok"] and sorted(r.id for r in got.collect()) == [1, 2]
    assert restructure.keep_computed(df, F.lit(None).cast("boolean")).count() == 0


def test_running_total_in_small_blocks(spark):
    random.seed(5)
    data = [(k, p, random.randint(1, 9)) for k in ("hot", "cold") for p in random.sample(range(-200, 900), 300 if k == "hot" else 5)]
    df = spark.createDataFrame(data, "k string, p bigint, v bigint")
    got = {(r.k, r.p): r.s for r in numbering.running_total(df, "p", "v", "s", ["k"], fan=8).collect()}
    for key in ("hot", "cold"):
        total = 0
        for _, p, v in sorted(d for d in data if d[0] == key):
            total += v
            assert got[(key, p)] == total


def test_numbers_are_dense_and_in_order(spark):
    random.seed(6)
    keys = random.sample(range(-5000, 100000), 700)
    df = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in keys], "k bigint, g string")
    want = {k: i for i, k in enumerate(sorted(keys), 1)}
    assert {r.k: r.n for r in numbering.number_by_key(df, "k", "n", block_rows=64).collect()} == want
    by_group = {k: i for i, k in enumerate(sorted(keys, key=lambda k: ("a" if k % 3 else "b", k)), 1)}
    assert {r.k: r.n for r in numbering.number_by_order(df, ["g", "k"], "n", partitions=5).collect()} == by_group
    batches = numbering.assign_batches(df, "k", 100, block_rows=64).groupBy("batch_no").count().collect()
    assert {r.batch_no: r["count"] for r in batches} == {i: 100 for i in range(7)}


def test_scan_request_order(spark):
    df = spark.range(20).withColumn("g", F.col("id") % 2)
    got = tables.apply_scan(df, tables.ScanRequest("g = 1", ("id DESC",), 2, 3))
    assert [r.id for r in got.collect()] == [15, 13, 11]


def test_sources_list_and_refuse(spark, tmp_path):
    source = tables.TableSource(str(tmp_path), ("b", "a", "sqlite_master", "RDB$X"), read_only=True)
    assert source.list_tables() == ["a", "b"]
    with pytest.raises(tables.ReadOnlySource):
        source.check_writable()
    with pytest.raises(PermissionError):
        migrate(spark, source, FolderTarget(str(tmp_path), read_only=True), MigrationPlan())
    jdbc = tables.JdbcSource("jdbc:x", ("z", "y"))
    assert jdbc.list_tables() == ["y", "z"]


def test_table_choice_keeps_existing_names_only(spark):
    found = spark.createDataFrame([("a", 1), ("b", 2)], "table_name string, row_count bigint")
    assert {r.table_name for r in tables.choose_tables(found, ["b", "zz"]).collect()} == {"b"}
    assert tables.choose_tables(found, "all") is found
    assert {r.table_name for r in tables.include_exclude(found, [], ["a"]).collect()} == {"b"}


PLAN = {
    "tables": ["people", "absent", "pets"],
    "parallelTables": 2,
    "mapping": {"tables": {"people": "persons"}, "columns": {"people": {"id": "person_id"}}, "types": {"double": "NUMERIC(10,1)"}},
    "filters": {"people": {"where": "id > 1", "orderBy": "id DESC, name", "limit": 2}},
    "transforms": [{"table": "people", "column": "name", "function": "toUpperCase"}],
}


@pytest.fixture
def source(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1.25), (2, "b", 2.5), (3, "c", 3.75), (4, "d", 4.0)], "id int, name string, w double").write.parquet(
        f"{tmp_path}/people.parquet"
    )
    spark.createDataFrame([(1, "rex")], "id int, name string").write.parquet(f"{tmp_path}/pets.parquet")
    return tables.TableSource(str(tmp_path), ("people", "pets"))


def test_migrate_end_to_end(spark, source):
    plan = MigrationPlan.from_json(json.dumps(PLAN))
    target = FolderTarget(fresh_path(spark, "t"))
    log = {r.table_name: (r.target_table, r.status, r.row_count) for r in migrate(spark, source, target, plan).collect()}
    assert log == {"people": ("persons", "completed", 2), "pets": ("pets", "completed", 1)}
    got = target.read(spark, "persons")
    assert got.columns == ["person_id", "name", "w"] and dict(got.dtypes)["w"] == "decimal(10,1)"
    assert sorted((r.person_id, r.name) for r in got.collect()) == [(3, "C"), (4, "D")]


def test_dry_run_counts_without_writing(spark, source, tmp_path):
    plan = MigrationPlan.from_dict({**PLAN, "dryRun": True, "tables": "all", "excludeTables": ["pets"]})
    out = tmp_path / "never"
    log = migrate(spark, source, FolderTarget(str(out)), plan).collect()
    assert [(r.table_name, r.row_count) for r in log] == [("people", 2)] and not out.exists()


def test_failing_table_stops_or_is_logged(spark, source):
    bad = {**PLAN, "filters": {"people": {"where": "no_such_column = 1"}}}
    with pytest.raises(Exception):
        migrate(spark, source, FolderTarget(fresh_path(spark, "t")), MigrationPlan.from_dict(bad))
    log = migrate(spark, source, FolderTarget(fresh_path(spark, "t")), MigrationPlan.from_dict({**bad, "skipErrors": True})).collect()
    assert {r.table_name: r.status for r in log} == {"people": "failed", "pets": "completed"}


def test_create_and_drop(spark):
    structure = spark.createDataFrame([], "id int, v decimal(5,2)")
    ddl.drop_table(spark, "made")
    assert ddl.create_table(spark, "made", structure) is True
    assert ddl.create_table(spark, "made", structure) is False
    with pytest.raises(ValueError):
        ddl.create_table(spark, "made", structure, if_absent=False)
    assert spark.table("made").schema == structure.schema and spark.table("made").count() == 0
    ddl.drop_table(spark, "made", strict=True)
    with pytest.raises(Exception):
        ddl.drop_table(spark, "made", strict=True)
    assert ddl.jdbc_column_types([("a", "VARCHAR(5)"), ("b", "INT")]) == "a VARCHAR(5), b INT"


def test_reconcile_and_largest(spark):
    s = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1)], "table_name string, row_count bigint")
    t = spark.createDataFrame([("a", 3), ("b", 2)], "table_name string, row_count bigint")
    got = {r.table_name: (r.difference, r.status) for r in loading.reconcile_counts(s, t).collect()}
    assert got == {"a": (0, "ok"), "b": (1, "warning"), "c": (1, "warning")}
    assert [tuple(r) for r in loading.largest_table(s).collect()] == [("a", 3)]


def test_unfit_rows_are_named(spark):
    df = spark.createDataFrame([(1, "5", 70000), (2, "x", 3), (3, None, None)], "id int, a string, b int")
    good, bad = loading.reject_unfit(df, {"a": "INTEGER", "b": "SMALLINT"})
    assert {r.id: r.unfit_columns for r in bad.collect()} == {1: "b", 2: "a"}
    assert [tuple(r) for r in good.collect()] == [(3, None, None)] and dict(good.dtypes)["b"] == "smallint"


def test_key_candidates(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "b", 6)], "id int, v string, n int")
    got = {r.column_name: (r.distinct_count, r.is_candidate) for r in catalog.key_candidates({"t": df}, {"t": ("v",)}).collect()}
    assert got == {"id": (3, True), "v": (2, False), "n": (2, False)}


def test_mapping_store(spark):
    log = spark.createDataFrame(
        [("m1", 1, "put", "a"), ("m1", 3, "put", "b"), ("m2", 1, "put", "c"), ("m2", 2, "delete", None), ("m3", 1, "delete", None), ("m3", 2, "put", "d")],
        "id string, seq int, op string, t string",
    )
    assert {r.id: r.t for r in mp.latest_mappings(log).collect()} == {"m1": "b", "m3": "d"}


def test_partial_updates_merge_since_the_last_put(spark):
    log = spark.createDataFrame(
        [
            ("m1", 1, "put", "a", 1), ("m1", 2, "update", None, 5), ("m1", 3, "update", "z", None),
            ("m2", 1, "put", "b", 2), ("m2", 2, "delete", None, None), ("m2", 3, "update", "lost", 9),
            ("m3", 1, "put", "c", 3), ("m3", 2, "update", "old", 4), ("m3", 3, "put", "d", None),
        ],
        "id string, seq int, op string, t string, n int",
    )
    assert {r.id: (r.t, r.n) for r in mp.merge_updates(log).collect()} == {"m1": ("z", 5), "m3": ("d", None)}


def test_running_total_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 7)], "k string, p int, v int")
    got = sorted((r.k or "", r.p, r.s) for r in numbering.running_total(df, "p", "v", "s", ["k"]).collect())
    assert got == [("", 1, 2), ("", 2, 5), ("a", 1, 7)]
    with pytest.raises(ValueError):
        numbering.block_of(F.col("p"), 10)


def test_other_file_formats(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string").write.csv(f"{tmp_path}/t.csv", header=True)
    source = tables.TableSource(str(tmp_path), ("t",), "csv", {"header": "true", "inferSchema": "false"}, ".csv")
    got = source.scan(spark, "t", tables.ScanRequest("id = '2'"))
    assert [tuple(r) for r in got.collect()] == [("2", "y")]


def test_mapping_errors_split_joined_sources(spark):
    src = spark.createDataFrame([("a", "x"), ("b", "y")], "table_name string, column_name string")
    maps = spark.createDataFrame([("m", "a, b", "a"), ("n", "a,zz", "b")], "mapping_id string, source_table string, target_table string")
    cols = spark.createDataFrame([("m", "a", "x", "a", "q")], "mapping_id string, source_table string, source_column string, target_table string, target_column string")
    got = {(r.mapping_id, r.error, r.item) for r in mp.mapping_errors(maps, cols, src, src).collect()}
    assert got == {("n", "source table not found", "zz"), ("m", "target column not found", "a.q")}


def test_mapping_document():
    m = TableMapping.from_dict(
        {
            "id": "m", "sourceTable": "a, b", "targetTable": "t", "mappingType": "many-to-one",
            "columnMappings": [{"sourceColumn": "a.x", "targetColumn": "x", "transformation": {"type": "direct"}}],
            "joinConditions": [{"sourceTable": "a", "sourceColumn": "x", "targetTable": "b", "targetColumn": "x", "joinType": "LEFT"}],
        }
    )
    assert m.sources == ("a", "b") and m.columns[0].direct and m.joins[0].kind == "LEFT"


def test_replay_is_incremental(spark, tmp_path):
    folder, target, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    progress = replay(spark, folder, schema, lambda df: df.where("id % 2 = 0"), target, mark, files_per_batch=1)
    assert [p["row_count"] for p in progress] == [10, 10, 10]
    assert replayed(spark, target).count() == 15
    spark.range(30, 40).coalesce(1).write.mode("append").parquet(folder)
    assert len(replay(spark, folder, schema, lambda df: df.where("id % 2 = 0"), target, mark, files_per_batch=1)) == 1
    loaded = replayed(spark, target)
    assert sorted(r.id for r in loaded.collect()) == list(range(0, 40, 2))
    assert {r.batch_no: r.row_count for r in batch_counts(loaded).collect()} == {0: 5, 1: 5, 2: 5, 3: 5}


def test_one_pass_quarantine(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "id int, v string")
    good, bad = loading.write_quarantined(df, [Rule("v", "required", message="missing")], fresh_path(spark, "q"))
    assert good.columns == ["id", "v"] and sorted(r.id for r in good.collect()) == [1, 4]
    assert {r.id: r.reject_reason for r in bad.collect()} == {2: "v: missing", 3: "v: missing"}


def test_everything_written_goes_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder and fresh_path(spark, "x").startswith(folder)
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_batches_keep_rows_without_a_key_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, "b"), (5, "c"), (5, "d"), (None, None)], "k long, t string")
    got = numbering.number_by_key(df, "k", "n", start=0).collect()
    assert sorted(r.n for r in got) == list(range(6))
    assert [r.k for r in sorted(got, key=lambda r: r.n)] == [1, 5, 5, None, None, None]


def test_stream_replay_reads_a_table_stored_as_a_folder(spark, tmp_path):
    import __spark_entry__ as entry

    source = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{source}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    query = entry.queries()["stream_replay"]
    assert sorted(map(str, query(spark, str(tmp_path)).collect())) == sorted(map(str, query(spark, source).collect()))


def test_values_beyond_the_range_of_the_target_are_no_values(spark):
    from tableferry.functions import convert, dialects, legacy_columns, type_rules

    df = spark.createDataFrame([("10000000000000000000", 1e19), ("-99999999999999999999", -1e19), ("2.5", 2.5)], "t string, d double")
    got = df.select(convert.text_to_integer(F.col("t")), convert.number_to_number(F.col("d"), "INTEGER")).collect()
    assert [tuple(r) for r in got] == [(None, None), (None, None), (3, 3)]
    spec = dialects.ColumnSpec("x", "INTEGER", True)
    assert [r[0] for r in df.select(dialects.coerce("mysql", F.col("d"), df.schema["d"].dataType, spec)).collect()] == [None, None, 2]
    long = spark.createDataFrame([("y" * 400,)], "t string")
    assert len(long.select(legacy_columns.sqlite_column(F.col("t"), "TEXT", "VARCHAR")).first()[0]) == 400
    kept = spark.sql(f"SELECT CAST('1.234567' AS {type_rules.spark_type('DECIMAL')}) AS a, CAST('123456789012345678' AS {type_rules.spark_type('NUMERIC')}) AS b").first()
    assert str(kept.a).startswith("1.234567") and int(kept.b) == 123456789012345678
    assert type_rules.spark_type("DECIMAL(40,2)") == "string"


def test_migrate_keeps_rejects_and_replaces_a_rerun(spark, tmp_path):
    spark.createDataFrame([(1, 40000, "a"), (2, None, "b"), (70000, 5, "c"), (3, 4, "d")], "id bigint, qty bigint, name string").write.parquet(
        f"{tmp_path}/stock.parquet"
    )
    src = tables.TableSource(str(tmp_path), ("stock",))
    plan = MigrationPlan.from_dict({"tables": ["stock"], "mapping": {"columns": {"stock": {"id": "stock_id"}}, "types": {"bigint": "SMALLINT"}}})
    target = FolderTarget(fresh_path(spark, "t"))
    for _ in range(2):
        log = migrate(spark, src, target, plan, run="r1").collect()
    assert [(r.row_count, r.rejected_count) for r in log] == [(2, 2)]
    good = target.read(spark, "stock")
    assert good.columns == ["stock_id", "qty", "name"] and sorted(tuple(r) for r in good.collect()) == [(2, None, "b"), (3, 4, "d")]
    bad = sorted((r.name, r.reject_columns, r.source_values, r.migration_run) for r in target.rejects(spark, "stock").collect())
    assert bad == [("a", "qty", '{"id":1,"qty":40000}', "r1"), ("c", "id", '{"id":70000,"qty":5}', "r1")]
    migrate(spark, src, target, plan, run="r2")
    assert target.read(spark, "stock").count() == 4


def test_one_scan_feeds_every_target(spark, tmp_path):
    from tableferry.operators import restructure as rs
    from tableferry.plans.model import TableMapping

    spark.createDataFrame([(1, "F", "hi"), (2, "O", "lo"), (3, "O", "hi"), (4, None, "hi")], "k long, st string, pr string").write.parquet(f"{tmp_path}/o.parquet")
    src = spark.read.parquet(f"{tmp_path}/o.parquet")

    def m(target, cols, **extra):
        return TableMapping.from_dict(
            {"id": target, "sourceTable": "o", "targetTable": target, "mappingType": "one-to-many",
             "columnMappings": [{"sourceColumn": s, "targetColumn": t, "transformation": {"type": "direct"}} for s, t in cols], **extra}
        )

    maps = [m("all", [("k", "id")]), m("open", [("k", "id"), ("st", "state")], filterConditions=["st <> 'F'"]), m("off", [("k", "id")], enabled=False)]
    maps.append(TableMapping(**{**m("prio", [("pr", "priority"), ("k", "first")]).__dict__, "distinct": True}))
    fanned = rs.fan_out(src, {"a": [("id", F.col("k"))], "b": [("id", F.col("k")), ("state", F.col("st"))]}, {"b": F.col("st") != "F"})
    assert fanned._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = rs.load_mappings({"o": src}, maps, fresh_path(spark, "split"))
    assert set(got) == {"all", "open", "prio"}
    assert sorted(r.id for r in got["all"].collect()) == [1, 2, 3, 4]
    assert sorted(tuple(r) for r in got["open"].collect()) == [(2, "O"), (3, "O")]
    assert sorted(tuple(r) for r in got["prio"].collect()) == [("hi", 1), ("lo", 2)]
    with pytest.raises(ValueError):
        rs.compile_mapping({"o": src}, maps[2])


def test_a_key_on_half_the_rows_is_numbered_in_parts(spark):
    rows = [(7, f"r{i}") for i in range(300)] + [(i, "x") for i in range(300)] + [(None, f"n{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(4)
    got = numbering.number_by_key(df, "k", "n", start=0, block_rows=16).collect()
    assert sorted(r.n for r in got) == list(range(640))
    ordered = [r.k for r in sorted(got, key=lambda r: r.n)]
    assert ordered == sorted((r[0] for r in rows if r[0] is not None)) + [None] * 40
    again = {(r.k, r.t): r.n for r in numbering.number_by_key(df.repartition(3), "k", "n", start=0, block_rows=16).collect()}
    assert again == {(r.k, r.t): r.n for r in got}
    batches = numbering.assign_batches(df, "k", 100, block_rows=16).groupBy("batch_no").count().collect()
    assert sorted((r.batch_no, r["count"]) for r in batches) == [(i, 100) for i in range(6)] + [(6, 40)]
