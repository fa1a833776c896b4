import random
import re

import pytest
from pyspark.sql import functions as F

from tableferry.functions import similarity as sim
from tableferry.operators import matching as mt


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def name_score(a, b):
    a, b = a.lower().strip(), b.lower().strip()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return 0.8
    n = max(len(a), len(b))
    return (n - edit_distance(a, b)) / n


def pieces(name):
    x = name.lower().strip()
    words = [w for w in re.split("[^a-z0-9]+", x) if w]
    return {x, *words, *(x[i : i + 3] for i in range(len(x) - 2))}


def candidate(a, b):
    """Names that share a piece, or where a name of one or two characters stands inside the other."""
    x, y = a.lower().strip(), b.lower().strip()
    return bool(pieces(a) & pieces(b)) or (1 <= len(x) <= 2 and x in y) or (1 <= len(y) <= 2 and y in x)


def score(s, t):
    return round(0.7 * name_score(s[2], t[2]) + 0.3 * sim.types_alike(s[3], t[3]), 6)


SCHEMA = "table_name string, ordinal int, column_name string, type string, precision int, is_pk boolean"


def random_catalog(prefix, seed, hot):
    """A third of all columns share one name."""
    rnd = random.Random(seed)
    words = ["id", "name", "customer", "order", "date", "total", "price", "Qty", "code", "x"]
    types = ["VARCHAR", "TEXT", "INTEGER", "BIGINT", "DECIMAL", "DATE", "BLOB", "varchar(20)"]
    rows = []
    for t in range(6):
        for i in range(12):
            name = hot if rnd.random() < 0.33 else "_".join(rnd.sample(words, rnd.randint(1, 3)))
            rows.append((f"{prefix}{t}", i + 1, name, rnd.choice(types), rnd.choice([None, 5, 10]), i == 0))
    return rows


@pytest.fixture(scope="module")
def catalogs(spark):
    s, t = random_catalog("src_", 1, "customer_id"), random_catalog("tgt_", 2, "CUSTOMER_ID")
    return s, t, spark.createDataFrame(s, SCHEMA), spark.createDataFrame(t, SCHEMA)


@pytest.mark.parametrize("spread", [4096, 2])
def test_column_match_is_the_brute_force_answer(catalogs, monkeypatch, spread):
    """Small parts spread every frequent piece over many tasks."""
    monkeypatch.setattr(mt, "SPREAD_ROWS", spread)
    s, t, sdf, tdf = catalogs
    want = []
    for a in s:
        found = [(-score(a, b), b[0], b[1], b[2]) for b in t if candidate(a[2], b[2])]
        best = min(found) if found else None
        if best and -best[0] > 0.5:
            want.append((a[0], a[2], best[1], best[3], -best[0]))
    assert sorted(tuple(r) for r in mt.column_match(sdf, tdf).collect()) == sorted(want)


@pytest.mark.parametrize("spread", [4096, 2])
def test_table_match_is_the_brute_force_answer(catalogs, monkeypatch, spread):
    monkeypatch.setattr(mt, "SPREAD_ROWS", spread)
    s, t, sdf, tdf = catalogs
    got = {(r.source_table, r.target_table): r for r in mt.table_match(sdf, tdf).collect()}
    assert set(got) == {(a, b) for a in {r[0] for r in s} for b in {r[0] for r in t}}
    for a, b in got:
        mine, theirs = [r for r in s if r[0] == a], [r for r in t if r[0] == b]
        structure = sum(max(score(x, y) for y in theirs) for x in mine) / len(mine)
        want = 0.4 * name_score(a, b) + 0.2 * min(len(mine), len(theirs)) / max(len(mine), len(theirs)) + 0.4 * structure
        assert got[(a, b)].score == pytest.approx(want, abs=2e-6)
        assert got[(a, b)].structure_score == pytest.approx(structure, abs=2e-6)


def test_tables_without_a_common_piece_are_matched(spark):
    """Names that share no whole name, word or three characters: ab and ac, qty and qxy."""
    src = [("alpha", 1, "ab", "TEXT", None, True), ("alpha", 2, "qty", "INTEGER", None, False)]
    tgt = [("alphb", 1, "ac", "TEXT", None, True), ("alphb", 2, "qxy", "INTEGER", None, False)]
    sdf, tdf = spark.createDataFrame(src, SCHEMA), spark.createDataFrame(tgt, SCHEMA)
    assert not any(candidate(a[2], b[2]) for a in src for b in tgt)
    structure = (score(src[0], tgt[0]) + score(src[1], tgt[1])) / 2
    (row,) = mt.table_match(sdf, tdf).collect()
    assert row.structure_score == pytest.approx(structure, abs=2e-6)
    assert row.score == pytest.approx(0.4 * 0.8 + 0.2 + 0.4 * structure, abs=2e-6)
    assert [(r.target_table, r.rank) for r in mt.table_suggestions(sdf, tdf).collect()] == [("alphb", 1)]
    assert {(r.source_column, r.target_column) for r in mt.auto_map(sdf, tdf).collect()} == {("ab", "ac"), ("qty", "qxy")}


@pytest.mark.parametrize("spread", [4096, 2])
def test_auto_map_is_the_brute_force_answer(catalogs, monkeypatch, spread):
    monkeypatch.setattr(mt, "SPREAD_ROWS", spread)
    monkeypatch.setattr(mt, "AUTO_MAP_THRESHOLD", 0.6)
    s, t, sdf, tdf = catalogs
    tables = {}
    for r in mt.table_match(sdf, tdf).collect():
        tables.setdefault(r.source_table, []).append((-r.score, r.target_table))
    want = []
    for a, found in tables.items():
        neg, b = min(found)
        for x in s:
            if x[0] == a and -neg >= 0.6:
                top, _, name = min((-score(x, y), y[1], y[2]) for y in t if y[0] == b)
                if -top > 0.5:
                    want.append((a, x[2], b, name, round(-top * 100, 2)))
    got = [(r.source_table, r.source_column, r.target_table, r.target_column, r.confidence) for r in mt.auto_map(sdf, tdf).collect()]
    assert want and sorted(got) == sorted(want)


def test_candidates_by_pieces(spark):
    src = spark.createDataFrame([("s", 1, n, "TEXT", None, False) for n in ["id", "order_date", "Customer Name", "q", "", "zzz"]], SCHEMA)
    tgt = spark.createDataFrame([("t", 1, n, "TEXT", None, False) for n in ["ID", "date_of_order", "custname", "aqb", "xyz", "o"]], SCHEMA)
    wanted = src.select(sim.plain_name(F.col("column_name")).alias("name")).distinct()
    offered = tgt.select(sim.plain_name(F.col("column_name")).alias("t_name")).distinct()
    got = {tuple(r) for r in mt.candidate_names(wanted, offered).collect()}
    names_s = ["id", "order_date", "customer name", "q", "", "zzz"]
    names_t = ["id", "date_of_order", "custname", "aqb", "xyz", "o"]
    assert got == {(a, b) for a in names_s for b in names_t if candidate(a, b)}
    assert ("q", "aqb") in got and ("order_date", "o") in got and ("zzz", "xyz") not in got


def test_containment_map_is_the_brute_force_answer(catalogs):
    s, t, sdf, tdf = catalogs

    def like(x, y):
        x, y = x.lower(), y.lower()
        return x in y or y in x

    want = set()
    for a in s:
        # No table name contains another here, so tables are renamed to match.
        target = a[0].replace("src", "tgt")
        hits = [b for b in t if b[0] == target and like(a[2], b[2])]
        if hits:
            want.add((a[0], a[2], min(hits, key=lambda b: b[1])[2]))
    renamed = tdf.withColumn("table_name", F.replace("table_name", F.lit("tgt"), F.lit("my_src")))
    got = {(r.source_table, r.source_column, r.target_column) for r in mt.name_containment_map(sdf, renamed).collect()}
    assert got == want


def test_similarity_functions(rows):
    a, b = F.col("a"), F.col("b")
    pairs = [("Order", " order "), ("", "x"), ("cust", "customer"), ("kitten", "sitting"), ("", "")]
    got = rows(pairs, "a string, b string", F.round(sim.string_similarity(a, b), 6))
    assert [r[0] for r in got] == [1.0, 0.0, 0.8, round(4 / 7, 6), 1.0]
    kinds = [("VARCHAR", "text"), ("VARCHAR(20)", "VARCHAR"), ("VARCHAR(20)", "varchar(20)"), ("INT", "NUMBER"), ("DATE", "TIME")]
    assert [r[0] for r in rows(kinds, "a string, b string", sim.type_similarity(a, b))] == [0.8, 0.0, 1.0, 0.8, 0.0]
    assert [sim.types_alike(*k) for k in kinds] == [0.8, 0.0, 1.0, 0.8, 0.0]
    ways = [("VARCHAR", "TEXT"), ("INTEGER", "NUMERIC"), ("NUMERIC", "INTEGER"), ("BLOB", "CHAR")]
    assert [r[0] for r in rows(ways, "a string, b string", sim.types_compatible(a, b))] == [True, True, False, False]


def test_compatibility_is_capped(rows):
    score = sim.compatibility_score(F.col("a"), F.col("b"), F.col("p"), F.col("q"))
    data = [("X", "X", 5, 5), ("VARCHAR", "TEXT", None, 5), ("A", "B", 0, 0)]
    assert [round(r[0], 2) for r in rows(data, "a string, b string, p int, q int", score)] == [1.0, 0.7, 0.5]


def test_foreign_keys(spark):
    src = spark.createDataFrame(
        [("orders", "customer_id", "INTEGER", False), ("orders", "customer_code", "INTEGER", False), ("orders", "CustomerID", "VARCHAR", False), ("orders", "paid", "BIGINT", False)],
        "table_name string, column_name string, type string, is_pk boolean",
    )
    tgt = spark.createDataFrame(
        [("Customer", "id", "BIGINT", True), ("Customer", "name", "INTEGER", False), ("pa", "k", "INTEGER", True)],
        "table_name string, column_name string, type string, is_pk boolean",
    )
    got = {(r.source_column, r.target_table, r.target_column) for r in mt.detect_foreign_keys(src, tgt).collect()}
    assert got == {("customer_id", "Customer", "id"), ("paid", "pa", "k")}


def test_confidence_defaults_to_85(spark, catalogs):
    _, _, sdf, _ = catalogs
    none = spark.createDataFrame([], "source_table string, score double")
    assert {r.confidence for r in mt.mapping_confidence(none, sdf).collect()} == {85}
