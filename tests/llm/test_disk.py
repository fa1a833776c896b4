"""What operators leave on the executors' disks, and how many pairs they join, counted from plans and files."""

import random
import time
from fractions import Fraction

import numpy as np

from tableferry.llm import jaccard, repeats


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def left_behind(spark, work):
    """Shuffle files that are still there some time after ``work``."""
    before, kept = shuffle_files(spark), work()
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left, kept


def passages(n):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [[word() for _ in range(70)] for _ in range(6)]
    return [(i, " ".join([word() for _ in range(40)] + shared[i % 6] + [word() for _ in range(i % 9)] + shared[i * 7 % 6])) for i in range(n)]


def test_repeats_leave_no_shuffle_files_between_steps(spark):
    docs = spark.createDataFrame(passages(60), "doc_id long, text string").repartition(4)
    left, spans = left_behind(spark, lambda: repeats.passage_spans(docs, 50, 20, "doc_id", "text"))
    assert not left
    assert spans.where("duplicate").count() > 0


def near_copies(n):
    """One text with one word changed in each copy: every two of them are candidates."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    return [(i, " ".join(base[:k] + [f"own{i}"] + base[k + 1 :])) for i in range(n) for k in [rng.randrange(150)]]


def test_jaccard_brings_a_set_once_to_a_cell(spark, monkeypatch):
    """The rows that meet for the verification are the pairs and one row per set and cell, not two sets per pair."""
    seen = []
    real = jaccard.map_batches

    def spy(df, fn, schema):
        if "grams" in df.columns or "xs" in df.columns:
            seen.append(df.select(*[c for c in df.columns if c in ("grams", "xs", "ys")]))
        return real(df, fn, schema)

    monkeypatch.setattr(jaccard, "map_batches", spy)
    rows = near_copies(80)
    for limit in (1 << 12, 100):
        monkeypatch.setattr(jaccard, "CELL_PAIRS", limit)
        got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), threshold=Fraction(9, 10)).collect()
        assert {(r.component_id, r.n_links) for r in got} == {(0, 79)}
    carried = [sum(len(v) for r in df.collect() for v in r) for df in seen]
    assert max(carried[:1]) == 80 * 148
    assert max(carried) < 20 * 80 * 148


def test_jaccard_seeks_no_texts_of_pairs_that_parities_rule_out(spark, monkeypatch):
    """With equal counts the order is arbitrary and unlike texts share prefix n-grams; their sets are not made again."""
    rng = random.Random(7)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(140)])) for i in range(40)] + near_copies(2)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    monkeypatch.setattr(jaccard, "bucket_counts", lambda docs, width: np.zeros(jaccard.BUCKETS, np.int32))
    made = []
    real = jaccard.map_batches

    def spy(df, fn, schema):
        if fn.__qualname__.startswith("_whole"):
            made.append(df)
        return real(df, fn, schema)

    monkeypatch.setattr(jaccard, "map_batches", spy)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got if r.n_links} == {40, 41}
    assert made[0].count() == 2


def test_differing_parities_are_at_most_the_differing_hashes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 7, dtype=np.uint64)]))
        bits = int(np.bitwise_count(jaccard._parities(a) ^ jaccard._parities(b)).sum())
        assert bits <= len(np.setxor1d(a, b))
