"""The pipeline's stages against brute force."""

import random
from collections import Counter

import corpus_pipeline
from tableferry.llm import simhash

SCHEMA = "doc_id long, text string, lang string, _row int"


def test_drop_near_copies_keeps_one_row_of_each_group(spark):
    """NULL and repeated doc_ids whose texts lie in different groups lose nothing; equal and near texts leave one row."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(80)) for _ in range(8)]
    rows = [(None, t, "en", 1) for t in texts[:3]] + [(7, t, None, 2) for t in texts[2:5]] + [(9, texts[5], "en", None), (3, texts[5], "de", 4)]
    rows += [(3, texts[5], "en", 4), (10, texts[6], "en", 1), (10, texts[6], "en", 1), (None, None, None, None), (11, "", "en", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = {t: simhash.fingerprint(t, 3) for _, t, _, _ in rows}
    groups: list[set] = []
    for m in set(marks.values()):
        near = [g for g in groups if any((m ^ o).bit_count() <= 2 for o in g)]
        groups = [g for g in groups if g not in near] + [{m}.union(*near)]
    least = Counter()
    for g in groups:
        least[min(((r[0] is None, r[0] or 0) for r in rows if marks[r[1]] in g))] += 1
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    got = [tuple(r) for r in got.collect()]
    assert not Counter(got) - Counter(rows)
    assert Counter((r[0] is None, r[0] or 0) for r in got) == least
    assert all(sum(marks[r[1]] in g for r in got) == 1 for g in groups)
    again = corpus_pipeline.drop_near_copies(spark, docs.repartition(5), "")
    assert Counter(tuple(r) for r in again.collect()) == Counter(got)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").collect() == []
