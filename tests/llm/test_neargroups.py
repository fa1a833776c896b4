"""Groups of near copies: links counted from differences to a base, without meeting all pairs."""

import random
from fractions import Fraction

import pytest

from tableferry.llm import jaccard, neargroups
from tests.llm.test_round3 import shingles


def brute(rows, t):
    sets = [shingles(x) for _, x in rows]
    near = [[] for _ in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) * t.denominator >= len(a | b) * t.numerator:
                near[i].append(j)
                near[j].append(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        out.append((doc, len(sets[i]), min(rows[j][0] for j in seen), len(near[i])))
    return sorted(out)


def edited(rng, base, edits, places, added):
    words = list(base)
    for _ in range(edits):
        words[rng.choice(places)] = rng.choice(added)
    return " ".join(words)


def found(spark, rows, t):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(tuple(r) for r in jaccard.jaccard_components(df, threshold=t).collect())


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(3, 4)])
def test_links_in_groups_match_brute_force(spark, monkeypatch, t):
    """Shared and own edits, exact copies, longer and shorter copies, two bases with a chain between, a line many hold."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    first, line = [word() for _ in range(90)], [word() for _ in range(12)]
    second = first[:70] + [word() for _ in range(20)]
    rows = []
    for i in range(130):
        base = first if i % 3 else second
        text = edited(rng, base, rng.choice([0, 1, 1, 2, 2, 3, 6]), range(90) if i % 2 else range(5, 90, 12), [f"own{i}"] if i % 5 else ["x", "y"])
        rows.append((i, " ".join(text.split()[: rng.choice([90, 90, 90, 87, 60])])))
    rows += [(200 + i, rows[i * 7 % 40][1]) for i in range(25)]
    rows += [(300 + i, " ".join(line + [word() for _ in range(i % 4 * 10)])) for i in range(40)]
    want = brute(rows, t)
    for hot, pivots, along, block in ((16, 8, 128, 2048), (2, 1, 7, 5)):
        for name, value in (("HOT", hot), ("PIVOTS", pivots), ("ALONG", along)):
            monkeypatch.setattr(neargroups, name, value)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert found(spark, rows, t) == want


def test_pairs_of_a_group_of_near_copies_are_not_joined(spark, monkeypatch):
    """No base text among them; one to four edits at any place: rows made stay far below the pairs."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, edited(rng, base, 1 + i % 4, range(150), [f"own{i}"])) for i in range(300)]
    made = {}
    for module in (jaccard, neargroups):

        def spy(df, label, real=module.written, **options):
            table = real(df, label, **options)
            made[label] = table.count()
            return table

        monkeypatch.setattr(module, "written", spy)
    assert found(spark, rows, Fraction(9, 10)) == brute(rows, Fraction(9, 10))
    assert made["pairs"] < 300 and made["cells"] < 300
    assert made["classlinks"] < 3000


def near_copies(n):
    rng = random.Random(10)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    return [(i, edited(rng, base, rng.choice([1, 2, 3]), range(3, 90, 6), [f"own{i}", "x", "y"])) for i in range(n)]


@pytest.mark.parametrize("span", [0, 400, 1 << 20])
def test_links_do_not_depend_on_where_differences_are_told_apart(spark, monkeypatch, span):
    """All groups shuffled by n-gram, only the wider one, or none; an edit that most copies of the second share, and exact copies."""
    rows = near_copies(150)
    rng = random.Random(11)
    base = [f"v{rng.randrange(10**6)}" for _ in range(90)]
    rows += [(200 + i, edited(rng, base[:40] + ([f"most{i}"] if i % 7 == 0 else ["most"]) + base[41:], 1, range(60, 90), [f"own{i}"])) for i in range(20)]
    rows += [(300 + i, rows[i * 3][1]) for i in range(40)]
    monkeypatch.setattr(neargroups, "SPAN", span)
    assert found(spark, rows, Fraction(9, 10)) == brute(rows, Fraction(9, 10))


def test_differences_of_a_group_that_fits_a_task_are_not_rows(spark, monkeypatch):
    """Beyond that they are as many as the differences, twice, not the pairs of the group."""
    made = []

    def spy(diffs, *more, real=neargroups.each_gram):
        each = real(diffs, *more)
        made.append(each.count())
        return each

    monkeypatch.setattr(neargroups, "each_gram", spy)
    found(spark, near_copies(150), Fraction(9, 10))
    assert sum(made) == 0
    monkeypatch.setattr(neargroups, "SPAN", 0)
    sums = {}
    for n in (75, 150):
        made.clear()
        found(spark, near_copies(n), Fraction(9, 10))
        sums[n] = sum(made)
    assert 0 < sums[150] < 2.6 * sums[75]
