"""Merkle manifest, n-gram Jaccard join and centroid clustering against brute force, with NULLs, ties, repeats and empty tables."""

import hashlib
import math
import pathlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
import pytest

from tableferry.llm import clustering

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- centroid clustering ---------------------------------------------------------------------------------------


def lloyd(rows, k=40, rounds=5, dims=64):
    """Plain Lloyd's rounds on Python integers: every vector against every centroid."""
    kept = []
    for vid, vec in rows:
        if vec is None or len(vec) != dims or any(x is None or not math.isfinite(x) for x in vec):
            continue
        ints = [math.floor(256 * float(x)) for x in vec]
        if any(abs(x) > clustering.LIMIT for x in ints):
            continue
        kept.append((vid, ints))
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is None, r[0] or 0, r[1]))
    cents = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min(range(len(cents)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, cents[c])), c))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v), []).append(v)
        for c, vs in members.items():
            cents[c] = [sum(col) // len(vs) for col in zip(*vs)]
    out = []
    for vid, v in kept:
        c = nearest(v)
        out.append((vid, c, sum((a - b) ** 2 for a, b in zip(v, cents[c]))))
    per = {}
    for _, c, d in out:
        per[c] = per.get(c, 0) + d
    total = sum(per.values())
    return sorted(
        ((vid, c, d, per[c], total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for vid, c, d in out),
        key=repr,
    )


def vectors(seed, n, dims=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, dims))
    return [(i, [float(x) for x in centres[i % 3] + 0.1 * rng.normal(size=dims)]) for i in range(n)]


def clustered(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, v string")
    got = clustering.cluster(df, **kw).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_clustering_matches_lloyd(spark):
    rows = vectors(1, 120)
    rows = [(i, [float(np.float32(x)) for x in v], "x", "y") for i, v in rows]
    rows += [(500, None, None, None), (501, [1.0, 2.0], None, None), (502, [1.0, None, 2.0, 3.0], None, None), (503, [1.0, float("nan"), 0.0, 0.0], None, None)]
    rows += [(504, [float("inf"), 0.0, 0.0, 0.0], None, None), (505, [1e9, 0.0, 0.0, 0.0], None, None)]
    rows += [rows[3], rows[3], (None, [0.5, 0.5, 0.5, 0.5], None, None), (7, [0.0, 0.0, 0.0, 0.0], None, None)]
    want = lloyd([(r[0], r[1]) for r in rows], k=5, rounds=3, dims=4)
    assert clustered(spark, rows, k=5, rounds=3, dims=4) == want


def test_clustering_ties_and_small_tables(spark):
    same = [(i, [0.25, -0.5, 0.125, 1.0], None, None) for i in range(6)]
    got = clustered(spark, same, k=4, rounds=2, dims=4)
    assert got == lloyd([(r[0], r[1]) for r in same], k=4, rounds=2, dims=4)
    assert {r[1] for r in got} == {0}
    assert clustered(spark, [], k=4, dims=4) == []
    assert clustered(spark, [(1, None, None, None)], k=4, dims=4) == []
    two = [(1, [0.0, 0.0, 0.0, 0.0], None, None), (2, [1.0, 0.0, 0.0, 0.0], None, None), (3, [0.5, 0.0, 0.0, 0.0], None, None)]
    assert clustered(spark, two, k=40, rounds=5, dims=4) == lloyd([(r[0], r[1]) for r in two], k=40, rounds=5, dims=4)


def test_tournament_equals_argmin():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, size=(500, 8))
    cents = rng.integers(-300, 300, size=(9, 8))
    cents[4] = cents[2]
    win, dist = clustering.tournament(x, cents)
    d = ((x[:, None, :] - cents[None, :, :]) ** 2).sum(axis=2)
    assert (win == d.argmin(axis=1)).all()
    assert (dist == d.min(axis=1)).all()


# ---- n-gram Jaccard join ---------------------------------------------------------------------------------------

from tableferry.llm import jaccard  # noqa: E402
from tableferry.session import shared_folder  # noqa: E402


def shingles(text, width=3):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([" ".join(words)])
    return frozenset(" ".join(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_jaccard(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            smallest[r] = d if r not in smallest else min(smallest[r], d)
    return sorted(((d, len(sets[i]), smallest.get(find(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def jaccard_rows(rng):
    vocab = [f"w{i}" for i in range(40)] + ["The", "the", "THE", "über"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 60))) for _ in range(12)]
    rows = []
    for i in range(160):
        words = base[i % 12].split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "   \n"), (303, "A b"), (304, "a B"), (305, "one"), (None, base[0]), (None, None), (7, base[1])]
    rows += [rows[10], rows[10], (900, "x " * 3000), (901, "x " * 2999 + "y")]
    return rows


def test_jaccard_matches_brute_force(spark):
    rows = jaccard_rows(random.Random(11))
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, rid string, g int").repartition(4)
    got = sorted((tuple(r) for r in jaccard.jaccard_components(df).collect()), key=repr)
    assert got == brute_jaccard(rows)


def test_jaccard_small_blocks_and_empty(spark, monkeypatch):
    rows = [(i, "same words in every row here " + ("x" if i % 2 else "y")) for i in range(40)] + [(100 + i, f"a b c d e f g h i j k{i}") for i in range(30)]
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.jaccard_components(df).collect()), key=repr)
    assert got == brute_jaccard(rows)
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_jaccard_keeps_prefixes_not_whole_sets(spark):
    """Texts without near copies: what is written stays well below one hash per shingle."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))) for i in range(300)]
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("*.parquet"))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id and r.n_links == 0 and r.n_shingles == 398 for r in got) and len(got) == 300
    assert sum(f.stat().st_size for f in set(folder.rglob("*.parquet")) - before) < 300 * 398 * 8 // 2


def test_hamming_bound_is_a_lower_bound():
    rng = random.Random(2)
    for _ in range(500):
        x = sorted(rng.sample(range(60), rng.randint(0, 30)))
        y = sorted(rng.sample(range(60), rng.randint(0, 30)))
        assert jaccard._hamming_bound(x, y, 2) <= len(set(x) ^ set(y))


# ---- Merkle manifest -------------------------------------------------------------------------------------------

from tableferry.llm import manifest  # noqa: E402


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode('utf-8'))}:{v}"


def leaf(d, s, lang, n, text):
    return sha("".join(field(v) for v in (d, s, lang, n, text)))


def fold_levels(nodes):
    """Every level of the tree over ``nodes``, bottom first; runs of three while more than one node remains."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        cur = levels[-1]
        levels.append([sha("".join(cur[i : i + 3])) for i in range(0, len(cur), 3)])
    return levels


def path_of(levels, i):
    """Siblings per level and the way up."""
    out = []
    for lv in levels[:-1]:
        run = i - i % 3
        out.append((lv[run : run + 3], i % 3))
        i //= 3
    return out


def brute_manifest(rows, tamper):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode("utf-8")))
    trees, subroots = {}, []
    for s in order:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r), leaf(*tamper(r))))
        levels = fold_levels([leaf(*r) for r in members])
        trees[s] = (members, levels)
        subroots.append(levels[-1][0])
    upper = fold_levels(subroots)
    root = upper[-1][0]
    out = []
    for si, s in enumerate(order):
        members, levels = trees[s]
        for i, r in enumerate(members):
            steps = path_of(levels, i) + path_of(upper, si)
            proof = sha("".join(h for run, slot in steps for k, h in enumerate(run) if k != slot))
            val = leaf(*tamper(r))
            for run, slot in steps:
                val = sha("".join(run[:slot] + [val] + run[slot + 1 :]))
            out.append((r[0], leaf(*r), levels[-1][0], root, proof, val, val == root))
    return sorted(out, key=repr)


def test_manifest_matches_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(95):
        src = rng.choice(["a", "b", None, "ü", "B", "a b"]) if i % 9 else "a"
        rows.append((i if i % 17 else None, src, rng.choice(["en", None]), rng.choice([5, None]), rng.choice([None, "", "x\ny", "plain", "über\n\n"])))
    rows += [rows[4], rows[4], (3, "a", "en", 5, "other text\n"), (1000, "solo", None, None, "t" * 50000)]

    def tamper(r):
        cut = r[0] is not None and (zlib.crc32(str(r[0]).encode()) & 0xFFFFFFFF) % 2 == 0
        return (r[0], r[1], r[2], r[3], r[4].replace("\n", "") if cut and r[4] is not None else r[4])

    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string").repartition(3)
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    after = F.when(chosen, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    got = manifest.manifest(df, after).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = brute_manifest(rows, tamper)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert any(not r[6] for r in want) and any(r[6] for r in want)


def test_manifest_single_row_and_empty(spark):
    one = spark.createDataFrame([(7, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    got = [tuple(r) for r in manifest.manifest(one).select("leaf", "subroot", "root", "proof_sha256", "verified").collect()]
    lf = leaf(7, None, None, None, None)
    assert got == [(lf, lf, lf, sha(""), True)]
    none = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest.manifest(none).collect() == []


def test_midstate_compression_equals_hashlib():
    rng = random.Random(8)
    kids = [[sha(str(rng.random())) for _ in range(rng.randint(1, 3))] for _ in range(50)]
    for run in kids:
        state = manifest.START[None, :].copy()
        for h in run:
            state = manifest.compress(state, manifest.blocks([h]))
        assert manifest.as_hex(manifest.finish(state, np.array([64 * len(run)])))[0] == sha("".join(run))
    assert manifest.as_hex(manifest.finish(manifest.START[None, :].copy(), np.array([0])))[0] == sha("")
