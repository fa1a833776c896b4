"""The operators of the llm package against brute force, with NULLs, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tableferry.llm import language, mixing, nearest, packing, quality, repeats, sharding, simhash, tokens, warc
from tableferry.llm.links import components
from tableferry.llm.queries import ORACLES, QUERIES, SHARDS, TOKENIZER

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, copies int"
LIBRARY = Tokenizer.from_file(TOKENIZER)


def texts():
    rng = random.Random(5)
    words = ["the", "of", "and", "über", "niño", "deep", "<|endoftext|>", "it's", "we're", "123", "x", "日本", "###", "e" * 40]
    out = [None, "", "   \n", "...", "A", "a b", "the\n\nthe\n\n", "long " * 4000, "same text here now " * 30]
    for _ in range(60):
        out.append("".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", " "]) for _ in range(rng.randint(1, 90))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    """Odd documents: repeated texts, repeated rows, a repeated doc_id, NULLs in every column, and clashing column names."""
    t = texts()
    rows = [(i, x, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, 1, "m", 3) for i, x in enumerate(t)]
    rows += [(200 + i, t[8], "en", "s0", 1, "m", 3) for i in range(30)]
    rows += [rows[20]] * 5 + [(20, "another text under the same id", "en", "s1", None, None, None), (None, t[21], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def run(fn, df):
    return [r.asDict() for r in fn(df).collect()]


def key(*parts):
    return tuple((p is None, p) for p in parts)


def words_of(text):
    return WORD.findall(text or "")


def test_sharding(spark, docs, none):
    def place(df, weights=(1.0,) * SHARDS, grown="grown_shard"):
        placed = sharding.assign_shards(sharding.record_sizes(df), ["doc_id"], weights, grown=grown)
        return sharding.shard_slots(placed, "shard", ["doc_id", "text_crc32", "size"])

    got, raw = run(place, docs), docs.collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in raw)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < SHARDS and r["grown_shard"] in (r["shard"], SHARDS)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(map(str, got)) == sorted(map(str, run(place, docs.repartition(3))))
    grown = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in run(lambda d: place(d, (1.0,) * (SHARDS + 1), None), docs)}
    assert all(grown[r["doc_id"], r["text_crc32"]] == r["grown_shard"] for r in got)
    many = spark.range(40000).withColumnRenamed("id", "k")
    n = {r["shard"]: r["count"] for r in sharding.assign_shards(many, ["k"], [1, 2, 0, 1]).groupBy("shard").count().collect()}
    assert 2 not in n and abs(n[1] / 20000 - 1) < 0.05 and abs(n[0] / 10000 - 1) < 0.05
    assert run(place, none) == []


def test_language_of_odd_texts(spark, docs, none):
    parser = language.train(docs)
    got = run(lambda d: language.identify(d, parser), docs)
    assert len(got) == docs.count() and {"mark", "copies", "source"} <= set(got[0])
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and 0 <= r["score"] <= 1
    empty = language.train(none)
    assert {r["lang_pred"] for r in run(lambda d: language.identify(d, empty), docs)} == {"und"}
    assert run(lambda d: language.identify(d, parser), none) == []


def test_cross_parsing_equals_brute_force():
    rng = random.Random(2)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"a": [make("abc ", 900)], "b": [make("bcd ", 900)]}
    parser = language.build(samples, 800)
    cases = [make("abcdé ", rng.randint(1, 1300)) for _ in range(20)]
    got = language.phrases(parser, [language.fold(t) for t in cases])
    for i, t in enumerate(cases):
        codes = "".join(chr(c) for c in language.fold(t))
        for k, name in enumerate(parser.languages):
            sample = "".join(chr(c) for c in language.fold(samples[name][0]))[: parser.chars[k]]
            count = 0
            for block in range(0, len(codes), language.BLOCK):
                part = codes[block : block + language.BLOCK]
                at = 0
                while at < len(part):
                    n = 1
                    while at + n < len(part) and part[at : at + n + 1] in sample:
                        n += 1
                    at, count = at + n, count + 1
            assert got[i, k] == count


@pytest.mark.parametrize("first", [0x430, 0x905, 0x980, 0x627, 0x1EA1, 0x4E00, 0x30000])
def test_languages_of_one_script(first):
    """Two languages over the same letters, in words of the same lengths."""
    rng = random.Random(4)
    letters = [c for c in map(chr, range(first, first + 64)) if c.isalpha() and c == c.lower()][:16]
    sizes = [rng.randint(2, 8) for _ in range(60)]
    words = {k: ["".join(rng.choice(letters) for _ in range(n)) for n in sizes] for k in "ab"}
    make = lambda k, n: " ".join(words[k][rng.randrange(60)] for _ in range(n))
    parser = language.build({k: [make(k, 400)] for k in "ab"}, 1500)
    cases = [k for k in "ab" * 20]
    got = language.phrases(parser, [language.fold(make(k, 15)) for k in cases])
    assert ["ab"[i] for i in got.argmin(1)] == cases


@pytest.mark.parametrize("rare", ["x", "qzx wvk", "zq " * 100])
def test_rare_label_leaves_other_languages_whole(spark, rare):
    rng = random.Random(6)
    words = {k: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)] for k in "ab"}
    make = lambda k, n: " ".join(words[k][rng.randrange(300)] for _ in range(n))
    samples = {k: [make(k, 3000)] for k in "ab"}
    parser = language.build({**samples, "r": [rare]})
    assert parser.chars.tolist() == [12_000, 12_000, len(language.fold(rare)) + 1]
    rows = [(i, make("ab"[i % 2], 20), "ab"[i % 2]) for i in range(40)]
    got = run(lambda d: language.identify(d, parser), spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(r["lang_pred"] == r["lang"] for r in got)


def test_language_on_held_out_documents(spark):
    got = QUERIES["op3_language"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").where("held_out AND lang IS NOT NULL")
    assert held.count() > 150
    assert held.where("lang = lang_pred").count() / held.count() > 0.98


PAGES = "page_id long, url string, html string, body string, n int"


def check_warc(spark, pages, path, chunk, smallest=0):
    warc.write_archives(pages, path, chunk, smallest)
    got = Counter(tuple(r) for r in warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    groups, want = defaultdict(list), Counter()
    for r in pages.collect():
        groups[(r.html or "").encode()].append(r.page_id)
    for body, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        for n, i in enumerate(ids):
            first = n == 0 or len(body) < smallest
            want[i, len(body), digest, "response" if first else "revisit", None if first else ids[0]] += 1
    assert got == want


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 20])
def test_warc_round_trip(spark, tmp_path, chunk):
    trap = "WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a", "x" * 50, "b", 1), (2, "http://b\r\nWARC-Type: no", "x" * 50, None, None), (3, None, None, None, None), (4, "u", "", "", 0)]
    rows += [(5, "u", "ä" * 2000 + trap + trap + "é", None, 1), (6, "u", trap, None, 1), (7, "u", "\r\n\r\n" + trap[:-1], None, 1), (5, "u", "second text of page five" * 9, None, 1)]
    rows += [(None, "v", "x" * 50, None, 1), (None, "v", "unique", None, 1)] + [(8, "u", "again", None, 1)] * 4
    check_warc(spark, spark.createDataFrame(rows, PAGES).repartition(3), str(tmp_path / f"w{chunk}"), chunk)


def test_warc_smallest_and_empty(spark, tmp_path):
    rows = [(1, "a", "tiny", None, 1), (2, "a", "tiny", None, 1), (3, "a", "larger text", None, 1), (4, "a", "larger text", None, 1)]
    check_warc(spark, spark.createDataFrame(rows, PAGES), str(tmp_path / "s"), 100, 6)
    check_warc(spark, spark.createDataFrame([], PAGES), str(tmp_path / "e"), 100)


def test_packing(spark, docs, none):
    rows = run(lambda d: packing.packed_documents(d, TOKENIZER), docs)
    ids = {t: [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0] for t in {r.text for r in docs.collect()}}
    want = Counter()
    for r in docs.collect():
        x = ids[r.text]
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            want[r.doc_id, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(x)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts)) and sum(parts[-1]) <= 1024
    assert run(lambda d: packing.packed_documents(d, TOKENIZER), none) == []


def test_cutting_patterns_are_near_the_bound():
    rng = random.Random(3)
    demand = Counter(rng.randint(1, 128) for _ in range(20000))
    plan = packing.patterns(demand, 128)
    held = Counter()
    for pattern, n in plan:
        assert sum(s * m for s, m in pattern.items()) <= 128
        for s, m in pattern.items():
            held[s] += m * n
    assert held == demand
    assert sum(n for _, n in plan) <= 1.01 * sum(s * n for s, n in demand.items()) / 128
    assert packing.patterns({}, 128) == [] and sum(n for _, n in packing.patterns({128: 3, 100: 1}, 128)) == 4


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, targets, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(targets.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        targets |= {s: 2.0 * sizes[s] for s in above} if above else share
        free -= above if above else free
    return targets


def test_mixing(spark, docs, none):
    def mix(df):
        sized = mixing.sized_documents(df)
        return mixing.pareto_mix(sized, mixing.source_targets(sized, (3, 1, 2), 1.5, 2.0))

    got, raw = run(mix, docs), docs.collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r.doc_id, r.source, len(words_of(r.text))) for r in raw)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    targets = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, run(mix, docs.repartition(2))))
    assert run(mix, none) == []
    made = Counter((r.doc_id, r.source, r.text) for r in mixing.mixed_documents(docs).collect())
    words = Counter()
    for (_, source, text), n in made.items():
        words[source] += n * len(words_of(text))
    assert words == Counter({s: n for s, n in taken.items() if n})


def brute_quality(text):
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, docs, none):
    got = run(quality.judged, docs)
    want = Counter((r.doc_id, *brute_quality(r.text)) for r in docs.collect())
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in cols) for r in got) == want
    assert all(isinstance(r["kept"], bool) and not (r["kept"] and r["base_failed"]) for r in got)
    assert run(quality.judged, none) == []


def test_order_of_rules_never_changes_the_verdict(spark, docs):
    measured = quality.base_measures(docs)
    rules = quality.rules()
    one = sorted(str((r.doc_id, r.kept)) for r in quality.cascade(measured, rules).collect())
    two = sorted(str((r.doc_id, r.kept)) for r in quality.cascade(measured, rules[::-1]).collect())
    assert one == two
    found = quality.ordered_rules(measured, rules, 50)
    assert {r.name for r, _, _ in found} == {r.name for r in rules}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 12)], 1, "x") for i in range(700)]
    rows += [(1000 + i, rows[3][1], 1, "x") for i in range(300)] + [rows[5]] * 4
    rows += [(2000, None, 1, None), (2100, [1.0, None], 1, None), (2200, [float("nan")] * 12, 1, None), (2300, [float("inf")] * 12, 1, None), (2400, [], None, None), (None, [1.0] * 12, None, None), (2500, [0.5] * 3, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, vectors string").repartition(4)
    got = sorted(tuple(r) for r in nearest.top_k(df, F.col("vec_id") % 100 == 0).collect())
    usable = {}
    base = []
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
            base.append((i, q + [0] * (12 - len(q))))
            usable.setdefault(i, base[-1][1])
    m, ids = np.array([v for _, v in base], dtype=np.int64), np.array([i for i, _ in base])
    want = []
    for i, v in usable.items():
        if i % 100 == 0:
            scores = sorted((-int(s), int(c)) for s, c in zip(m @ np.array(v), ids) if c != i)[:10]
            want += [(i, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    assert got == sorted(want)
    assert nearest.top_k(df.where("false"), F.lit(True)).collect() == []
    assert len(nearest.top_k(df.where("vec_id < 4"), F.lit(True)).collect()) == 12


def brute_mark(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs, none):
    got = run(simhash.near_duplicates, docs)
    raw = docs.collect()
    marks = {r.text: brute_mark(r.text) for r in raw}
    root = brute_components(set(marks.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r in raw:
        c = root[marks[r.text]]
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{marks[r.text]:016x}", least.get(root[marks[r.text]])) for r in raw)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert run(simhash.near_duplicates, none) == []


@pytest.mark.parametrize("most", [1, 2, 3])
def test_gray_index_finds_all_pairs(spark, most):
    rng = random.Random(most)
    marks = {rng.getrandbits(64) for _ in range(300)}
    for base in list(marks)[:6]:
        for _ in range(120):
            x = base
            for _ in range(rng.randint(1, 7)):
                x ^= 1 << rng.randrange(64)
            marks.add(x)
    values = np.array(sorted(marks), np.uint64)
    index = simhash.GrayIndex(values, 4)
    found = {tuple(sorted((int(index.marks[x]), int(index.marks[y])))) for a, b in index.pairs(most) for x, y in zip(a, b)}
    assert found == {(a, b) for a, b in itertools.combinations(map(int, values), 2) if (a ^ b).bit_count() <= most}
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "mark long").repartition(4)
    roots = {r.node: r.root for r in components(simhash.links(df, most)).collect()}
    want = brute_components([int(v) for v in values.view(np.int64)], lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= most)
    assert {n: roots.get(n, n) for n in want} == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 1000 + i) for i in range(50)] + [(3, 3), (5, 4), (4, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 100 for n in range(100, 161)} | {7: 7} | {1000 + i: 7 for i in range(50)} | {4: 4, 5: 4}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_passages(rows, least):
    """Covered word positions of every row by windows of ``least`` words that occur more than once."""
    places = defaultdict(list)
    for n, (_, text) in enumerate(rows):
        w = words_of(text)
        for i in range(len(w) - least + 1):
            places[tuple(w[i : i + least])].append((n, i))
    covered = defaultdict(set)
    for spots in places.values():
        if len(spots) > 1:
            for n, i in spots:
                covered[n].update(range(i, i + least))
    return covered


def test_repeated_passages(spark, none):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    some = lambda n: " ".join(word() for _ in range(n))
    shared = [some(n) for n in (50, 51, 75, 120, 300)]
    rows = []
    for i in range(40):
        parts = [some(rng.randint(0, 80)) for _ in range(3)]
        for p in rng.sample(shared, rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), p)
        rows.append((i, "  ".join(parts) + "\n"))
    near = some(49)
    rows += [(100, near), (101, near), (102, some(90)), (None, shared[2]), (103, None), (104, ""), (105, "one two"), (106, shared[3] + " " + shared[3])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, pos string").repartition(3)
    got = defaultdict(set)
    for r in repeats.repeated_passages(df).collect():
        assert r.n_words >= 20
        got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    want = {rows[n][0]: s for n, s in brute_passages(rows, 50).items()}
    assert dict(got) == want
    cut = {r.doc_id: r.text for r in repeats.without_repeats(df).collect()}
    clean = [(i, cut.get(i)) for i, _ in rows]
    assert brute_passages(clean, 50) == {}
    for i, text in rows:
        if i not in want:
            assert cut[i] == text
    all_words = lambda side: {w for _, t in side for w in words_of(t)}
    assert all_words(clean) == all_words(rows)
    assert repeats.repeated_passages(none).collect() == [] and repeats.without_repeats(none).collect() == []


def test_passages_between_which_third_texts_are_sorted(spark):
    """Variants with changed words share more of one side than the true partner: none may hide it, and one copy of all stays."""
    rng = random.Random(23)
    base = [[f"w{rng.randrange(4000)}" for _ in range(55)] for _ in range(12)]
    rows = []
    for i in range(240):
        words = [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(25))]
        for p in rng.sample(range(12), 2):
            passage = list(base[p])
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(55)] = f"c{rng.randrange(6)}"
            words += passage + [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(25))]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)

    def windows(texts):
        return Counter(tuple(w[i : i + 50]) for w in map(words_of, texts) for i in range(len(w) - 49))

    seen = windows(t for _, t in rows)
    expected, got = defaultdict(set), defaultdict(set)
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - 49):
            if seen[tuple(w[i : i + 50])] > 1:
                expected[d] |= set(range(i, i + 50))
    for r in repeats.repeated_passages(df).collect():
        got[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    assert expected and {d: g & expected[d] for d, g in got.items()} == expected
    kept = {r.doc_id: words_of(r.text) for r in repeats.without_repeats(df).collect()}
    assert max(windows(" ".join(w) for w in kept.values()).values()) == 1
    assert {w for t in kept.values() for w in t} == {w for _, t in rows for w in words_of(t)}
    assert all(len(kept.get(d, [])) >= len(words_of(t)) - len(expected[d]) for d, t in rows)


def test_repeats_of_equal_rows_and_hot_passages(spark):
    rng = random.Random(4)
    hot = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, f"a{i} b{i} {hot} c{i} d{i}", "x") for i in range(120)] + [(7, "lone " * 10 + hot, "y")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(6)
    got = repeats.repeated_passages(df).collect()
    assert {r.doc_id for r in got} == set(range(120))
    cut = repeats.without_repeats(df)
    assert cut.count() == len(rows) and cut.where(F.col("text").contains(hot)).count() == 1


def test_token_counts(spark, docs, none):
    got = run(lambda d: tokens.token_counts(d, TOKENIZER, 20), docs)
    count = lambda t: len(LIBRARY.encode(t, add_special_tokens=False).ids)
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        fit = max((i for i in range(min(len(t), 200) + 1) if count(t[:i]) <= 20), default=0)
        want[r.doc_id, len(t.encode()), count(t), count(t) > 20, fit] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")) for r in got) == want
    assert run(lambda d: tokens.token_counts(d, TOKENIZER, 20), none) == []


def test_stored_prefix_counts_answer_budget_questions(spark, docs):
    rows = tokens.token_prefixes(docs.where("length(text) < 300 OR text IS NULL"), TOKENIZER)
    asked = rows.select("text", "prefix_tokens", tokens.longest_prefix(F.col("prefix_tokens"), 7).alias("fit"), tokens.tokens_at(F.col("prefix_tokens"), 3).alias("third"))
    for r in asked.collect():
        t = r.text or ""
        counts = [len(LIBRARY.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert r.prefix_tokens == counts and r.fit == max(i for i, n in enumerate(counts) if n <= 7)
        assert r.third == (counts[3] if len(t) >= 3 else None)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 100)
    t = " ".join(texts()[9:20])
    assert [n for _, part in tokens.prefix_counts([t], TOKENIZER) for n in part][-1] == len(LIBRARY.encode(t, add_special_tokens=False).ids)
    assert np.concatenate([ids for _, ids in packing.token_ids([t], TOKENIZER)]).tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_run_over_all_rows(spark, name):
    rows = QUERIES[name](spark, SMALL).count()
    if name == "op13_clustering":
        vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
        usable = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 65536))
        assert rows == vectors.where(usable).count()
    elif name not in ("op2_repeated_passages", "op5_packing", "op8_nearest"):
        table = "pages" if name == "op4_warc" else "documents"
        assert rows == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    assert rows > 0 and set(ORACLES) <= set(QUERIES)
