"""Operators on texts against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievery.llm import decontamination, jaccard, language, licenses, ppm, queries, tokens, topk, words
from sievery.storage import Workspace

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "a b c d", "ÀB é ß 日本語 x y", "A a A a A a A a A a", "x" * 5000]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def shingled(text):
    w = spaced(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def docs(spark, texts, more=()):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(i, t, "en", "s", 0) for i, t in more], SCHEMA)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbz09 .\n\x1fé日-", max_size=60)), max_size=8), st.integers(1, 40))
def test_words(texts, size):
    for table, pattern in ((words.SPACED, r"[^\x20\x09-\x0D]+"), (words.PLAIN, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got, seen = [], {}
        for b in words.blocks(pa.array(texts, pa.string()), table, size):
            for i in range(len(b.first) - 1):
                got.append([])
                for k in range(b.first[i], b.first[i + 1]):
                    word = lower(bytes(b.data[b.start[k] : b.start[k] + b.length[k]]).decode())
                    got[-1].append(word)
                    assert seen.setdefault(word, b.hashes[k]) == b.hashes[k]
        assert got == [re.findall(pattern, lower(t or "")) for t in texts]
        assert len(set(seen.values())) == len(seen)


def test_shingle_sets():
    texts = [*ODD, "a b c d e", "a b c d e f", "a b c d e f", "b c d e"]
    sets = list(words.shingle_sets(pa.array(texts, pa.string())))
    expected = [shingled(t) for t in texts]
    assert [len(s) for s in sets] == [len(e) for e in expected]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(expected[i] & expected[j])


def edited(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def brute_components(rows):
    sets = [shingled(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), smallest[root(i)]) for i, (doc_id, _) in enumerate(rows))


def corpus(seed, n=40):
    rng = random.Random(seed)
    fresh = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    passage = fresh(40)
    texts = list(ODD)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 or len(texts) < 12:
            texts.append(fresh(rng.randint(6, 60)) + (" " + passage if rng.random() < 0.5 else ""))
        else:
            texts.append(edited(rng, rng.choice([t for t in texts if t and len(t.split()) > 5]), rng.choice([0, 0.01, 0.02, 0.04, 0.08])))
    chain = fresh(120)
    for _ in range(25):
        chain = edited(rng, chain, 0.015)
        texts.append(chain)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed, monkeypatch):
    if seed == 2:  # many regions need rounds of pivots
        monkeypatch.setattr(jaccard, "SMALL", 2)
        monkeypatch.setattr(jaccard, "LARGE", 3)
        monkeypatch.setattr(jaccard, "FREQUENT", 10**9)
    rows = list(enumerate(corpus(seed)))
    got = jaccard.components(docs(spark, [t for _, t in rows]), Workspace(spark)).collect()
    assert sorted(tuple(r) for r in got) == brute_components(rows)


def test_jaccard_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(7)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))
    rows = list(enumerate(edited(rng, base, rng.randint(1, 6) / 150) for _ in range(400)))
    pairs, table = [], Workspace.table

    def counted(self, df, name):
        made = table(self, df, name)
        pairs.extend([made.count()] if name == "wanted" else [])
        return made

    monkeypatch.setattr(Workspace, "table", counted)
    got = jaccard.components(docs(spark, [t for _, t in rows]), Workspace(spark)).collect()
    assert sorted(tuple(r) for r in got) == brute_components(rows)
    assert sum(pairs) <= 8 * len(rows)  # pairs that are looked at are some for each text, not a share of all pairs


def test_jaccard_edges(spark):
    assert jaccard.components(docs(spark, []), Workspace(spark)).count() == 0
    got = jaccard.components(docs(spark, ["a b c d e f"], [(None, "a b c d e f"), (None, "alone here"), (None, None), (0, "a b c d e f"), (7, None)]), Workspace(spark)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(0, 2, 0), (None, 2, 0), (None, 1, None), (None, 0, None), (0, 2, 0), (7, 0, 7)]))


def test_decontamination(spark):
    rng = random.Random(5)
    fresh = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    items = [fresh(k) for k in (3, 5, 6, 9, 20, 40, 40, 1, 2, 4)] + [None, "", " "]
    texts = [*ODD, *(fresh(50) for _ in range(5))]
    for item in items[:10]:
        texts += [item, fresh(300) + " " + item.upper() + " " + fresh(200), fresh(9) + " " + " ".join(item.split()[: max(1, len(item.split()) * 3 // 4)]) + " " + fresh(5), edited(rng, item, 0.02) + " " + fresh(30)]
    texts.append(fresh(60_000) + " " + items[5] + " " + fresh(60_000))
    table = docs(spark, texts, [(None, items[4])]).withColumnRenamed("lang", "items").withColumnsRenamed({"source": "_key", "n_chars": "key"})
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(4, items[4]), (None, items[5])], "item_id long, text string")
    expected = {}
    for i, t in [*enumerate(texts), (None, items[4])]:
        own, words = shingled(t), re.findall(r"[^ \t-\r]+", (t or "").lower())
        # An item of fewer than five words is a run of the text's words.
        short = lambda x: any(words[k : k + len(x)] == x for k in range(len(words) - len(x) + 1))  # noqa: B023, E731
        holds = lambda x: short(x.split()) if len(x.split()) < 5 else 100 * len(shingled(x) & own) >= 75 * len(shingled(x))  # noqa: B023, E731
        expected[i] = [k for k, x in enumerate(items) if shingled(x) and holds(x)]
    for limit in (10**6, 0):
        found = decontamination.search(table, benchmark, broadcast=limit)
        got = {r.doc_id: r for r in found.collect()}
        assert {i: r["items"] for i, r in got.items()} == expected
        assert all((r.containment >= 0.75) == bool(r["items"]) and (r["_key"], r["key"]) == ("s", 0) for r in got.values())
        assert decontamination.search(docs(spark, []), benchmark, broadcast=limit).count() == 0
    assert sum(map(bool, expected.values())) > 12
    assert decontamination.search(docs(spark, []), benchmark).count() == 0
    assert decontamination.search(table, benchmark.limit(0)).where("containment > 0").count() == 0


def test_minima_cannot_all_be_missed():
    assert all(decontamination.minima(n) > n - -(-n * 75 // 100) for n in range(1, 3000))


def gram_counts(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        p = f" {w} "
        for k in (1, 2, 3):
            out.update(g for i in range(len(p) - k + 1) if (g := p[i : i + k]).strip() and (k < 3 or g[1] != " "))
    return out


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abAB é.1ß\n日", max_size=80))
def test_grams(text):
    def name(code):
        points = []
        while code:
            points.insert(0, chr(code & (1 << 21) - 1))
            code >>= 21
        return "".join(points)

    for piece in (3, 1 << 19):
        language.PIECE = piece
        codes, counts = language.grams(text)
        assert {name(int(c)): int(n) for c, n in zip(codes, counts, strict=True)} == dict(gram_counts(text))
    language.PIECE = 1 << 19


def test_language(spark):
    got = queries.op5_language(spark, SF).collect()
    table = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(table)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == table[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    profiles = language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    table = docs(spark, ["", None, "123 !", "the and of"])
    told = {r.doc_id: r.p for r in table.select("doc_id", language.predicted(spark, table["text"], profiles).alias("p")).collect()}
    assert [told[i].lang for i in range(3)] == ["und"] * 3 and told[3].lang == "en"
    assert {r.lang for r in table.select(language.predicted(spark, table["text"], {}).alias("p")).select("p.lang").collect()} == {"und"}
    assert language.learn(docs(spark, [])) == {}


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark):
    texts = [*ODD, "CC-BY 4.0, cc by. All rights RESERVED general public\nlicense", "cc by " * 50, "all rights reservedly", "rights reserved all rights", "Released under the MIT License.", "licensed under the GNU General Public License, version 3.", "© 2020 Permission is hereby granted, free of charge, to any person obtaining a copy", "SPDX-License-Identifier: Apache-2.0", "a" * 200 + " general public license"]
    table = docs(spark, texts, [(None, "cc by")])
    got = {r.doc_id: r for r in licenses.scan(table).collect()}
    for i, t in [*enumerate(texts), (None, "cc by")]:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t), i
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    n = len(ODD)
    assert got[n + 4].labels == "mit" and "gpl-3.0" in got[n + 5].labels and got[n + 6].labels == "mit" and got[n + 7].labels == "apache-2.0"
    assert len(licenses.rules()) > 300
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in licenses.scan(table).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(texts[r.doc_id])


def sampled(rng, parsed):
    """A text that a parsed regular expression matches."""
    out = ""
    for op, value in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "ANY":
            out += "x"
        elif kind == "IN":
            op, value = rng.choice(value)
            out += chr(value) if str(op) == "LITERAL" else chr(rng.randint(*value)) if str(op) == "RANGE" else "7"
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, what = value
            out += "".join(sampled(rng, what) for _ in range(rng.randint(low, min(int(high), low + 2))))
        elif kind == "SUBPATTERN":
            out += sampled(rng, value[3])
        elif kind == "BRANCH":
            out += sampled(rng, rng.choice(value[1]))
        else:
            raise ValueError(kind)
    return out


def test_license_gate_holds_all_that_rules_match():
    rng = random.Random(4)
    rules, patterns = licenses.rules(), licenses._compiled()[2]
    for i, rule in enumerate(rules):
        parsed = re._parser.parse(rule.pattern)
        for text in {sampled(rng, parsed) for _ in range(60)}:
            found = licenses.detect(text, list(range(len(rules))))
            gated = [k for k, x in enumerate(rules) if set(x.keywords) & set(text.split())]
            assert patterns[i].search(text) and i in gated, (rule, text)
            assert licenses.detect(text, gated) == found, (rule, text)


def test_license_joined_versions(spark):
    texts = {"Licensed under GPLv2": "gpl-2.0", "licensed under apache2": "apache-2.0", "released under the LGPLv2.1": "lgpl-2.1", "under AGPLv3 license": "agpl-3.0", "MPL2 license": "mpl-2.0", "License: GPL v3": "gpl-3.0", "covered by EUPLv1.2": "eupl-1.2", "provided under CDDL": "cddl-1.0", "GPLv1 licence": "gpl-1.0"}
    got = {r.doc_id: r.labels for r in licenses.scan(docs(spark, list(texts))).collect()}
    assert got == dict(enumerate(texts.values()))


def test_licenses_of_a_very_long_text(spark):
    got = licenses.scan(docs(spark, ["license mit " * 200_000, "license mit license mit"])).orderBy("doc_id").collect()
    long, short = got
    assert (long.n_words, long.labels, long.score) == (400_000, short.labels, short.score)
    assert [tuple(s) for s in long.spans[:3]] == [tuple(s) for s in short.spans[:3]] and len(long.spans) == 399_999
    assert licenses.scan(docs(spark, [])).count() == 0


def test_license_suppression():
    text = "released under the mit license and mit license 2 mit"
    rules = licenses.rules()
    kept = licenses.detect(text, list(range(len(rules))))
    spans = [(a, b) for a, b, _ in kept]
    taken = []
    for a, b, r in sorted(((*m.span(), i) for i, p in enumerate(licenses._compiled()[2]) for m in p.finditer(text)), key=lambda d: (-rules[d[2]].priority, d[0] - d[1], d[0], d[2])):
        if not any(x <= a and b <= y for x, y in taken):
            taken.append((a, b))
    assert sorted(spans) == sorted(taken)


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in table] + [(-1 - i, t) for i, t in enumerate([*ODD, "it's <|endoftext|> DON'T é a", "x " * 9000])] + [(None, "null id"), (5, "again")]
    files = tokens.write(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark).folder("t"), path, width=64, rows=4)
    got = tokens.read(spark, files).collect()
    expected, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r for r in map(tuple, got)), key=lambda r: r[1]) == expected
    file = tokens.TokenFile(files[0][1])
    ids, mask = file.sequence(0)
    assert len(ids) == len(mask) == 64
    assert tokens.read(spark, tokens.write(spark.createDataFrame([], "doc_id long, text string"), Workspace(spark).folder("t"), path)).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("mask", [(1 << 64) - 1, 3])  # with two bits, almost all words share a hash
def test_word_coder(mask, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, scan = Tokenizer.from_file(path), words._scan
    monkeypatch.setattr(words, "_scan", lambda *a: (scan(*a)[0] & np.uint64(mask), *scan(*a)[1:]))
    special = ["a <|endoftext|> b <|ENDOFTEXT|> c", "x <|ENDOFTEXT|>", "<|endoftext|> é", "Don't DON'T <|StartOfText|><|startoftext|>"]
    runs = thue_morse(1024), thue_morse(1024).translate(str.maketrans("ab", "ba"))
    for texts in (special, special[::-1], [*runs, " ".join(runs), "", None, "A a a A"]):
        coder = tokens.WordCoder(path)
        got = [x for ids, counts in coder.encode(pa.array(texts, pa.string()), 1) for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert [x.tolist() for x in got] == [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_word_hashes_of_like_words():
    runs = thue_morse(1024), thue_morse(1024).translate(str.maketrans("ab", "ba"))
    block = next(words.blocks(pa.array([" ".join(runs)])))
    assert block.hashes[0] != block.hashes[1]


def test_topk(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(300, 12)).astype(np.float32)
    values[::7] = values[0]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(values)] + [(1000, None), (1050, [0.1, None] + [0.0] * 10), (1100, [float("nan")] * 12), (1150, [float("inf")] * 12), (None, [1.0] * 12), (1200, [1.0, 2.0]), (1201, [0.5, 0.25]), (3, [float(x) for x in values[3]])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ok = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-int(v @ c), i) for i, c in ok if i != q and len(c) == len(v))[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_k(table.where("vec_id % 50 = 0"), table).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert topk.top_k(table.limit(0), table).count() == 0


def test_topk_deals_a_bounded_number_of_copies(spark, monkeypatch):
    """Queries are copied for tasks of the cores there are, however many shuffle partitions, and each meets each candidate once."""
    rng = np.random.default_rng(5)
    values = rng.integers(-40, 40, (900, 6)) / 256
    values[100:400] = values[0]
    values[500] = 2.0**14
    order = rng.permutation(900).tolist()
    table = spark.createDataFrame([(i, values[i].tolist()) for i in order], "vec_id long, embedding array<double>").repartition(3)
    queries = table.where("vec_id % 20 = 0")
    whole = np.floor(values * 256).astype(int)
    score = whole @ whole.T
    expected = [(q, k + 1, i, int(score[q, i])) for q in range(0, 900, 20) for k, i in enumerate(sorted((i for i in range(900) if i != q), key=lambda i: (-score[q, i], i))[:5])]
    for name, value in (("QUERIES", 8), ("CANDIDATES", 64), ("ROWS", 4), ("FIRST", 7)):
        monkeypatch.setattr(topk, name, value)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    copies = set()
    try:
        for column, left, partitions in ((1 << 20, 1 / 8, 4), (1 << 20, 1.0, 400), (512, 1 / 8, 4)):
            monkeypatch.setattr(topk, "COLUMN", column)
            monkeypatch.setattr(topk, "LEFT", left)
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert sorted(tuple(r) for r in topk.top_k(queries, table).collect()) == sorted(expected)
            met = topk.dealt(queries.coalesce(1), table).where("not candidates")
            if column > 512:
                copies.add(met.count())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert copies == {6 * topk.TASKS * spark.sparkContext.defaultParallelism}


def test_best_by_bounds_and_without():
    """Candidates in segments of their own: bounds prune, and what they leave is computed as a rectangle or one by one."""
    rng = np.random.default_rng(6)
    at, sign = np.repeat(np.arange(16), 40), rng.choice([-1, 1], 640)
    vectors = np.zeros((640, 64))
    for row, (a, s) in enumerate(zip(at, sign, strict=True)):
        vectors[row, 4 * a : 4 * a + 4] = s * (90 + rng.integers(0, 3, 4))
    ids, queries = np.arange(640), np.arange(0, 640, 10)
    score = (vectors[queries] @ vectors.T).astype(int)
    expected = {(int(q), i, int(score[r, i])) for r, q in enumerate(queries) for i in sorted((i for i in range(640) if i != q), key=lambda i: (-score[r, i], i))[:5]}
    used = []
    for few in (0, 1 / 64, 1):
        for step in (64, 640):
            best = topk.Best(queries, vectors[queries], 5)
            levels = best._levels
            best._levels = lambda v, f=levels: used.append(f(v)) or used[-1]
            topk.FEW, kept = few, topk.FEW
            try:
                for low in range(0, 640, step):
                    best.meet(ids[low : low + step], vectors[low : low + step])
            finally:
                topk.FEW = kept
            assert set(zip(*(c.to_pylist() for c in best.found().columns), strict=True)) == expected
    assert any(used)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (20, 13)).astype(float), rng.integers(-300, 300, (30, 13)).astype(float)
    for s in topk.SEGMENTS:
        bound = topk.segment_features(a, s) @ topk.segment_features(b, s).T
        assert (bound + 1e-6 >= a @ b.T).all()
    big = np.array([[2.0**40, 3.0]])
    assert topk.inner_products(big, big)[0, 0] == 2**63 - 1


def brute_ppm(training, texts, order=3):
    seen = defaultdict(Counter)
    stream = lambda t: [*([256] * order), *(t or "").encode(), 257]
    for t in training:
        s = stream(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1
    out = []
    for t in texts:
        s, total = stream(t), 0.0
        for i in range(order, len(s)):
            excluded = set()
            for k in range(order, -1, -1):
                context = seen.get(tuple(s[i - k : i]))
                if context is None:
                    continue
                left = {x: n for x, n in context.items() if x not in excluded}
                whole = sum(left.values()) + len(left)
                if s[i] in left:
                    total += math.log10(left[s[i]] / whole)
                    break
                if left:
                    total += math.log10(len(left) / whole)
                excluded |= set(context)
            else:
                total -= math.log10(257 - len(excluded))
        out.append(total)
    return out


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_ppm(spark, piece, monkeypatch):
    monkeypatch.setattr(ppm, "PIECE", piece)
    rng = random.Random(2)
    texts = [*ODD, *("".join(rng.choice("abcde éB.\n") for _ in range(rng.randint(1, 200))) for _ in range(60)), "zebra qué", "日本 語"]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    table = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, held_out boolean")
    training = [t for t, h in zip(texts, held, strict=True) if not h]
    counts = Counter(w for t in training for w in [*spaced(t), None])
    n, v = sum(counts.values()), len(counts)
    for groups in (4_000_000, 7):
        monkeypatch.setattr(ppm, "GROUP", groups)
        got = {r.doc_id: r for r in ppm.score(table, Workspace(spark)).collect()}
        assert len(got) == len(texts)
        for i, (t, expected) in enumerate(zip(texts, brute_ppm(training, texts), strict=True)):
            w = [*spaced(t), None]
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
            assert got[i].base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
            assert got[i].score == pytest.approx(expected, rel=1e-5), i
    assert ppm.score(table.limit(0), Workspace(spark)).count() == 0
    alone = ppm.score(table.withColumn("held_out", table["doc_id"].isNotNull()).limit(3), Workspace(spark)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in alone)


@pytest.mark.parametrize("most", [1, 64])
def test_ppm_with_more_nodes_than_are_broadcast(spark, most, monkeypatch):
    monkeypatch.setattr(ppm, "NODES", most)
    monkeypatch.setattr(ppm, "PART", 100)
    monkeypatch.setattr(ppm, "GROUP", 200)
    rng = random.Random(5)
    texts = [*ODD, *("".join(rng.choice("abcdefgh日本語é😀\n") for _ in range(rng.randint(1, 80))) for _ in range(40)), "zebra qué"]
    held = [i % 4 == 1 for i in range(len(texts))]
    table = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r.score for r in ppm.score(table, Workspace(spark)).collect()}
    expected = brute_ppm([t for t, h in zip(texts, held, strict=True) if not h], texts)
    assert got == {i: pytest.approx(e, rel=1e-5) for i, e in enumerate(expected)}
