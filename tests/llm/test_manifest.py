"""Merkle manifests, collocations and toxicity against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievery.llm import collocations, merkle, toxicity
from sievery.llm.words import PLAIN, blocks
from sievery.storage import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    i, text, lang, source, n = row
    values = [i, source, lang, None if n is None else n + more, text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def steps_of(levels, at):
    for level in levels[:-1]:
        yield at % 2 == 1, level[at ^ 1] if at ^ 1 < len(level) else None
        at //= 2


def folded(value, steps):
    for left, other in steps:
        value = H(value) if other is None else H(other, value) if left else H(value, other)
    return value


def manifest_of(rows, tampered):
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees, placed = {}, {}
    for lang in langs:
        placed[lang] = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = levels_of([leaf_of(r) for r in placed[lang]])
    upper = levels_of([trees[x][-1][0] for x in langs])
    for k, lang in enumerate(langs):
        for at, row in enumerate(placed[lang]):
            steps = [*steps_of(trees[lang], at), *steps_of(upper, k)]
            start = leaf_of(row, 1) if tampered(row) and row[4] is not None else leaf_of(row)
            root, end = upper[-1][0], folded(start, steps)
            yield (row[0], leaf_of(row), trees[lang][-1][0], root, H(*[s for _, s in steps if s]), end, end == root)


@pytest.mark.parametrize("bits", [2, 12])
def test_merkle(spark, bits):
    rows = [(i * 7 % 53, f"text {i} é", ["en", "de", None, "", "zz"][min(i % 9, 4)], ["a", None, ""][i % 3], [i, None, 2**62][i % 3]) for i in range(90)]
    rows += [(None, None, "en", None, None), (None, "", "en", "", 0), (3, "again", "en", "a", 1), (3, "again", "en", "a", 1), (7, "alone", "fr", "a", 5), (14, "x" * 300_000, "en", "a", 9)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"root": F.lit("clash"), "tree": F.lit("clash"), "proof": F.lit(1)})
    tampered = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    work = Workspace(spark)
    told = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    thin = merkle.manifest(docs, work, told, bits).withColumn("folded_root", merkle.fold(F.coalesce("tampered_leaf", "leaf"), F.col("proof")))
    got = thin.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256), "folded_root", F.col("folded_root") == F.col("root")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, manifest_of(rows, tampered)))
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_merkle_edges(spark):
    work = Workspace(spark)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), work).count() == 0
    one = merkle.manifest(spark.createDataFrame([(5, "t", None, "s", 1)], SCHEMA), work).collect()
    assert [(r.leaf, r.subroot, r.root, r.proof) for r in one] == [(leaf_of((5, "t", None, "s", 1)),) * 3 + ([],)]


def test_combine_takes_nodes_in_any_order():
    leaves = [H(str(i)) for i in range(11)]
    levels = levels_of(leaves)
    nodes = merkle.combine(sorted(enumerate(leaves), key=lambda x: x[0] * 5 % 11), 11, 60)
    assert nodes == {(k, i): v for k, level in enumerate(levels) for i, v in enumerate(level)}


def phrases_of(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covering = defaultdict(int)
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covering[p[i : i + k]] = max(covering[p[i : i + k]], a)
        found = []
        for p, a in frequent.items():
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if 100 * covering[p] < 80 * a:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            yield (lang, rank, p.decode(), -a, left, right, n[lang], -score)


def noisy_texts():
    rng, words = np.random.default_rng(5), ["the", "of", "The", "ÉTÉ", "été", "a\x00b", "x y", "-", "new", "york", "city", "und", "it's", "\U0001f600"]
    rows = []
    for _ in range(240):
        picked = rng.choice(words, size=rng.integers(0, 60), p=[0.2, 0.15, 0.05] + [0.6 / 11] * 11)
        ends = rng.choice([" ", "  ", "\t", ". ", "\n", ",", "\r\n", " ;!"], size=len(picked), p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])
        rows.append((["en", None, "und", "zh", ""][min(int(rng.integers(0, 8)), 4)], "".join(w + e for w, e in zip(picked, ends, strict=True))))
    return rows + [("en", None), (None, ""), ("en", "new york city " * 40), ("aa", "aa aa aa aa aa. aa")] + [("en", "New York, new york")] * 9


@pytest.mark.parametrize("batch,bits,piece", [(60, 16, 40), (1 << 20, 4, 7)])
def test_collocations(spark, monkeypatch, batch, bits, piece):
    # Few bits: cells that several phrases share, which all tasks have to report.
    monkeypatch.setattr(collocations, "BITS", (bits, 60 if bits > 4 else 4))
    monkeypatch.setattr(collocations, "PIECE", piece)
    rows = noisy_texts()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6).withColumns({"phrase": F.lit("clash"), "n": F.lit(0), "id": F.lit(1)})
    got = collocations.collocations(docs, Workspace(spark), least=8, top=25, batch=batch).collect()
    expected = list(phrases_of(rows, 8, 25))
    assert len(expected) > 60 and max(r[1] for r in expected) == 25
    assert sorted(map(tuple, got)) == sorted(expected)


def test_collocations_read_the_texts_twice_however_many_candidates(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [("en" if i % 3 else "de", " ".join(f"w{int(k)}" for k in rng.zipf(1.6, 60) % 300)) for i in range(300)]
    monkeypatch.setattr(collocations, "PART", 3000)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    context, jobs = spark.sparkContext, []
    for batch in (1 << 20, 50):
        context.setJobGroup(f"collocations-{batch}", "")
        counts, totals = collocations.counted(docs, Workspace(spark), 8, batch)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"collocations-{batch}")))
        assert counts.where("words > 1").count() > 200 and {tuple(r) for r in totals.collect()} == {("en", 200 * 60), ("de", 100 * 60)}
        context.setJobGroup("other", "")
        got = collocations.collocations(docs, Workspace(spark), least=8, top=200, batch=batch).collect()
        assert sorted(map(tuple, got)) == sorted(phrases_of(rows, 8, 200))
    assert jobs[0] == jobs[1] > 0


def test_heavy_cells_go_back_to_the_parts_that_touched_them():
    rows = [(3, [5, 9], [20, 1]), (4, [5, 7], [15, 29]), (3, [7], [1]), (8, [9], [28]), (4, [5], [1])]
    cells = [collocations.packed(np.diff(np.array(c, np.uint64), prepend=np.uint64(0))) for _, c, _ in rows]
    table = pa.table({"block": [0] * 5, "part": pa.array([p for p, _, _ in rows], pa.int32()), "cells": cells, "counts": [collocations.packed(np.array(n)) for _, _, n in rows]})
    told = collocations._heavy(30)(table).to_pydict()
    assert {p: np.cumsum(collocations.unpacked(c)).tolist() for p, c in zip(told["part"], told["cells"], strict=True)} == {3: [5, 7], 4: [5, 7]}


def test_a_part_that_changed_between_the_passes_is_told():
    texts = [pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["a b"]})]
    own = np.sort(next(collocations._phrases(texts))[0].hashes)
    assert sorted(collocations._candidates(texts, own, 64)["en"][0]) == [b"a", b"a b", b"b"]
    with pytest.raises(RuntimeError, match="same order"):
        collocations._candidates(texts, np.sort(np.append(own, np.uint64(1))), 64)


def test_collocations_of_a_long_text_and_of_none(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string"), Workspace(spark)).count() == 0
    text = " ".join(f"w{i * i % 977}" + "." * (i % 5 == 0) for i in range(120_000))
    got = collocations.collocations(spark.createDataFrame([("en", text)], "lang string, text string"), Workspace(spark), least=20).collect()
    assert sorted(map(tuple, got)) == sorted(phrases_of([("en", text)], 20, 2000)) and got


def test_automaton_codes_of_several_letters(monkeypatch):
    monkeypatch.setattr(collocations, "LETTERS", 3)
    words = [f"w{i}".encode() for i in range(40)]
    pairs = [b" ".join(words[i : i + k]) for i in range(37) for k in (2, 3)]
    automaton = collocations.Automaton(np.arange(len(words + pairs)), words + pairs)
    assert automaton.letters == 4 and automaton.scan([b"w1 w2 W3 x w4", b"w4 w5. w6 w7\tw8", b""]) == 10
    assert {(words + pairs)[i].decode(): n for i, n in enumerate(automaton.counts.tolist()) if n and i >= 40} == {"w1 w2": 1, "w2 w3": 1, "w1 w2 w3": 1, "w4 w5": 1, "w6 w7": 1, "w7 w8": 1, "w6 w7 w8": 1}


def test_gradient_of_the_noisy_or():
    rng = np.random.default_rng(3)
    label, document, count = np.array([1, 0, 1, 0]), np.array([0, 0, 1, 3, 3]), np.array([1, 3, 1, 2, 1])
    of, place, weights = np.array([0, 0, 1, 2, 3, 4, 4]), np.array([0, 2, 1, 1, 0, 2, 3]), rng.normal(size=6)
    args = label, document, count, of, place
    loss, slope = toxicity.gradient(weights, *args)
    for i in range(6):
        moved = weights.copy()
        moved[i] += 1e-6
        assert (toxicity.gradient(moved, *args)[0] - loss) / 1e-6 == pytest.approx(slope[i], abs=1e-4)


def plain_score(text, weights, sentence, document):
    """Score and sentences to blame, from weights by the bytes of words and of their beginnings."""
    rest, blamed = np.logaddexp(0, document), []
    data = (text or "").encode()
    for part in re.finditer(rb"[^.!?\n\r]+", data):
        words = list(re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", part.group()))
        if not words:
            continue
        low = {w.group().lower() for w in words}
        features = {(w, None) for w in low} | {(w[:k], k) for w in low for k in range(3, 9) if len(w) > k}
        z = sentence + sum(weights.get(x, 0.0) for x in features)
        rest += np.logaddexp(0, z)
        if 1 / (1 + np.exp(-z)) >= 0.5:
            place = lambda at: len(data[: part.start() + at].decode("utf-8", "ignore"))  # noqa: B023, E731
            blamed.append((place(words[0].start()), place(words[-1].end())))
    return 1 - np.exp(-rest), blamed


def test_scores_against_plain_python(spark):
    weights = {(b"idiot", None): 7.0, (b"you", None): 1.5, ("ré".encode(), 3): 5.5, (b"trash", None): 3.0, (b"tras", 4): 2.0, (b"nice", None): -4.0}
    texts = ["You idiot. Nice day!", "ré réeux, oui\nnon", "TRASH trashcan\r\n\r\nyou nice idiot?", "", None, "...", "é" * 30 + " idiot", "nice", "you " * 200_000 + ". idiot"]

    def code(word, k):
        block = next(iter(blocks(pa.array([(word + (b"" if k is None else b"z")).decode()]), PLAIN)))
        return [int(h[0]) for h, w in toxicity.Sentences(block).features() if len(h)][0 if k is None else k - 2]

    pairs = sorted((code(*f), w) for f, w in weights.items())
    model = toxicity.Model(np.array([c for c, _ in pairs], np.uint64), np.array([w for _, w in pairs]), -5.0, -3.0)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").withColumns({"score": F.lit("clash"), "label": F.lit(1), "finder": F.lit(2)})
    got = toxicity.score(docs, model).orderBy("id").collect()
    for row, text in zip(got, texts, strict=True):
        score, blamed = plain_score(text, weights, -5.0, -3.0)
        assert row.score == pytest.approx(score, rel=1e-9) and [(s.start, s.end) for s in row.blamed] == blamed
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxic_sentences_are_learned_from_labels_of_documents(spark):
    rng = np.random.default_rng(7)
    clean, bad = [f"word{i}" for i in range(80)], ["idiot", "scum", "moron"]
    rows = []
    for i in range(600):
        sentences = [" ".join(rng.choice(clean, 6)) for _ in range(int(rng.integers(1, 9)))]
        if i % 4 == 0:
            at = int(rng.integers(0, len(sentences)))
            sentences[at] += " " + rng.choice(bad)
        rows.append((i, ". ".join(sentences), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (0, None), (10**6, 1)], "doc_id long, toxic int"))
    model = toxicity.learn(docs.where("doc_id < 400"), labels, Workspace(spark))
    for r in toxicity.score(docs.where("doc_id >= 400"), model).collect():
        assert (r.score >= 0.7) == (r.toxic == 1)
        assert all(any(b in r.text[s.start : s.end] for b in bad) for s in r.blamed) and len(r.blamed) == r.toxic
    none = toxicity.learn(docs.where("doc_id < 0"), labels, Workspace(spark))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_toxicity_held_out(spark):
    from sievery.llm import queries

    sf = "/root/testdata/sf0.1"
    found = queries.op13_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    n = Counter((r.toxic, r.predicted) for r in found.collect())
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85 and n[0, 1] / (n[0, 0] + n[0, 1]) < 0.02
