"""The stages of the pipeline, each against plain Python on its own input."""

import base64
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from sievery.llm import jaccard
from sievery.storage import Workspace
from tests.llm.test_text import brute_components, shingled

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, work = spark.read.parquet(f"{SF}/documents.parquet"), Workspace(spark)
    columns = docs.columns
    extra = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "12 34 !", "en", "x", 7), (10**6 + 2, "12 34 !", None, "x", 7)], docs.schema)
    benchmark = [shingled(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = work.table(docs.unionByName(extra), "docs")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = work.table(stage(spark, docs, SF), name)
        rows = docs.collect()
        ids = Counter(r.doc_id for r in rows)
        if name != "token_output":
            assert docs.columns == columns
        if name == "language_id":
            gone = {r.doc_id for r in before} - set(ids)
            assert gone >= {10**6, 10**6 + 1, 10**6 + 2} and all(i >= 10**6 for i in gone)
        if name == "ngram_jaccard_join":
            keep = {doc_id for doc_id, n, c in brute_components([(r.doc_id, r.text) for r in before]) if not n or c == doc_id}
            assert set(ids) == keep and len(rows) == len(keep)
        if name == "decontaminate":
            keep = {r.doc_id for r in before if not any(100 * len(b & shingled(r.text)) >= 75 * len(b) for b in benchmark)}
            assert set(ids) == keep and len(keep) < len(before)
        if name == "mix_sources":
            size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before}
            source = Counter()
            for r in before:
                source[r.source] += size[r.doc_id]
            assert max(ids.values()) <= 2
            total = sum(size[i] * n for i, n in ids.items())
            assert abs(total - 1.5 * sum(size.values())) <= len(source) * max(size.values()) / 2
        if name == "token_output":
            assert ids == Counter(r.doc_id for r in before)
            assert [r.start for r in sorted(rows, key=lambda r: r.start)] == [sum(x.n_tokens for x in rows if x.start < r.start) for r in sorted(rows, key=lambda r: r.start)]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_mix_repeated_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(corpus_pipeline, "IDS_BROADCAST", broadcast)
    rows = [(1, "a b c", "en", "s", 5)] * 3 + [(1, "d e f", "en", "s", 5), (None, "x", "en", None, 1), (2, "g h", "en", "t", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    assert max(Counter(r.text for r in mixed).values()) <= 6
    assert set(r.text for r in mixed) <= {"a b c", "d e f", "x", "g h"}


def test_language_id_drops_gibberish_and_unlearned_languages(spark):
    rng = random.Random(1)
    clean = ["All human beings are born free and equal in dignity and rights.", "Tous les êtres humains naissent libres et égaux.", "The cat sat on the mat."]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(3000)), "\n".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(40))]
    junk.append("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.")
    junk.append("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6 + i, t, None, "x", len(t)) for i, t in enumerate([*clean, *junk])], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(extra), SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()} | {10**6 + i for i in range(len(clean))}


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_near_copies_with_repeated_and_null_ids(spark, monkeypatch, broadcast):
    monkeypatch.setattr(corpus_pipeline, "IDS_BROADCAST", broadcast)
    monkeypatch.setattr(jaccard, "IDS_BROADCAST", broadcast)
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(5, text(0)), (9, text(0)), (9, text(1)), (7, text(2)), (7, text(2)), (7, text(2)), (None, text(3)), (None, text(3)), (None, text(4)), (8, text(4)), (None, ""), (None, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, SF).collect())
    assert kept == Counter([(5, text(0)), (9, text(1)), (7, text(2)), (None, text(3)), (8, text(4)), (None, ""), (None, ""), (5, None)])


def test_stages_with_clashing_columns_long_texts_and_no_rows(spark):
    clashing = "doc_id long, text string, lang string, source string, n_chars long, row long, told long, number long, items string, containment double, n long, place long, _id long, copies long, _size long, `_p` long"
    more = (1, 2, 3, "kept", 0.5, 4, 5, 6, 7, 8, 9)
    rows = [(i, t, lang, s, 0, *more) for i, t, lang, s in [(1, "the cat sat on the mat and the dog sat by the door of the house", "en", "s"), (2, "the people of the town went to the river with the children " * 20_000, "en", "s"), (3, "the long day of the river and the house by the sea was good", "en", None), (None, "the people and the sea", None, "t")]]
    docs, work = spark.createDataFrame(rows, clashing), Workspace(spark)
    for name, stage in corpus_pipeline.STAGES:
        empty = work.table(stage(spark, spark.createDataFrame([], clashing), SF), name)
        assert empty.count() == 0
        docs = work.table(stage(spark, docs, SF), name)
        if name != "token_output":
            assert docs.columns == [f.split()[0].strip("`") for f in clashing.split(", ")] == empty.columns
            assert all(tuple(r)[5:] == more for r in docs.collect())
        if name in ("language_id", "ngram_jaccard_join", "decontaminate"):
            assert {r.doc_id for r in docs.collect()} == {1, 2, 3, None}
    assert docs.count() > 0
