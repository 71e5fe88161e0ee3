"""Mixing, sharding and secret scans against plain Python."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievery.llm import mixing, secrets, sharding
from sievery.storage import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)


def target_of(sizes, weights=(3, 1, 2), share=1.5, most=2):
    left, targets = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}, {}
    rest = share * sum(sizes.values())
    while left:
        level = rest / sum(left.values())
        over = [s for s, w in left.items() if level * w > most * sizes[s]]
        for s in over:
            targets[s] = most * sizes[s]
            rest -= targets[s]
            del left[s]
        if not over:
            return targets | {s: level * w for s, w in left.items()}
    return targets


def test_mix(spark):
    rows = [(i, "w " * ((i * 37) % 50), ["a", "b", None, "Ü", "z"][i % 7 % 5]) for i in range(1500)] + [(3, None, "a"), (None, "x y", "b"), (None, "x y", "b"), (7, "q", "a"), (7, "q", "a")]
    work = Workspace(spark)
    got = mixing.mix(mixing.document_sizes(docs(spark, rows), work), work).collect()
    assert len(got) == len(rows)
    size, taken, target, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"])
    expected = target_of(size)
    for s in size:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
        assert {r.source_size for r in got if r.source == s} == {size[s]}
    again = mixing.mix(mixing.document_sizes(docs(spark, rows[::-1]), work), work).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_is_unbiased(spark):
    sizes = spark.createDataFrame([(i, "a" if i < 40 else "b", 10) for i in range(120)], "doc_id long, source string, size long")
    work, totals = Workspace(spark), defaultdict(int)
    for seed in range(12):
        for r in mixing.mix(sizes, work, seed=seed, fan_in=4).where("source = 'b'").collect():
            totals[r.doc_id] += r.copies
    spread = [v / 12 for v in totals.values()]
    # The rate of b is 1.25: its total is kept at each run, and over the seeds almost every document is taken twice at times.
    assert sum(spread) / len(spread) == pytest.approx(1.25, abs=0.02)
    assert all(1 <= x <= 1.8 for x in spread) and sum(x > 1 for x in spread) >= 0.9 * len(spread)


def test_mix_spreads_rows_that_are_alike(spark):
    rows = [(None, "w w w", "a")] * 400 + [(7, "w w", "a")] * 300 + [(i, "w", "b") for i in range(50)]
    work = Workspace(spark)
    got = mixing.mix(mixing.document_sizes(docs(spark, rows), work), work)
    level = next(x for x in os.listdir(work.path.removeprefix("file://")) if x.startswith("level0"))
    assert spark.read.parquet(f"{work.path}/{level}").selectExpr("max(size(out))").first()[0] <= 80
    found = got.collect()
    assert len(found) == len(rows) and all(r.taken <= 2 * r["size"] for r in found)
    for s in "ab":
        own = [r for r in found if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2


def test_mix_of_long_texts_and_clashing_columns(spark):
    work = Workspace(spark)
    table = docs(spark, [(1, "w " * 300_000, "a"), (2, "x y", "a"), (3, "z", "b")]).selectExpr("*", "1 AS size", "2 AS target", "3 AS place")
    got = {r.doc_id: r for r in mixing.mix(mixing.document_sizes(table, work), work).collect()}
    assert {i: r["size"] for i, r in got.items()} == {1: 300_000, 2: 2, 3: 1}


def test_mix_edges(spark):
    work = Workspace(spark)
    assert mixing.mix(mixing.document_sizes(docs(spark, []), work), work).count() == 0
    only_empty = mixing.mix(mixing.document_sizes(docs(spark, [(1, "", "a"), (2, None, None)]), work), work).collect()
    assert [(r.taken, r.target) for r in only_empty] == [(0, 0.0), (0, 0.0)]


def test_longest_first_is_the_heap():
    import heapq
    import random

    for seed in range(30):
        r = random.Random(seed)
        histogram = [(w, r.choice([1, 2, 5, 40, 300])) for w in r.sample(range(1, 60), r.randint(1, 12))]
        heap = [(0, s) for s in range(4)]
        for w, n in sorted(histogram, reverse=True):
            for _ in range(n):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + w, s))
        weights, loads = [w for w, n in histogram for _ in range(n)], [0] * 4
        for w, s in zip(weights, sharding.longest_first(weights, 4), strict=True):
            loads[s] += w
        assert sorted(loads) == sorted(load for load, _ in heap)


def test_shard(spark):
    rows = [(i, "t" * ((i * 7919) % 400), "s") for i in range(1200)] + [(None, None, None), (5, "", "s"), (None, "é", "s"), (9, "same", "s"), (9, "same", "s")]
    rows += [(3000 + i, "long " * 2000, "s") for i in range(3)] + [(4000, "x" * 30000, "s")]
    check_shards(sharding.shard(docs(spark, rows), Workspace(spark)).collect(), rows, 30001)
    # Of few bundles, the light groups share some.
    light = [(i, f"{i} " + "t" * ((i * 31) % 90), "s") for i in range(3000)]
    check_shards(sharding.shard(docs(spark, light), Workspace(spark), shards=4, bundles=64).collect(), light, 4000)


def check_shards(got, rows, within):
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    homes, loads, slots = defaultdict(set), [0] * 16, defaultdict(list)
    for r in got:
        homes[r.text_crc32, r["size"]].add(r.shard)
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    loads = [x for x in loads if x]
    assert max(loads) - min(loads) <= within


def test_shard_edges(spark):
    assert sharding.shard(docs(spark, []), Workspace(spark)).count() == 0
    clashing = docs(spark, [(1, "a", "s"), (None, None, None)]).selectExpr("*", "1 AS shard", "2 AS slot", "3 AS size", "4 AS bundle")
    assert sorted(r.slot for r in sharding.shard(clashing, Workspace(spark)).where("shard = 0").collect()) == [0]


BASE = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base_spans(text):
    found = [(m.start(), n, k, m.end()) for n, (k, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(text or "") if ok(m)]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    weak = "aB3dE5gH7jK9mN1pQ3sT5vX7zA9cE1gH3jK5mN7"
    texts = [
        None, "", "plain words only", f"😀 {key} and token = abc123def", "secret: token : abcdefgh", "PASSWORD='x1' apikey: \"longer_value\" Api_Key=short",
        "deadbeef" * 3 + " " + "deadbeef" * 2 + "x", f"see {weak} here", f"client_id: acme {weak} here", "user: bob at https://example.org/path",
        f"user: bob https://example.org/path {weak}", f"{weak} " + "x " * 600 + "client_id: acme", ("token=" + "a1" * 4 + " ") * 500, "token=" * 40 + "abcdef", key * 2,
    ]
    got = {r.doc_id: r for r in secrets.scan(docs(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, f"x {key}", "s")]), Workspace(spark)).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        strong = [f"{s.kind}:{s.start}:{s.end}" for s in got[i].spans if s.strong]
        assert strong == base_spans(t), i
    kinds = {i: {s.kind for s in r.spans} for i, r in got.items()}
    assert kinds[7] == set() and kinds[8] == {"identifier", "key"} and kinds[9] == set()
    assert kinds[10] == {"identifier", "key", "endpoint"} and kinds[11] == set() and kinds[None] == {"access"}


def test_secrets_over_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = secrets.scan(table, Workspace(spark)).select("doc_id", F.sha2(secrets.joined(F.filter("spans", lambda s: s["strong"])), 256).alias("h"))
    expected = {r.doc_id: hashlib.sha256(",".join(base_spans(r.text)).encode()).hexdigest() for r in table.collect()}
    assert {r.doc_id: r.h for r in got.collect()} == expected


def test_secrets_of_any_length(spark):
    key, url = "aB3dE5gH" * 40, "https://example.org/" + "p/" * 600 + "end"
    plain, name = "abcdefgh" * 40, "n" * 90
    texts = [f"client_id: acme {key[:89]} x", f"client_id: acme {key}== x", f"client_id: {name} {key} {url} x", f"client_id: acme {plain} x", f"{url} client_id: acme {key}"]
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in secrets.scan(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), Workspace(spark)).collect()}
    place = lambda i, kind, part: (kind, texts[i].index(part), texts[i].index(part) + len(part))
    assert got[0] == {place(0, "identifier", "client_id: acme"), place(0, "key", key[:89])}
    assert got[1] == {place(1, "identifier", "client_id: acme"), place(1, "key", key + "==")}
    assert got[2] == {place(2, "identifier", f"client_id: {name}"), place(2, "key", key), place(2, "endpoint", url)}
    assert got[3] == set()
    assert got[4] == {place(4, "identifier", "client_id: acme"), place(4, "key", key), place(4, "endpoint", url)}
