"""Records that are the same by several keys, rules as tables, and the streams of absence and sync, against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievery.operators import components, rules, state
from sievery.storage import Workspace


def groups_of(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for row, key in links:
        a, b = sorted((find(("r", row)), find(("k", key))), key=lambda v: (v[0] == "k", v[1] if v[0] == "r" else 0))
        root[b] = a
    found = defaultdict(set)
    for row, _ in links:
        found[find(("r", row))].add(row)
    return {row: min(g) for g in found.values() for row in g}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, f"chain{i // 1}") for i in range(60)] + [(i + 1, f"chain{i}") for i in range(59)]
    links += [(100 + rng.randrange(80), f"k{rng.randrange(70)}") for _ in range(120)] + [(200, "hot")] + [(200 + i, "hot") for i in range(300)]
    df = spark.createDataFrame([*links, *links[:5]], "row long, key string").unionByName(spark.createDataFrame([(None, "k1"), (999, None)], "row long, key string"))
    got = {r.row: r.component for r in components.components(df, Workspace(spark)).collect()}
    assert got == groups_of(links)


def test_deduplicated(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *[f"x{k}" for k in range(40)]]), rng.choice(["a", "b", "c", None]), rng.choice("mn"), rng.choice([None, *range(60)]), rng.choice([None, i]), rng.sample("pqrs", rng.randrange(3))) for i in range(120)]
    df = spark.createDataFrame([(i, k, t, o, d, v, g) for i, k, t, o, d, v, g in rows], "i long, key string, title string, org string, day int, value int, tags array<string>")
    df = df.withColumn("date", F.date_add(F.lit("2024-01-01"), F.col("day")))
    got = components.deduplicated(df, "i", F.col("key"), [F.col("title"), F.col("org")], F.col("date"), ["value"], ["tags"], Workspace(spark), 1).collect()
    links = [(r[0], f"own{r[0]}") for r in rows] + [(r[0], f"key{r[1]}") for r in rows if r[1]]
    alike = defaultdict(list)
    for r in rows:
        if r[2]:
            alike[r[2:4]].append((r[4] is not None, r[4] or 0, r[0]))
    for same, members in alike.items():
        turn, last = 0, None
        for dated, day, i in sorted(members):
            if last is not None and (dated != last[0] or day - last[1] > 1):
                turn += 1
            last = (dated, day)
            links.append((i, f"run{same}{turn}"))
    parts = groups_of(links)
    expected = []
    for part in sorted(set(parts.values())):
        members = [r for r in rows if parts[r[0]] == part]
        valued = [r for r in members if r[5] is not None]
        value = max(valued, key=lambda r: (r[4] is not None, r[4] or 0, r[0]))[5] if valued else None
        expected.append((part, len(members), min(r[0] for r in members), value, list(dict.fromkeys(t for r in members for t in r[6]))))
    assert sorted((r.component, r.members, r.first, r.value, r.tags) for r in got) == expected and any(e[1] > 2 for e in expected)


def test_contains_any(spark):
    rng = random.Random(3)
    said = ["".join(rng.choice("abcé /.") for _ in range(rng.randrange(30))) for _ in range(150)] + [None, "", "ABCÉ/ABC", "aaaaaaaaaaaa"]
    terms = ["".join(rng.choice("abcé/") for _ in range(rng.randrange(1, 7))) for _ in range(40)] + [None, "", "zz", "nowhere in here", "A", "aaaaa"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, text string")
    known = spark.createDataFrame(list(enumerate(terms)), "rule int, term string")
    got = rules.contains_any(df, "i", df.text, known, Workspace(spark)).collect()
    expected = {(i, k) for i, s in enumerate(said) for k, t in enumerate(terms) if s is not None and t and t.lower() in s.lower()}
    assert sorted(map(tuple, got)) == sorted(expected) and len(expected) > 50
    assert rules.contains_any(df, "i", df.text, known.limit(0), Workspace(spark)).count() == 0


def test_grace_as_a_stream_equals_the_replay_after_a_restart(spark, tmp_path):
    from sievery.streaming import grace

    rng = random.Random(2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", grace.PROVIDER)
    base = 1_700_000_000
    events = [(i, i % 3, base + i * 9_000 + rng.randrange(-20_000, 20_000), rng.random() < 0.85) for i in range(90)]
    schema = "event_id long, user_id long, seconds long, missing boolean"
    at = F.timestamp_seconds("seconds")
    batch = spark.createDataFrame(events, schema).withColumn("ts", at)
    expected = state.replay_missing(batch, ["user_id"], "ts", ["event_id"], F.col("missing"), 2, 1).select("event_id", "confirmations", "status").collect()
    late = [(1000 + u, u, base + 10**8, False) for u in range(3)] + [(2000 + u, u, base + 2 * 10**8, False) for u in range(3)]
    parts = [events[:40], events[40:], late[:3], late[3:]]

    def run(some):
        for k, part in some:
            spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / f"{k}"))
        read = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        told = grace.missing_stream(read.withColumn("ts", at), "user_id", "ts", "event_id", "missing", "12 hours", 2, 1)
        query = told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None

    # A second start goes on from the state that the first has left.
    run(list(enumerate(parts))[:2])
    run(list(enumerate(parts))[2:])
    got = spark.read.parquet(str(tmp_path / "out")).where("row < 1000").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and {r.status for r in expected} == {"live", "grace", "archived"}


def plain_sync(current, batch):
    failed = {s for s, _, _, ok, _ in batch if not ok}
    done = {s for s, *_ in batch} - failed
    new = {k: v for k, v in current.items() if k[0] not in done}
    for s, i, at, _, v in sorted(batch, key=lambda r: r[2]):
        if s in done and i is not None:
            new[s, i] = (current.get((s, i), (None,))[0] if (s, i) in current else new.get((s, i), (max(r[2] for r in batch if r[:2] == (s, i)),))[0], at, v)
    return new


def test_sync_publishes_versions(spark, tmp_path, monkeypatch):
    from sievery.streaming import sync

    rng = random.Random(8)
    schema = "source string, id long, at long, ok boolean, value int"
    batches = [[(s, rng.choice([None, *range(6)]), n * 1000 + k, not (s == "c" and n == 1), rng.randrange(99)) for k, s in enumerate(rng.choices("abcd"[: 3 + n % 2], k=25))] for n in range(4)]
    table, expected = sync.VersionedTable(spark, str(tmp_path / "table"), keep=2), {}
    held = lambda: {(r.source, r.id): (r.first_seen, r.last_seen, r.value) for r in table.read().collect()}
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        if n == 2:
            # Fails after the data are written and before they are published.
            with monkeypatch.context() as m:
                m.setattr(sync.VersionedTable, "_create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    table.publish(sync.synced(table.read(), df), f"s/{n}")
            assert held() == expected
        expected = plain_sync(expected, rows)
        assert table.publish(sync.synced(table.read(), df), f"s/{n}") and held() == expected
        assert not table.publish(sync.synced(table.read(), df), f"s/{n}") and held() == expected
    assert [v["version"] for v in table.versions()] == [2, 3]
    # Another writer has published the next version meanwhile.
    monkeypatch.setattr(table, "versions", lambda known=table.versions()[:-1]: known)
    with pytest.raises(OSError):
        table.publish(spark.createDataFrame(batches[0], schema), "s/9")


def test_sync_stream_goes_on_after_a_restart(spark, tmp_path):
    from sievery.streaming import sync

    schema = "source string, id long, at long, ok boolean, value int"
    table = sync.VersionedTable(spark, str(tmp_path / "table"))
    for n, rows in enumerate([[("a", 1, 1, True, 5), ("b", 1, 1, True, 6)], [("a", 2, 2, True, 7), ("b", None, 2, False, None)], [("b", None, 3, True, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in" / str(n)))
        read = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
        query = sync.sync_stream(read, table, "s").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        found = sorted((r.source, r.id, r.first_seen, r.last_seen) for r in table.read().collect())
        assert found == [[("a", 1, 1, 1), ("b", 1, 1, 1)], [("a", 2, 2, 2), ("b", 1, 1, 1)], [("a", 2, 2, 2)]][n]
