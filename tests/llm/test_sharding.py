import random
import zlib
from collections import defaultdict

from groundwork.llm import sharding
from groundwork.llm.sharding import schedule, shard_documents

from .helpers import EDGES, docs


def check(rows, got, shards):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    slots, where, load = defaultdict(list), defaultdict(set), [0] * shards
    for r in got:
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"], r["size"]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    return load


def test_groups_loads_and_slots(spark, monkeypatch):
    rng = random.Random(7)
    rows = EDGES + [(i, "é" * rng.randrange(1, 400)) for i in range(20, 3000)] + [(9000 + i, "copy" * 20) for i in range(300)]
    load = check(rows, shard_documents(docs(spark, rows), shards=6).collect(), 6)
    assert max(load) - min(load) <= 40
    # ranks within classes and slots within shards in parts
    monkeypatch.setattr(sharding, "NUMBERED", 40)
    assert check(rows, shard_documents(docs(spark, rows), shards=6).collect(), 6) == load


def test_long_texts_and_clashing_names(spark):
    rng = random.Random(17)
    rows = [(i, "x" * rng.randrange(200_000)) for i in range(60)] + [(100 + i, "y" * i) for i in range(400)]
    df = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, shard int, size int, key string")
    load = check(rows, shard_documents(df, shards=5).collect(), 5)
    assert max(load) - min(load) <= 200


def test_hot_group_and_empty(spark):
    rows = [(i, "same text") for i in range(500)] + [(1000 + i, f"other {i}") for i in range(300)]
    load = check(rows, shard_documents(docs(spark, rows), shards=3).collect(), 3)
    assert max(load) == 500 * (9 + 16)
    assert shard_documents(docs(spark, [])).collect() == []


def one_by_one(classes, shards):
    """The rule itself: every group, largest first, to the least-loaded shard."""
    load, where = [0] * shards, []
    for size, n, _ in sorted(classes, reverse=True):
        for _ in range(n):
            s = load.index(min(load))
            where.append((size, s))
            load[s] += size
    return load, where


def test_schedule():
    rng = random.Random(3)
    for shards in (1, 2, 7):
        classes = [(size, n, size * n) for size, n in {rng.randrange(1, 500): rng.choice([1, 2, 5, 40, 1000]) for _ in range(30)}.items()]
        plan, load = schedule(classes, shards)
        want, _ = one_by_one(classes, shards)
        assert sorted(load) == sorted(want)
        got = [0] * shards
        for size, n, _ in classes:
            own = sorted((rank, s) for c, rank, s in plan if c == size)
            for (rank, s), (end, _) in zip(own, own[1:] + [(n, 0)]):
                got[s] += size * (end - rank)
        assert got == load
    # many groups take few steps
    plan, load = schedule([(1000, 10**9, 10**12), (3, 10**9, 3 * 10**9)], 40)
    assert len(plan) < 1000 and max(load) - min(load) <= 1000
