"""Shards: loads near equal, groups whole, slots gapless; the heap schedule against its definition."""

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from seriesloom.llm.sharding import schedule, shard


def slow_schedule(weights, shards):
    loads = [0] * shards
    for w in sorted((w for w, n in weights for _ in range(n)), reverse=True):
        s = loads.index(min(loads))
        loads[s] += w
    return loads


def test_schedule_takes_the_least_loaded():
    rnd = random.Random(3)
    cases = [[(7, 1), (5, 1), (4, 2), (3, 1), (1, 1)], [(5, 100)], [(90, 1), (3, 50), (2, 77)], [(rnd.randrange(1, 60), rnd.randrange(1, 40)) for _ in range(30)]]
    for weights in cases:
        weights = list(dict(weights).items())
        for shards in (1, 3, 8):
            dealt, loads = schedule(weights, shards), [0] * shards
            for w, s, first, end in dealt:
                loads[s] += w * (end - first)
            assert loads == slow_schedule(weights, shards)
            for w, n in weights:
                assert sorted(k for v, _, a, b in dealt if v == w for k in range(a, b)) == list(range(n))
    assert schedule([], 2) == []


def check(got, rows, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, load = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_groups_and_loads(spark):
    rows = [(i, "t" * (i * 37 % 900)) for i in range(2000)] + [(None, None), (1, ""), (1, ""), (2, "é" * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    weights = defaultdict(int)
    for _, t in rows:
        weights[t or ""] += len((t or "").encode()) + 16
    for most in (200_000, 64):  # hundreds of weights: the schedule is the plain one, however they are batched
        got = shard(docs.withColumn("group", F.lit("x")).withColumn("shard", F.lit(1)), shards=8, batch_weights=most, slot_rows=50).collect()
        load = check(got, rows, 8)
        assert sorted(load.values()) == sorted(slow_schedule(list(Counter(weights.values()).items()), 8))
        assert max(load.values()) <= 1.02 * sum(load.values()) / 8
        by_text = defaultdict(set)
        for r in got:
            by_text[r.text_crc32].add(r.shard)
        assert all(len(s) == 1 for s in by_text.values())


def test_a_hot_group_stays_whole(spark):
    rows = [(i, "hot " * 50 if i % 3 == 0 else f"text {i}" * 10) for i in range(900)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    check(got, rows, 4)
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) == 1


def test_rows_equal_in_id_and_text(spark):
    rows = [(1, "same text")] * 500 + [(2, "other")] * 20
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=3, slot_rows=20).collect()
    check(got, rows, 3)


def test_empty_table(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
