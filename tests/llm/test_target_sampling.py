import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import target_sampling as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", "  .,\x00", "One word", "Café ÉCOLE naïve 12 x-y_z", "a b a b a b " * 8, "zz " * 400, "日本語 a b", "w" * 70_000 + " tail end", "the cat sat on the mat and the dog lay by the door of the house all day long then left it"]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, target, runs, buckets, percent=10, least=20, seed="2024"):
    def features(text):
        own = words(text)
        return [zlib.crc32(" ".join(own[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(own) - n + 1)]

    source, aim = Counter(), Counter()
    for _, t in rows:
        source.update(features(t))
    for t in target:
        aim.update(features(t))
    s_all, t_all = source.total(), aim.total()
    out = []
    for i, t in rows:
        found = features(t)
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(t))])
    can = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(can[: percent * len(can) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("runs", "buckets", "known"), [(1, 10_000, ()), (1, 97, ("cat", "the", "a")), (2, 10_000, ("a", "b", "the")), (3, 70_000, ("zz", "day"))])
def test_buckets_equal_hashing_each_run(runs, buckets, known):
    held = [None if t is None else t.encode() for t in TEXTS]
    found, counts = op.buckets_of(held, known, runs, buckets)
    for text, own, n in zip(TEXTS, found, counts, strict=True):
        w = words(text)
        assert n == len(w)
        want = [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1)]
        assert own.tolist() == want


def test_composed_checksums():
    parts = [(b"", b"x"), (b"abc", b""), (b"left", b"right" * 999), (b"\xff" * 7, b"\x00" * 65)]
    got = op.compose(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([zlib.crc32(b) for _, b in parts], np.uint32), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


@pytest.mark.parametrize("runs", [1, 2])
def test_equals_brute_force(spark, runs):
    """Nulls, ties of repeated rows, empty and long texts, and columns with clashing names."""
    rows = [(i if i != 7 else None, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(3, TEXTS[9]), (3, TEXTS[9])]
    target = ["The cat and the dog", None, "naïve door"]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(5)
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = op.resample(docs, aims, runs=runs, percent=40).select("doc_id", "n_features", "weight", "score", "rank")
    got, want = [tuple(r) for r in got.collect()], brute(rows, target, runs, 10_000, 40)
    assert sorted(got, key=str) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert op.resample(docs, docs).count() == 0
    assert op.resample(some, docs, percent=100).where(F.col("rank") == 1).count() == 1
