"""Packing: every id is kept, sequences are gapless, best fit is the tightest, bins are few."""

import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from seriesloom.llm.bpe import WordBpe
from seriesloom.llm.packing import best_fit, pack, pack_documents, pieces
from seriesloom.llm.shared import tokenizer_path


def slow_best_fit(sizes, capacity):
    left, bins, offsets = [], [], []
    for s in sizes:
        fits = [(r, -i) for i, r in enumerate(left) if r >= s]
        if fits:
            i = -min(fits)[1]
        else:
            i = len(left)
            left.append(capacity)
        bins.append(i)
        offsets.append(capacity - left[i])
        left[i] -= s
    return bins, offsets


def test_best_fit_equals_a_scan():
    rnd = random.Random(2)
    for capacity in (1, 7, 64, 100):
        sizes = sorted((rnd.randrange(1, capacity + 1) for _ in range(300)), reverse=True)
        bins, offsets = best_fit(sizes, capacity)
        slow, _ = slow_best_fit(sizes, capacity)
        load = lambda b: sorted(sum(s for s, x in zip(sizes, b, strict=True) if x == k) for k in set(b))
        assert load(bins) == load(slow)
        used = defaultdict(int)
        for s, b, o in zip(sizes, bins, offsets, strict=True):
            assert o == used[b]
            used[b] += s
        assert max(used.values()) <= capacity


def test_documents_keep_every_id(spark):
    rows = [(1, "The cat sat."), (2, None), (3, ""), (4, "word " * 9000), (4, "word " * 9000), (None, "x é"), (5, "w" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    library = WordBpe(tokenizer_path()).library
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((str(i), k // 4096, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    got = pack_documents(docs).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = defaultdict(list)
    assert {(str(r.doc_id), r.piece, zlib.crc32(r.ids), len(r.ids) // 4) for r in pieces(docs).collect()} == {(i, k, c, n) for i, k, _, n, c in want}
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) == -(-sum(r.length for r in got) // 4096)


def test_groups_waste_little_and_extra_columns_stay(spark):
    rnd = random.Random(4)
    items = spark.createDataFrame([(i, 0, rnd.randrange(1, 4097), "x") for i in range(6000)], "doc_id long, piece int, length long, offset_note string")
    got = pack(items, group_rows=1000)
    total, bins = sum(r.length for r in got.collect()), got.select("sequence_id").distinct().count()
    assert bins <= 1.05 * total / 4096
    assert "offset_note" in got.columns


def test_rows_of_one_id_are_dealt_to_all_groups(spark):
    """200 000 rows that share a null id: no group is larger than the others by much."""
    items = spark.range(200_000, numPartitions=5).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 500 + 1).alias("length"))
    got = pack(items)
    assert got.count() == 200_000
    sizes = [r["count"] for r in got.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(sizes) == 7 and max(sizes) < 1.1 * 200_000 / 7


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(docs).count() == 0 and pieces(docs).count() == 0
