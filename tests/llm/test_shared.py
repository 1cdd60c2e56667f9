"""Shared helpers: repeatable samples, slices, written tables, and workers that lack the package."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm.shared import BATCH_ROWS, PACKAGE_ROOT, cut, discard, free_name, least_hashed, slices, small_batches

OUTSIDE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from seriesloom.llm.token_counts import count_report
docs = spark.createDataFrame([(1, "the cat")], "doc_id long, text string")
print("TOKENS", count_report(docs).collect()[0].n_tokens)
"""


def test_sample_is_bounded_and_repeats(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = sorted(r.k for r in least_hashed(df.repartition(3), ["k"], 100).collect())
    b = sorted(r.k for r in least_hashed(df.repartition(7), ["k"], 100).collect())
    assert a == b and len(a) == 100
    assert least_hashed(df.limit(30), ["k"], 100).count() == 30 and least_hashed(df.limit(0), ["k"], 5).count() == 0


@pytest.mark.parametrize("keys", [1, 3, 40])
def test_sample_of_repeated_keys_is_full(spark, keys):
    df = spark.range(4000).select((F.col("id") % keys).alias("k"))
    assert least_hashed(df, ["k"], 100).count() == 100
    assert least_hashed(df.select(F.lit(None).cast("long").alias("k")), ["k"], 100).count() == 100


def test_session_keeps_its_batch_size(spark):
    before = spark.conf.get(BATCH_ROWS)
    try:
        spark.conf.set(BATCH_ROWS, "7777")
        with small_batches(spark):
            assert spark.conf.get(BATCH_ROWS) == "1000"
        cut(spark.range(3), "t")
        assert spark.conf.get(BATCH_ROWS) == "7777"
    finally:
        spark.conf.set(BATCH_ROWS, before)


def test_slices_cover_all_rows():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 25, "", "c" * 9, "d"])], names=["t"])
    parts = list(slices(batch, "t", 20))
    assert [x for p in parts for x in p.column("t").to_pylist()] == batch.column("t").to_pylist()
    assert [p.num_rows for p in parts] == [2, 1, 3]
    assert list(slices(batch.slice(0, 0), "t")) == []


def test_written_tables_and_names(spark):
    t = cut(spark.range(3), "t")
    assert t.count() == 3 and free_name(t, "ID") == "_ID" and free_name(t, "x") == "x"
    discard(t)


def test_workers_without_the_package_get_it(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", OUTSIDE.format(root=PACKAGE_ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "TOKENS 2" in got.stdout, got.stderr[-2000:]
