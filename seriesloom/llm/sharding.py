"""Shards of near-equal bytes: longest-processing-time scheduling over groups of equal texts.

Groups are scheduled largest first to the least-loaded shard through a heap.  Groups of one weight are
interchangeable, so the schedule needs only how many groups each weight has: a heap of 40 shards hands out the
groups of a weight, and these are dealt to the shards by their rank within the weight.  The sorted table of weights
streams through the driver, a partition at a time, and the schedule is written in batches: the driver holds the
shards' loads and a batch, however many weights there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, new_path


def dealt(weights: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """Deals groups, each to the least-loaded shard; ties by shard.

    `weights` are (weight, number of groups), largest weight first; gives (weight, shard, first rank, end rank) of the
    groups.  Whole rounds, in which each shard gets one group, are handed out at once when the loads are within one
    weight.
    """
    heap = [(0, s) for s in range(shards)]
    for weight, count in weights:
        taken = [0] * shards
        left = count
        while left:
            if left > shards and max(heap)[0] - heap[0][0] <= weight:
                rounds = left // shards
                taken = [n + rounds for n in taken]
                heap = [(load + rounds * weight, s) for load, s in heap]
                left -= rounds * shards
                continue
            load, s = heap[0]
            heapq.heapreplace(heap, (load + weight, s))
            taken[s] += 1
            left -= 1
        at = 0
        for s, n in enumerate(taken):
            if n:
                yield weight, s, at, at + n
                at += n


def schedule(weights: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    return list(dealt(sorted(weights, reverse=True), shards))


def written_schedule(groups: DataFrame, shards: int, batch: int) -> DataFrame:
    """(weight, shard, first, end) of the groups of (group, weight), written; `batch` rows of it at a time."""
    spark = groups.sparkSession
    weights = cut(groups.groupBy("weight").agg(F.count("*").alias("n")), "weights")
    rows = dealt(((r["weight"], r["n"]) for r in weights.orderBy(F.desc("weight")).toLocalIterator()), shards)
    path = new_path(spark, "schedule")
    names = ["weight", "shard", "first", "end"]
    while True:
        columns = list(zip(*islice(rows, batch), strict=True)) or [[]] * len(names)
        spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=names)).write.mode("append").parquet(path)
        if len(columns[0]) < batch:
            break
    return spark.read.schema("weight long, shard long, first long, end long").parquet(path)


def ranked(df: DataFrame, keys: list[str], by: str, parts: int, name: str) -> DataFrame:
    """`df` with each row's rank from 0 among the rows of its keys, numbered apart in `parts` parts by `by`."""
    dealt = df.withColumn("part", F.pmod(F.xxhash64(by), F.lit(parts)))
    counts = dealt.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(by)) - 1
    return dealt.withColumn("own", own).join(before, [*keys, "part"]).withColumn(name, (F.col("before") + F.col("own")).cast("long")).drop("part", "own", "before")


def shard(docs: DataFrame, shards: int = 40, id: str = "doc_id", text: str = "text", overhead: int = 16, batch_weights: int = 200_000, slot_rows: int = 100_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row, by the law `bytes`.

    Null texts count no bytes and share a group with empty ones.  Equal texts share a shard, however many they
    are.  Repeated rows have a slot each.  An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id).alias("doc_id"),
        (F.octet_length(held) + overhead).cast("long").alias("size"),
        F.crc32(held.cast("binary")).alias("text_crc32"),
        F.xxhash64(held, F.lit(1)).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    narrow = cut(narrow, "sizes")
    groups = cut(narrow.groupBy("group").agg(F.sum("size").alias("weight"), F.count("*").alias("rows")), "groups")
    rows = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).collect()[0][0]
    plan = written_schedule(groups, shards, batch_weights)
    parts = max(1, -(-rows // slot_rows)) * 4
    placed = ranked(groups.select("group", "weight"), ["weight"], "group", parts, "rank").join(plan.select("weight", F.col("shard").cast("int").alias("shard"), "first", "end"), "weight")
    placed = placed.where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))).select("group", "shard")
    narrow = narrow.join(placed, "group")
    return ranked(narrow, ["shard"], "row", max(1, parts // shards), "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
