"""Exact quantiles of large groups in bounded memory: a mergeable sketch brackets each rank, the bracket is counted."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written


ACCURACY = 2_000


def quantiles(df: DataFrame, keys: list[str], value: str, points: list[float], name: str = "_q", broadcast_groups: int = 100_000) -> DataFrame:
    """(keys, array of quantiles), linear between neighbouring values; NULL values don't count, keys are not NULL.

    A sketch of each group gives values whose ranks lie close below and above each wanted one, whatever the values'
    distribution.  Rows below a bracket are counted; those inside, about four in ACCURACY or equal ones, are ranked by
    distinct values and their counts.  Groups of up to 2 * ACCURACY rows are ranked whole.  So no task holds a group.
    """
    known = written(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), "values")
    reach = 2 / ACCURACY
    near = [min(1.0, max(0.0, p + d)) for p in points for d in (-reach, reach)]
    ends = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.percentile_approx("_v", near, ACCURACY).alias("_near"))
    # an end of a bracket beyond the sketch's reach is the group's own
    small = F.col("_n") <= 2 * ACCURACY
    low = [F.when(small | F.lit(near[2 * i] <= 0), F.col("_low")).otherwise(F.col("_near")[2 * i]) for i in range(len(points))]
    high = [F.when(small | F.lit(near[2 * i + 1] >= 1), F.col("_high")).otherwise(F.col("_near")[2 * i + 1]) for i in range(len(points))]
    ends = written(ends.select(*keys, "_n", *[c.alias(f"_{k}{i}") for k, x in (("l", low), ("h", high)) for i, c in enumerate(x)]), "brackets")
    if keys:
        held = known.join(F.broadcast(ends) if ends.count() <= broadcast_groups else ends, keys)
    else:
        held = known.crossJoin(F.broadcast(ends))  # one row
    below = held.groupBy(*keys, "_n").agg(*[F.count_if(F.col("_v") < F.col(f"_l{i}")).alias(f"_b{i}") for i in range(len(points))])
    hit = F.filter(F.array(*[F.when(F.col("_v").between(F.col(f"_l{i}"), F.col(f"_h{i}")), F.lit(i)) for i in range(len(points))]), lambda i: i.isNotNull())
    inside = held.withColumn("_i", F.explode(hit)).groupBy(*keys, "_i", "_v").agg(F.count("*").alias("_m"))
    cells = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_b{i}").alias("_before"), (F.lit(p) * (F.col("_n") - 1)).alias("_at")) for i, p in enumerate(points)])
    wanted = below.select(*keys, F.inline(cells))
    start = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = inside.withColumn("_start", start).join(wanted, [*keys, "_i"]).withColumn("_start", F.col("_start") + F.col("_before"))
    holds = lambda rank: (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_m"))
    at = lambda rank: F.max(F.when(holds(rank), F.col("_v")))
    found = placed.groupBy(*keys, "_i", "_at").agg(at(F.floor("_at")).alias("_x"), at(F.ceil("_at")).alias("_y"))
    found = found.withColumn("_v", F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_at") - F.floor("_at")))
    rows = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_held"))
    return rows.select(*keys, F.array(*[F.element_at("_held", i) for i in range(len(points))]).alias(name))


def depth_buckets(df: DataFrame, keys: list[str], value: str, buckets: int = 256, name: str = "_b", broadcast_groups: int = 20_000) -> DataFrame:
    """`df` with a bucket that grows with the value: cuts of about equal depth from a sketch, a NULL value in -1.

    Distinct values at most about twice in `buckets` of the group's share one; `df` should hold each value once.
    """
    cuts = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), [i / buckets for i in range(1, buckets)], 10 * buckets)).alias("_cuts"))
    cuts = written(cuts, "cuts")
    if keys:
        held = df.join(F.broadcast(cuts) if cuts.count() <= broadcast_groups else cuts, keys, "left")
    else:
        held = df.crossJoin(F.broadcast(cuts))  # one row
    # the number of cuts below the value, by halving
    span = F.struct(F.lit(0).alias("a"), F.size("_cuts").alias("b"))
    middle = lambda s: F.floor((s["a"] + s["b"]) / 2).cast("int")
    go = lambda s, _: F.when(s["a"] >= s["b"], s).when(F.get("_cuts", middle(s)) < F.col(value).cast("double"), F.struct((middle(s) + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), middle(s).alias("b")))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(buckets.bit_length())), span, go)
    return held.withColumn(name, F.when(F.col(value).isNull(), F.lit(-1)).otherwise(found["a"])).drop("_cuts")


def running_median(values: DataFrame, asked: DataFrame, keys: list[str], ts: str, value: str, buckets: int = 256, chunk_rows: int = 65_536) -> DataFrame:
    """(keys, ts, n, median): for each asked time, how many values are known by then, and their median (exact).

    Values fall into buckets of about equal depth, and into chunks of time.  Counts by chunk and bucket, summed over the
    chunks before, tell in which bucket a time's middle ranks lie.  A task then holds one bucket's values and the
    times of one chunk that ask for them, so neither a series nor its times meet in one task.  Times without a value
    yet have a NULL median; NULL values don't count.
    """
    known = written(values.where(F.col(value).isNotNull()).select(*keys, F.col(ts).alias("_t"), F.col(value).cast("double").alias("_v")), "values")
    times = written(asked.select(*keys, F.col(ts).alias("_t")).distinct(), "times")
    cut = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("_cuts"))
    cut = written(cut.withColumn("_cuts", F.array_distinct("_cuts")), "cuts")
    clock = F.col("_t").cast("timestamp").cast("double")
    ends = times.groupBy(*keys).agg(F.min(clock).alias("_from"), F.max(clock).alias("_to"), F.count("*").alias("_m"))
    ends = ends.withColumn("_chunks", F.ceil(F.col("_m") / chunk_rows))
    chunk = F.least(F.floor((clock - F.col("_from")) / F.greatest(F.lit(1.0), (F.col("_to") - F.col("_from")) / F.col("_chunks"))), F.col("_chunks") - 1).cast("int")
    bucket = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    placed = written(known.join(cut, keys).join(ends, keys).select(*keys, "_t", "_v", bucket.alias("_b"), F.greatest(F.lit(0), chunk).alias("_chunk"), "_chunks"), "placed")
    own = times.join(ends, keys).select(*keys, "_t", chunk.alias("_chunk"))

    # ranks: a chunk's times, its values' times and buckets, and the counts by bucket before it
    counts = placed.groupBy(*keys, "_chunk", "_b").agg(F.count("*").alias("_m"))
    later = counts.join(ends.select(*keys, "_chunks"), keys).withColumn("_chunk", F.explode(F.sequence(F.col("_chunk") + 1, F.col("_chunks").cast("int")))).where(F.col("_chunk") < F.col("_chunks"))
    before = later.groupBy(*keys, "_chunk", "_b").agg(F.sum("_m").alias("_m"))
    cells = own.select(*keys, "_chunk", "_t", F.lit(None).cast("int").alias("_b"), F.lit(0).cast("long").alias("_m"))
    cells = cells.unionByName(placed.select(*keys, "_chunk", "_t", "_b", F.lit(1).cast("long").alias("_m"))).unionByName(before.select(*keys, "_chunk", F.lit(None).cast(asked.schema[ts].dataType).alias("_t"), "_b", "_m"))
    kinds = [times.schema[k] for k in keys]
    wide = T.StructType([*kinds, T.StructField("_chunk", T.IntegerType()), times.schema["_t"], *[T.StructField(c, T.LongType()) for c in ("n", "_half", "_b", "_rank")]])

    def rank(table: pa.Table) -> pa.Table:
        b, m = pc.fill_null(table.column("_b"), -1).to_numpy(), table.column("_m").to_numpy()
        missing = table.column("_t").is_null().to_numpy(zero_copy_only=False)
        sums = np.bincount(b[missing], weights=m[missing], minlength=buckets + 1).astype(np.int64)
        rest = table.filter(pa.array(~missing))
        order = pc.sort_indices(pa.table({"t": rest.column("_t"), "b": pc.fill_null(rest.column("_b"), buckets + 9)}), sort_keys=[("t", "ascending"), ("b", "ascending")])
        rest = rest.take(order)
        out = []
        for i, at in enumerate(pc.fill_null(rest.column("_b"), -1).to_pylist()):
            if at >= 0:
                sums[at] += 1
                continue
            n = int(sums.sum())
            total = np.cumsum(sums)
            for half, k in enumerate({(n - 1) // 2, n // 2} if n else ()):
                where = int(np.searchsorted(total, k, "right"))
                out.append((i, n, half, where, k - int(total[where - 1] if where else 0)))
            if not n:
                out.append((i, 0, 0, -1, 0))
        at = pa.array([x[0] for x in out], pa.int64())
        made = [pa.array([x[j] for x in out], pa.int64()) for j in range(1, 5)]
        return pa.table([*(rest.column(k).take(at) for k in keys), rest.column("_chunk").take(at), rest.column("_t").take(at), *made], names=[*keys, "_chunk", "_t", "n", "_half", "_b", "_rank"])

    ranks = written(cells.groupBy(*keys, "_chunk").applyInArrow(rank, wide), "ranks")
    wanted = ranks.where("_b >= 0").withColumn("_b", F.col("_b").cast("int"))
    needed = wanted.select(*keys, "_chunk", "_b").distinct()
    held = placed.withColumnRenamed("_chunk", "_at").drop("_chunks").join(needed, [*keys, "_b"]).where(F.col("_at") <= F.col("_chunk"))
    held = held.select(*[F.col(c).alias(c) for c in (*keys, "_chunk", "_b", "_t", "_v")])
    found = T.StructType([*kinds, times.schema["_t"], T.StructField("n", T.LongType()), T.StructField("_v", T.DoubleType())])

    def pick(asked: pa.Table, own: pa.Table) -> pa.Table:
        asked, own = (x.take(pc.sort_indices(x.column("_t"))) for x in (asked, own))
        known: list[float] = []
        seen, value, clock = 0, own.column("_v").to_pylist(), own.column("_t").to_pylist()
        out = []
        for t, k in zip(asked.column("_t").to_pylist(), asked.column("_rank").to_pylist(), strict=True):
            while seen < len(clock) and clock[seen] <= t:
                bisect.insort(known, value[seen])
                seen += 1
            out.append(known[k])
        return asked.select([*keys, "_t", "n"]).append_column("_v", pa.array(out, pa.float64()))

    by = [*keys, "_chunk", "_b"]
    middles = wanted.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(pick, found)
    medians = middles.groupBy(*keys, "_t", "n").agg(F.avg("_v").alias("median"))
    none = ranks.where("_b < 0").select(*keys, "_t", "n", F.lit(None).cast("double").alias("median"))
    return medians.unionByName(none).withColumnRenamed("_t", ts)
