"""Point-in-time joins, master tables and paired comparisons."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .clean import by


def asof(left: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str], bucket: Column | None = None) -> DataFrame:
    """`left` with the last known value of each of right's columns at or before its time.

    Both sides are laid into one stream and read with a running `last`, which needs no range join.  `bucket`, a
    coarse function of the time that grows with it, splits a long series: each bucket is read on its own and
    starts from the last value of the buckets before it.
    """
    own = [c for c in left.columns if c not in columns]
    stream = left.select(*own, F.lit(1).alias("_side")).unionByName(right.select(*keys, ts, *columns, F.lit(0).alias("_side")), allowMissingColumns=True)
    order = [F.col(ts), F.col("_side")]
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return stream.withColumns({c: last(c, w) for c in columns}).where("_side = 1").drop("_side")
    stream = stream.withColumn("_bucket", bucket)
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = stream.withColumns({c: last(c, within) for c in columns}).where("_side = 1")
    ends = stream.groupBy(*keys, "_bucket").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ts, "_side"))).alias(f"_{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_bucket", *[last(f"_{c}", earlier).alias(f"_{c}") for c in columns])
    joined = inside.join(ends, [*keys, "_bucket"])
    return joined.select(*own, *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def release_lagged(days: DataFrame, low: DataFrame, keys: list[str], ts: str, lags: dict[str, int], bucket: Column | None = None) -> DataFrame:
    """Each low-frequency column on daily rows from its release day on: its date plus its lag in days.

    All columns share one stream: a row for each lag, then one running `last` for each column, a year at a time unless
    another `bucket` is given.  The stream is read twice and has a part for each lag, so `low` is written once before.
    """
    low, released = written(low, "low"), []
    for lag in sorted(set(lags.values())):
        columns = [c for c, n in lags.items() if n == lag]
        released.append(low.select(*keys, F.date_add(ts, lag).alias(ts), *columns))
    return asof(days, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), released), keys, ts, list(lags), F.year(ts) if bucket is None else bucket)


def master(days: DataFrame, tables: list[DataFrame], keys: list[str], ts: str, start_columns: list[str]) -> DataFrame:
    """All tables joined to the day spine by date, from the latest first day of the start columns on."""
    wide = reduce(lambda a, b: a.join(b, [*keys, ts], "left"), tables, days)
    w = Window.partitionBy(*keys)
    starts = [F.min(F.when(F.col(c).isNotNull(), F.col(ts))).over(w) for c in start_columns]
    start = F.greatest(*starts) if len(starts) > 1 else starts[0]
    known = reduce(lambda a, b: a & b, [s.isNotNull() for s in starts])
    return wide.withColumn("_start", F.when(known, start)).where(F.col(ts) >= F.col("_start")).drop("_start")


def outer_parts(train: DataFrame, test: DataFrame, on: list[str]) -> DataFrame:
    return train.join(test, on, "full_outer")


def merge_common(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Inner join on the named columns, or on all that both tables have."""
    return a.join(b, on or [c for c in a.columns if c in b.columns], "inner")


def stack(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that one lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def compare_runs(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Records of two runs paired by key: rows in both, rows with any difference (NULLs are equal)."""
    x, y = a.select(*on, F.struct(*columns).alias("_a")), b.select(*on, F.struct(*columns).alias("_b"))
    differs = reduce(lambda p, q: p | q, [~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in columns])
    return x.join(y, on).agg(F.count("*").alias("n_paired"), F.count_if(differs).alias("n_different"))


def score_once(df: DataFrame, column: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies a costly scoring step to each distinct value and joins the scores back."""
    return df.join(score(df.select(column).where(F.col(column).isNotNull()).distinct()), column, "left")


def autocorrelation(df: DataFrame, keys: list[str], ts: str, value: str, lags: int) -> DataFrame:
    """(keys, lag, acf) for lags 0 to `lags`: lagged products around the series' mean, over its sum of squares."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    w = by(keys, ts)
    centred = df.join(means, keys).select(*keys, ts, (F.col(value) - F.col("_mean")).alias("_x"))
    shifted = centred.select(*keys, "_x", *[F.lag("_x", k).over(w).alias(f"_x{k}") for k in range(1, lags + 1)])
    cells = [F.struct(F.lit(k).alias("lag"), F.sum(F.col("_x") * F.col(f"_x{k}" if k else "_x")).alias("_p")) for k in range(lags + 1)]
    sums = shifted.groupBy(*keys).agg(F.array(*cells).alias("_c"))
    return sums.select(*keys, F.col("_c")[0]["_p"].alias("_total"), F.inline("_c")).where("_p is not null").select(*keys, "lag", F.try_divide("_p", F.col("_total")).alias("acf"))
