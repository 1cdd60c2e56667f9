"""Lags, leads and rolling statistics, with NULL until a window is full; halo blocks for long series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import col, log, safe_divide
from .clean import by


def lag(c: str | Column, n: int, w: WindowSpec) -> Column:
    return F.lag(col(c), n).over(w)


def difference(c: str | Column, n: int, w: WindowSpec) -> Column:
    return col(c) - lag(c, n, w)


def percent_change(c: str | Column, w: WindowSpec, n: int = 1) -> Column:
    return safe_divide(c, lag(c, n, w)) - 1


def log_return(c: str | Column, n: int, w: WindowSpec) -> Column:
    return log(c) - lag(log(c), n, w)


def future_return(c: str | Column, h: int, w: WindowSpec) -> Column:
    """ln of the value h rows ahead over the present one."""
    return log(F.lead(col(c), h).over(w)) - log(c)


def rolling(c: str | Column, n: int, w: WindowSpec, how: str) -> Column:
    """mean, std (sample), min, max or sum of the last n rows; NULL unless all n are known."""
    frame = w.rowsBetween(-(n - 1), 0)
    x = col(c)
    made = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}[how](x).over(frame)
    return F.when(F.count(x).over(frame) == n, made)


def expanding(c: str | Column, w: WindowSpec, how: str) -> Column:
    """Statistic of the rows before this one."""
    return {"mean": F.avg, "min": F.min, "max": F.max, "count": F.count}[how](col(c)).over(w.rowsBetween(Window.unboundedPreceding, -1))


def centred_mean(c: str | Column, period: int, w: WindowSpec) -> Column:
    """Moving average centred on the row; for an even period the mean of two that straddle it."""
    x, half = col(c), period // 2

    def mean(low: int, high: int) -> Column:
        frame = w.rowsBetween(low, high)
        return F.when(F.count(x).over(frame) == period, F.avg(x).over(frame))

    return mean(-half, half) if period % 2 else (mean(-half, half - 1) + mean(-half + 1, half)) / 2


def best_row(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row with the highest score in each group; ties go to the least `tie`."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def supervised_pairs(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Each value with the next one as its target; the last row of a series has none and goes."""
    return df.withColumn("target", F.lead(value).over(by(keys, ts))).where(F.col("target").isNotNull())


def with_halo(df: DataFrame, ts: str, block_days: int, back: int, ahead: int = 0) -> DataFrame:
    """Daily rows dealt into blocks of days, each with copies of the `back` days before it and `ahead` after it.

    Windows partitioned by the series and `_block` then give the right values on rows with `_own`, for
    lookbacks up to `back` rows, without one task per series.  The series must have no missing days.
    """
    day = F.unix_date(F.col(ts).cast("date"))
    blocks = F.sequence(F.floor((day - ahead) / block_days), F.floor((day + back) / block_days))
    out = df.withColumn("_block", F.explode(blocks))
    return out.withColumn("_own", F.col("_block") == F.floor(day / block_days))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_block")
