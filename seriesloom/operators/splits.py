"""Labels, time-ordered splits with purging, folds and correlation pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import log_return_label
from .clean import by
from .scan import row_numbers
from .windows import future_return, log_return, rolling


def threshold_label(df: DataFrame, keys: list[str], ts: str, horizon: int = 7, share: float = 0.5) -> DataFrame:
    """1 or 0 where the coming return exceeds a share of the weekly volatility up or down, NULL between."""
    w = by(keys, ts)
    df = df.withColumn("log_return", log_return("close", 1, w))
    df = df.withColumns({"future_return": future_return("close", horizon, w), "weekly_vol": rolling("log_return", horizon, w, "std") * F.sqrt(F.lit(float(horizon)))})
    return df.withColumn("label", log_return_label("future_return", share * F.col("weekly_vol")))


def numbered(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Place of each row in its series from 0, and the series' length."""
    return row_numbers(df, keys, ts)


def purged_split(df: DataFrame, keys: list[str], ts: str, train: float = 0.6, validation: float = 0.2, horizon: int = 7) -> DataFrame:
    """train, validation or test by place; NULL for the `horizon` rows that are purged between them."""
    df = numbered(df, keys, ts)
    end = F.floor(F.col("n") * train)
    stop = end + F.floor(F.col("n") * validation)
    rn = F.col("rn")
    part = F.when(rn < end, "train").when((rn >= end + horizon) & (rn < stop), "validation").when(rn >= stop + horizon, "test")
    return df.withColumn("split", part)


def purged_folds(df: DataFrame, keys: list[str], ts: str, folds: int, horizon: int = 7, least_train: float = 0.5) -> DataFrame:
    """Expanding folds: a row for each (row, fold, role). Training ends `horizon` rows before validation."""
    df = numbered(df, keys, ts).withColumn("fold", F.explode(F.array(*map(F.lit, range(folds)))))
    start = F.floor(F.col("n") * least_train)
    size = F.floor((F.col("n") - start) / folds)
    low = start + F.col("fold") * size
    high = F.when(F.col("fold") < folds - 1, low + size).otherwise(F.col("n"))
    valid = (low - horizon > 0) & (high > low)
    role = F.when(valid & (F.col("rn") < low - horizon), "train").when(valid & F.col("rn").between(low, high - 1), "validation")
    return df.withColumn("role", role).where("role is not null")


def walk_forward(df: DataFrame, keys: list[str], ts: str, folds: int, purge: int = 0) -> DataFrame:
    """Folds 1 to k of n // (k + 1) rows: a row for each (row, fold, role).

    `purge` rows before each test part are left out of training; targets that look h rows ahead need h.
    Rows beyond the last fold are never tested.
    """
    df = numbered(df, keys, ts).withColumn("fold", F.explode(F.array(*map(F.lit, range(1, folds + 1)))))
    size = F.floor(F.col("n") / (folds + 1))
    low = size * F.col("fold")
    role = F.when(F.col("rn") < low - purge, "train").when((F.col("rn") >= low) & (F.col("rn") < low + size), "test")
    return df.withColumn("role", role).where("role is not null")


def date_quantile_split(df: DataFrame, date: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Split by the share of distinct dates, so no date lies in two parts.

    The distinct dates are one small table; it is ranked once and joined back.
    """
    dates = df.select(date).where(F.col(date).isNotNull()).distinct()
    w = Window.orderBy(date)
    share = F.row_number().over(w) / F.count("*").over(Window.partitionBy())
    part = F.when(share <= train, "train").when(share <= train + validation, "validation").otherwise("test")
    return df.join(dates.withColumn("split", part), date, "left")


def two_classes(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Groups whose training rows hold both classes."""
    return df.groupBy(*keys).agg((F.countDistinct(label) >= 2).alias("has_two_classes"))


PAIRS_A_PASS = 30


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r, n) for each pair of columns, over rows where both are known.

    A constant column has a NULL correlation.  A pass takes PAIRS_A_PASS pairs, so that its code stays small
    enough to be compiled; with many columns `df` should be a written table.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    parts = []
    for at in range(0, len(pairs), PAIRS_A_PASS):
        cells = []
        for a, b in pairs[at : at + PAIRS_A_PASS]:
            x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double")) for c in (a, b))
            r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r"), F.count(x).alias("n")))
        parts.append(df.agg(F.array(*cells).alias("p")).select(F.inline("p")))
    if not parts:
        return df.sparkSession.createDataFrame([], "a string, b string, r double, n long")
    return reduce(DataFrame.unionByName, parts)


def prune(df: DataFrame, columns: list[str], threshold: float = 0.95) -> list[str]:
    """In list order, drops the later of each pair above the threshold; dropped columns don't vote."""
    pairs = {(r["a"], r["b"]): r["r"] for r in correlations(df, columns).collect()}  # columns squared, not rows
    dropped: set[str] = set()
    for i, a in enumerate(columns):
        if a not in dropped:
            dropped |= {b for b in columns[i + 1 :] if b not in dropped and (r := pairs[a, b]) is not None and abs(r) > threshold}
    return [c for c in columns if c not in dropped]
