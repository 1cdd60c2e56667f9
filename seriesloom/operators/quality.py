"""Data-quality profiles and audits. They report; they never drop or change rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import by
from .joins import compare_runs
from .quantiles import quantiles

TUKEY = 1.5  # fixed value: the usual fence factor


def long_form(df: DataFrame, columns: list[str], name: str = "column_name", value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """One row for each of the numeric columns."""
    return df.select(*(keys or []), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys or [], columns, name, value)


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL count and percentage of each column, from one pass."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot(["n_rows"], columns, "column_name", "n_missing").withColumn("pct_missing", F.try_divide(100.0 * F.col("n_missing"), F.col("n_rows")))


def date_gaps(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Missing stretches: the day before, the day after, and how many days lack."""
    w = by(keys, ts)
    days = F.datediff(ts, F.lag(ts).over(w))
    return df.select(*keys, F.lag(ts).over(w).alias("gap_after"), F.col(ts).alias("gap_before"), (days - 1).alias("n_days")).where("n_days > 0")


def date_format_profile(df: DataFrame, column: str) -> DataFrame:
    """How many texts are ISO dates by shape, and how many are real dates."""
    iso = F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}$")
    return df.agg(
        F.count(column).alias("n_values"), F.count_if(iso).alias("n_iso"), F.count_if(iso & F.try_to_timestamp(column, F.lit("yyyy-MM-dd")).isNull()).alias("n_not_a_date")
    )


def iqr_outliers(df: DataFrame, columns: list[str], factor: float = TUKEY, accuracy: int | None = None) -> DataFrame:
    """Fences of each column and what lies outside: count, share, least and largest outlier.

    With `accuracy` the quartiles are approximate and come from one pass; without it they are exact, from ranks
    within buckets.
    """
    rows = long_form(df, columns).where("value is not null")
    if accuracy:
        bounds = rows.groupBy("column_name").agg(F.percentile_approx("value", [0.25, 0.75], accuracy).alias("q"))
    else:
        bounds = quantiles(rows, ["column_name"], "value", [0.25, 0.75], name="q")
    spread = F.col("q")[1] - F.col("q")[0]
    bounds = bounds.select("column_name", (F.col("q")[0] - factor * spread).alias("lower"), (F.col("q")[1] + factor * spread).alias("upper"))
    out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return rows.join(F.broadcast(bounds), "column_name").groupBy("column_name", "lower", "upper").agg(
        F.count("*").alias("n"),
        F.count_if(out).alias("n_outliers"),
        (100.0 * F.avg(out.cast("double"))).alias("pct_outliers"),
        F.min(F.when(out, F.col("value"))).alias("min_outlier"),
        F.max(F.when(out, F.col("value"))).alias("max_outlier"),
    )  # bounds: one row for each named column


def table_summary(df: DataFrame, name: str, keys: list[str], ts: str) -> DataFrame:
    """Rows, columns, date range, series and missing days of a table."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ts).alias("a"), F.max(ts).alias("b"), F.countDistinct(ts).alias("d"))
    return per.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_series"), F.min("a").alias("first_date"), F.max("b").alias("last_date"), F.sum(F.datediff("b", "a") + 1 - F.col("d")).alias("n_gap_days")
    ).select(F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("n_columns"), "*")


def require_complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` itself; raises if any of the columns has a NULL."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).collect()[0]
    bad = {c: row[c] for c in columns if row[c]}
    if bad:
        raise ValueError(f"missing values: {bad}")
    return df


def classify_missing(df: DataFrame, keys: list[str], ts: str, windows: dict[str, int]) -> DataFrame:
    """NULLs of each indicator: how many lie in its warm-up (the first `window` rows) and how many later."""
    rows = df.withColumn("_rn", F.row_number().over(by(keys, ts)))
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).isNull().alias("is_null"), (F.col("_rn") <= n).alias("early")) for c, n in windows.items()]
    return rows.select(F.inline(F.array(*cells))).groupBy("column_name").agg(
        F.count_if(F.col("is_null") & F.col("early")).alias("n_warm_up"), F.count_if(F.col("is_null") & ~F.col("early")).alias("n_gap")
    )


def audit(df: DataFrame, reasons: list[tuple[str, Column]], duplicate_key: Column, order: list[Column]) -> DataFrame:
    """Each row's first matching reason to leave it out, then `duplicate` for all but the first row of a key
    among the rest, then `retained`: the counts of the reasons add up to the rows.

    `order` tells the rows of a key apart.  The first one is a grouped minimum, combined before the shuffle, so
    copies of a frequent key don't meet in a task to be sorted.
    """
    reason = reduce(lambda acc, r: acc.when(r[1], r[0]), reasons[1:], F.when(reasons[0][1], reasons[0][0]))
    marked = df.withColumns({"_early": reason, "_key": duplicate_key}).withColumn("_order", F.struct(*order))
    first = marked.where("_early is null").groupBy("_key").agg(F.min("_order").alias("_first"))
    turn = F.when(F.col("_order") == F.col("_first"), "retained").otherwise("duplicate")
    return marked.join(first, "_key", "left").withColumn("reason", F.coalesce("_early", turn)).drop("_early", "_key", "_order", "_first")


def leakage(df: DataFrame, feature: Callable[[DataFrame], DataFrame], keys: list[str], ts: str, columns: list[str], out: list[str], cut) -> DataFrame:
    """Replaces the columns after `cut` by noise and compares the features up to it: any difference is a leak."""
    late = F.col(ts) > F.lit(cut)
    noisy = df.withColumns({c: F.when(late, F.col(c) * (1 + F.pmod(F.xxhash64(*keys, ts), F.lit(97)) / 50.0)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c in columns})
    early = lambda x: feature(x).where(~late)
    return compare_runs(early(df), early(noisy), [*keys, ts], out)
