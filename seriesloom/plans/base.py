"""Query registry, the tables that queries start from, and the SQL for the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendars
from ..storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS, TS = ["series_id"], "date"


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def raw_daily(spark: SparkSession, sf_dir: str, series: Column | None = None) -> DataFrame:
    """Daily bars of order prices, a series for each priority; days without orders are missing."""
    orders = table(spark, sf_dir, "orders").withColumn("series_id", F.col("o_orderpriority") if series is None else series)
    return calendars.ohlcv(orders, KEYS, "o_orderkey", "o_totalprice", F.to_date("o_orderdate"))


def bars(spark: SparkSession, sf_dir: str, series: Column | None = None) -> DataFrame:
    """Daily bars without gaps."""
    return calendars.regular_bars(raw_daily(spark, sf_dir, series), KEYS)


def features_table(df: DataFrame, label: str) -> DataFrame:
    """A feature table that models read many times: written once."""
    return written(df, label)


def _bars_sql(series: str) -> str:
    return f"""
daily AS (SELECT {series} AS series_id, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2),
spine AS (SELECT series_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY series_id),
bars AS (SELECT series_id, date, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high,
    last_value(low IGNORE NULLS) OVER w AS low, last_value(close IGNORE NULLS) OVER w AS close, coalesce(volume, 0) AS volume
    FROM spine LEFT JOIN daily USING (series_id, date)
    WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


BARS = _bars_sql("o_orderpriority")
BARS_ALL = _bars_sql("'all'")


def roll(x: str, n: int, how: str) -> str:
    """A rolling statistic that is NULL until its window is full."""
    frame = f"OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {how}({x}) {frame} END"


W = "OVER (PARTITION BY series_id ORDER BY date)"
