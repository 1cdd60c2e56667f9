"""Schemas, readers and writers. CSV and JSON are read with explicit schemas: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINUTE_BARS = "Timestamp long, Open double, High double, Low double, Close double, volume_coin double, volume_currency double, Weighted_Price double"
MONTHLY_OHLCV = "date date, Close double, High double, Low double, Open double, Volume long"
DAILY_OHLCV = "series_id string, date date, open double, high double, low double, close double, volume long"
PRICE = "date date, close double"
IMPLIED_VOLATILITY = "date date, dvol double"
ARTICLES = "id string, published_at timestamp, raw_text string, source string, assessment struct<result: struct<sentiment: struct<polarity: double, magnitude: double>, confidence: double, entities: array<string>, events: array<string>>>"


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def read_csv(spark: SparkSession, path: str, schema: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header, columns by name as `schema` says; flag columns (True/False) become 0/1."""
    df = spark.read.schema(schema).option("enforceSchema", False).csv(path, header=True)
    return without_nan(df).withColumns({c: F.col(c).cast("boolean").cast("int") for c in flags})


def read_epoch_csv(spark: SparkSession, path: str, schema: str = MINUTE_BARS, column: str = "Timestamp") -> DataFrame:
    """A CSV whose `column` has epoch seconds; it becomes a UTC timestamp."""
    return read_csv(spark, path, schema).withColumn(column, F.timestamp_seconds(column))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a nested assessment, one article version a line."""
    return spark.read.schema(ARTICLES).json(path)


def load_summary(df: DataFrame, date: str, label: str | None = None) -> DataFrame:
    """Rows, columns, first and last date, and the count of each label (one row for each label)."""
    base = [F.count("*").alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date")]
    out = df.groupBy(label).agg(*base) if label else df.agg(*base)
    return out.withColumn("n_columns", F.lit(len(df.columns)))


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ("series_id",), mode: str = "errorifexists") -> None:
    """Parquet with a folder for each value of `by`; rows of one value meet first, so folders hold few files."""
    (df.repartition(*by) if by else df).write.mode(mode).partitionBy(*by).parquet(path)


def write_forecast(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Bands, history, paths and metrics of a forecast run, a Parquet table each: name -> place."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in tables}
