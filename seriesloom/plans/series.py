"""Resampling, cleaning, joins, windows and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import calendars, clean, indicators, joins, scan, windows
from ..sources import tables as sources
from ..storage import shared_path
from .base import BARS, BARS_ALL, KEYS, TS, W, bars, query, raw_daily, roll, rounded, table

EVENTS_DATES = ["1996-02-11", "1998-07-20", "2000-11-05"]
PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
OHLC = ["open", "high", "low", "close"]


# -- sources and sinks -----------------------------------------------------------------------------
@query(f"WITH {BARS} SELECT series_id, date, open, high, low, close, volume FROM daily")
def source_csv_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars written as CSV and read with an explicit schema."""
    path = shared_path(spark, "csv")
    raw_daily(spark, sf_dir).select("series_id", "date", *OHLC, "volume").write.option("header", True).csv(path)
    return sources.read_csv(spark, path, sources.DAILY_OHLCV)


@query("SELECT date_trunc('second', ts) AS ts, value AS close FROM events")
def source_csv_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with epoch seconds, read to UTC timestamps."""
    path = shared_path(spark, "epoch")
    events = table(spark, sf_dir, "events").select(F.unix_timestamp("ts").alias("Timestamp"), F.col("value").alias("Close"))
    events.write.option("header", True).csv(path)
    return sources.read_epoch_csv(spark, path, "Timestamp long, Close double").select(F.col("Timestamp").alias("ts"), F.col("Close").alias("close"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 13 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) END AS published,
    CASE WHEN quality IS NULL THEN NULL ELSE quality - toxic END AS polarity FROM documents LEFT JOIN labels USING (doc_id)""")
def source_jsonl_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as JSON lines with a nested assessment, written and read with the nested schema."""
    path = shared_path(spark, "articles")
    articles(spark, sf_dir).write.json(path)
    return sources.read_articles(spark, path).select("id", F.to_date("published_at").alias("published"), F.col("assessment.result.sentiment.polarity").cast("int").alias("polarity"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as article records; one in thirteen has no publication time."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").dropDuplicates(["doc_id"]), "doc_id", "left")
    sentiment = F.struct((F.col("quality") - F.col("toxic")).cast("double").alias("polarity"), F.lit(1.0).alias("magnitude"))
    result = F.struct(sentiment.alias("sentiment"), F.lit(0.5).alias("confidence"), F.array("lang").alias("entities"), F.split("text", "\n").alias("events"))
    published = F.when(F.col("doc_id") % 13 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("timestamp"))
    return d.select(F.col("doc_id").cast("string").alias("id"), published.alias("published_at"), F.col("text").alias("raw_text"), "source", F.struct(result.alias("result")).alias("assessment"))


@query(f"WITH {BARS} SELECT series_id, date, open, high, low, close, volume FROM bars")
def sink_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular bars written in a folder for each series and read back."""
    path = shared_path(spark, "bars")
    sources.write_table(bars(spark, sf_dir), path)
    return spark.read.parquet(path).withColumn("series_id", F.col("series_id").cast("string")).select("series_id", "date", *OHLC, "volume")


@query("SELECT event_type, count(*) AS n_rows, CAST(min(ts) AS DATE) AS first_date, CAST(max(ts) AS DATE) AS last_date, 6 AS n_columns FROM events GROUP BY event_type")
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.load_summary(table(spark, sf_dir, "events"), "ts", "event_type").withColumns({c: F.to_date(c) for c in ("first_date", "last_date")})


# -- resampling ------------------------------------------------------------------------------------
@query(f"WITH {BARS} SELECT series_id, date, open, high, low, close, volume FROM daily")
def daily_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_daily(spark, sf_dir)


@query(f"""WITH {BARS} SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, date) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM daily GROUP BY 1, 2""")
def monthly_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.roll_up(raw_daily(spark, sf_dir), KEYS, TS, F.trunc("date", "MM"), "month")


IRREGULAR = "e AS (SELECT event_type AS series_id, ts, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS price, CASE WHEN event_id % 2 = 0 THEN value END AS extra FROM events)"


def irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("series_id"), F.struct("ts", "event_id").alias("at"), "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("price"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("extra"))


def _first_sql(bin: str, step: str, fill: bool) -> str:
    binned = f"""b AS (SELECT series_id, {bin} AS bin, arg_min(price, (ts, event_id)) FILTER (WHERE price IS NOT NULL) AS price,
    arg_min(extra, (ts, event_id)) FILTER (WHERE extra IS NOT NULL) AS extra FROM e GROUP BY 1, 2),
s AS (SELECT series_id, unnest(generate_series(min(bin), max(bin), INTERVAL {step})) AS bin FROM b GROUP BY series_id),
j AS (SELECT s.series_id, CAST(s.bin AS TIMESTAMP) AS bin, price, extra FROM s LEFT JOIN b ON s.series_id = b.series_id AND CAST(s.bin AS TIMESTAMP) = CAST(b.bin AS TIMESTAMP))"""
    if not fill:
        return f"WITH {IRREGULAR}, {binned} SELECT * FROM j"
    w = "OVER (PARTITION BY series_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"WITH {IRREGULAR}, {binned} SELECT series_id, bin, last_value(price IGNORE NULLS) {w} AS price, last_value(extra IGNORE NULLS) {w} AS extra FROM j"


@query(_first_sql("date_trunc('hour', ts)", "1 HOUR", True))
def hourly_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the first known value, empty hours kept and filled forward, in daily buckets."""
    first = calendars.resample_first(irregular(spark, sf_dir), KEYS, "at", ["price", "extra"], calendars.hour_bin("ts"))
    return clean.ffill(calendars.on_spine(first, KEYS, "bin", "interval 1 hour"), ["price", "extra"], KEYS, "bin", F.to_date("bin"))


@query(_first_sql("CAST(ts AS DATE) + CAST((8 - isodow(CAST(ts AS DATE))) % 7 AS INTEGER)", "7 DAY", False).replace("CAST(s.bin AS TIMESTAMP) AS bin", "CAST(s.bin AS DATE) AS bin"))
def weekly_wmon_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks that end on Monday; empty weeks stay as rows of NULLs."""
    first = calendars.resample_first(irregular(spark, sf_dir), KEYS, "at", ["price", "extra"], calendars.week_ending_monday("ts"))
    return calendars.on_spine(first, KEYS, "bin", "interval 7 day")


@query(f"""WITH {BARS} SELECT series_id, last_day(date) AS bin, arg_min(close, date) AS close FROM daily GROUP BY 1, 2""")
def month_end_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.resample_first(raw_daily(spark, sf_dir), KEYS, TS, ["close"], calendars.month_end("date"))


@query(f"""WITH {BARS}, m AS (SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS date, round(sum(close), 2) AS monthly FROM daily GROUP BY 1, 2)
SELECT series_id, date, last_value(monthly IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS monthly
FROM spine LEFT JOIN m USING (series_id, date)""")
def monthly_to_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = raw_daily(spark, sf_dir)
    monthly = daily.groupBy("series_id", F.trunc("date", "MM").alias("date")).agg(F.round(F.sum("close"), 2).alias("monthly"))
    return calendars.expand_daily(monthly, calendars.spine(daily, KEYS, TS), KEYS, TS, ["monthly"])


@query("""SELECT event_id, isodow(ts) - 1 AS dayofweek, month(ts) AS month, quarter(ts) AS quarter, dayofyear(ts) AS dayofyear, hour(ts) AS hour,
    year(ts) AS year, day(ts) AS dayofmonth, weekofyear(ts) AS weekofyear FROM events""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.calendar_features(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", hourly=True).drop("ts")


@query(f"""WITH {BARS}, k AS (SELECT CAST(unnest({EVENTS_DATES}) AS DATE) AS d), q AS (SELECT d, false AS p FROM k UNION ALL SELECT max(d) + 1458, true FROM k),
g AS (SELECT d AS a, lead(d) OVER (ORDER BY d) AS b, lead(p) OVER (ORDER BY d) AS p FROM q),
r AS (SELECT series_id, date, p, date - a AS since, b - date AS until FROM spine LEFT JOIN g ON date >= a AND date < b)
SELECT series_id, date, p AS next_is_projected, since AS days_since_last, until AS days_until_next, round(since / CAST(since + until AS DOUBLE), 6) AS cycle_phase,
    round(sin(2 * pi() * (since / CAST(since + until AS DOUBLE))), 6) AS phase_sin, round(cos(2 * pi() * (since / CAST(since + until AS DOUBLE))), 6) AS phase_cos FROM r""")
def event_cycle_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = calendars.spine(raw_daily(spark, sf_dir), KEYS, TS)
    events = spark.createDataFrame([(d,) for d in EVENTS_DATES], "d string").select(F.to_date("d").alias("event"))
    return rounded(calendars.event_cycle(days, KEYS, TS, events, "event"), ["cycle_phase", "phase_sin", "phase_cos"])


# -- cleaning --------------------------------------------------------------------------------------
@query(f"""WITH {BARS}, g AS (SELECT series_id, date, CASE WHEN extract(day FROM date) > 6 AND close > 60000 THEN close END AS v FROM spine LEFT JOIN daily USING (series_id, date)),
c AS (SELECT *, count(v) OVER (PARTITION BY series_id ORDER BY date) AS seen, first_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f,
    last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM g)
SELECT series_id, date, CASE WHEN seen = 0 THEN f ELSE l END AS v, seen = 0 AND f IS NOT NULL AS v_is_backfilled FROM c""")
def ffill_bfill_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading gaps filled from the future with a flag, inner gaps carried forward."""
    full = calendars.on_spine(raw_daily(spark, sf_dir), KEYS, TS)
    gappy = full.select("series_id", "date", F.when((F.dayofmonth("date") > 6) & (F.col("close") > 60000), F.col("close")).alias("v"))
    return clean.ffill(clean.bfill_leading(gappy, ["v"], KEYS, TS), ["v"], KEYS, TS)


@query(f"""SELECT o_orderkey, list_position({PRIORITIES}, o_orderpriority) - 1 AS level, CAST(o_orderstatus = 'F' AS INTEGER) AS closed FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'
UNION ALL SELECT o_orderkey, NULL, CAST(o_orderstatus = 'F' AS INTEGER) FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'""")
def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered labels to numbers (an unknown label is NULL), a flag to 0/1."""
    label = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "other").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.ordinal(label, PRIORITIES).alias("level"), scalar.flag(F.col("o_orderstatus") == "F").alias("closed"))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS per_discount, CASE WHEN l_discount - 0.05 > 0 THEN round(ln(l_discount - 0.05), 6) END AS log_over,
    greatest(l_discount - l_tax, 0) AS gain, greatest(l_tax - l_discount, 0) AS loss, CASE WHEN l_discount > l_tax THEN 1 WHEN l_discount < l_tax THEN 0 END AS label
FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND l_returnflag <> 'R'""")
def null_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe division, logs and clips, labels by mask, range filter, flagged rows left out."""
    df = clean.between(table(spark, sf_dir, "lineitem"), "l_quantity", 10.0, 30.0).withColumn("returned", F.col("l_returnflag") == "R")
    d = F.col("l_discount") - F.col("l_tax")
    return clean.known_rows(df, "returned").select(
        "l_orderkey", "l_linenumber", F.round(scalar.safe_divide("l_extendedprice", "l_discount"), 4).alias("per_discount"), F.round(scalar.log(F.col("l_discount") - 0.05), 6).alias("log_over"),
        scalar.gain(d).alias("gain"), scalar.loss(d).alias("loss"), clean.masked_label([(F.col("l_discount") > F.col("l_tax"), 1), (F.col("l_discount") < F.col("l_tax"), 0)]).alias("label"),
    )


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem")
def numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by type and by name list; wanted columns that are absent are passed over."""
    df = table(spark, sf_dir, "lineitem")
    return clean.numeric_features(df, ["l_tax"]).select(clean.present(df, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "absent", "l_quantity", "l_extendedprice", "l_discount"]))


# -- joins -----------------------------------------------------------------------------------------
@query(f"""WITH {BARS}, e0 AS (SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS date, round(sum(l_quantity), 2) AS shipped FROM lineitem GROUP BY 1, 2), e AS (SELECT date, round(sum(shipped), 2) AS shipped FROM e0 GROUP BY 1)
SELECT s.series_id, s.date, s.close, e.shipped FROM bars s ASOF LEFT JOIN e ON s.date >= e.date""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known shipment at or before each day, read in yearly buckets."""
    left = bars(spark, sf_dir).select("series_id", "date", "close")
    right = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.round(F.sum("l_quantity"), 2).alias("shipped"))
    # one event series: its last value as of each day is carried once, and every price series meets it by the day
    days = left.select("date").distinct().withColumn("_market", F.lit(1))
    known = joins.asof(days, right.withColumn("_market", F.lit(1)), ["_market"], TS, ["shipped"], F.year("date"))
    return left.join(known.drop("_market"), "date", "left").select("series_id", "date", "close", "shipped")


LAGS = {"quantity": 45, "price": 60, "lines": 0}


@query(f"""WITH {BARS}, m AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT s.series_id, s.date, q.quantity, p.price, l.lines FROM spine s ASOF LEFT JOIN (SELECT series_id, date + 45 AS date, quantity FROM m) q ON s.series_id = q.series_id AND s.date >= q.date
ASOF LEFT JOIN (SELECT series_id, date + 60 AS date, price FROM m) p ON s.series_id = p.series_id AND s.date >= p.date ASOF LEFT JOIN (SELECT series_id, date, lines FROM m) l ON s.series_id = l.series_id AND s.date >= l.date""")
def release_lag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sums of each series on its daily rows from their release day on, each column with its own lag."""
    days = calendars.spine(raw_daily(spark, sf_dir), KEYS, TS)
    return joins.release_lagged(days, monthly_lines(spark, sf_dir), KEYS, TS, LAGS)


def monthly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"), "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series_id"))
    m = lines.join(orders, "o_orderkey").groupBy("series_id", "date")
    return m.agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("*").alias("lines"))


@query(f"""WITH {BARS}, a AS (SELECT series_id, date, close FROM daily WHERE date >= DATE '1995-02-01'), b AS (SELECT series_id, date, volume FROM daily WHERE date >= DATE '1995-03-15' AND volume > 1),
w AS (SELECT series_id, date, close, b.volume FROM spine LEFT JOIN a USING (series_id, date) LEFT JOIN b USING (series_id, date)),
f AS (SELECT series_id, greatest(min(date) FILTER (WHERE close IS NOT NULL), min(date) FILTER (WHERE volume IS NOT NULL)) AS start FROM w GROUP BY 1)
SELECT w.* FROM w JOIN f USING (series_id) WHERE date >= start""")
def master_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables joined to the day spine, from the latest first day on."""
    daily = raw_daily(spark, sf_dir)
    a = daily.where("date >= '1995-02-01'").select("series_id", "date", "close")
    b = daily.where("date >= '1995-03-15' and volume > 1").select("series_id", "date", "volume")
    return joins.master(calendars.spine(daily, KEYS, TS), [a, b], KEYS, TS, ["close", "volume"])


@query(f"""WITH {BARS} SELECT series_id, date, CASE WHEN date <= DATE '2000-01-01' THEN close END AS train_close, CASE WHEN date > DATE '2000-01-01' THEN close END AS test_close FROM bars""")
def outer_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split by date, then a full outer join of the parts."""
    train, test = clean.split_at(bars(spark, sf_dir).select("series_id", "date", "close"), "date", "2000-01-01")
    return joins.outer_parts(train.withColumnsRenamed({"close": "train_close"}), test.withColumnsRenamed({"close": "test_close"}), ["series_id", "date"])


@query(f"""WITH {BARS}, f AS (SELECT series_id, date, close AS actual, lag(close, 1) {W} AS naive, {roll('close', 7, 'avg')} AS smooth FROM bars)
SELECT series_id, date, actual, naive, round(smooth, 4) AS smooth FROM f WHERE naive IS NOT NULL AND smooth IS NOT NULL""")
def merge_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual values and two forecasts by timestamp, joined on their common columns."""
    b, w = bars(spark, sf_dir), clean.by(KEYS, TS)
    actual = b.select("series_id", "date", F.col("close").alias("actual"))
    naive = b.select("series_id", "date", windows.lag("close", 1, w).alias("naive")).dropna()
    smooth = b.select("series_id", "date", F.round(windows.rolling("close", 7, w, "mean"), 4).alias("smooth")).dropna()
    return joins.merge_common(joins.merge_common(actual, naive), smooth)


@query("""SELECT 'event' AS kind, event_id AS id, value, NULL AS priority FROM events UNION ALL SELECT 'order', o_orderkey, o_totalprice, o_orderpriority FROM orders""")
def vertical_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables with different columns."""
    e = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "value")
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("priority"))
    return joins.stack([e, o])


# -- windows ---------------------------------------------------------------------------------------
@query(f"""WITH {BARS} SELECT series_id, date, {', '.join(f'lag(close, {n}) {W} AS lag_{n}' for n in (1, 3, 7, 14, 30))},
    {', '.join(f"round({roll('close', n, h)}, 4) AS roll_{h}_{n}" for n in (7, 30) for h in ('avg', 'stddev_samp', 'min', 'max'))},
    close - lag(close, 7) {W} AS diff_7, round(close / lag(close, 1) {W} - 1, 6) AS pct,
    max(close) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past_max FROM bars""")
def lags_rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = clean.by(KEYS, TS)
    names = {"avg": "mean", "stddev_samp": "std", "min": "min", "max": "max"}
    out = {f"lag_{n}": windows.lag("close", n, w) for n in (1, 3, 7, 14, 30)}
    out |= {f"roll_{h}_{n}": F.round(windows.rolling("close", n, w, names[h]), 4) for n in (7, 30) for h in names}
    out |= {"diff_7": windows.difference("close", 7, w), "pct": F.round(windows.percent_change("close", w), 6), "past_max": windows.expanding("close", w, "max")}
    return bars(spark, sf_dir).select("series_id", "date", "close").withColumns(out).drop("close")


@query(f"WITH {BARS_ALL} SELECT series_id, date, round({roll('close', 30, 'stddev_samp')}, 4) AS std_30, lag(close, 30) {W} AS lag_30, lead(close, 30) {W} AS lead_30 FROM bars")
def halo_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series in blocks of days: rolling, lag and lead without one task for the series."""
    held = windows.with_halo(bars(spark, sf_dir, F.lit("all")).select("series_id", "date", "close"), TS, 256, 30, 30)
    w = Window.partitionBy("series_id", "_block").orderBy("date")
    return windows.drop_halo(held.withColumns({"std_30": F.round(windows.rolling("close", 30, w, "std"), 4), "lag_30": F.lag("close", 30).over(w), "lead_30": F.lead("close", 30).over(w)})).drop("close")


@query(f"WITH {BARS} SELECT series_id, date, round(ln(lead(close, 30) {W} / close), 6) AS return_30d, round(ln(lead(close, 7) {W} / close), 6) AS return_7d FROM bars")
def future_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = clean.by(KEYS, TS)
    return bars(spark, sf_dir).select("series_id", "date", F.round(windows.future_return("close", 30, w), 6).alias("return_30d"), F.round(windows.future_return("close", 7, w), 6).alias("return_7d"))


@query(f"WITH {BARS}, p AS (SELECT series_id, date, close, lead(close) {W} AS target FROM bars) SELECT * FROM p WHERE target IS NOT NULL")
def supervised_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.supervised_pairs(bars(spark, sf_dir).select("series_id", "date", "close"), KEYS, TS, "close")


@query(f"""WITH {BARS}, r AS (SELECT series_id, date, close, row_number() OVER (PARTITION BY series_id ORDER BY close DESC, date) AS k FROM bars) SELECT series_id, date, close FROM r WHERE k = 1""")
def best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.best_row(bars(spark, sf_dir).select("series_id", "date", "close"), KEYS, "close", "date")


@query(f"WITH {BARS} SELECT series_id, date, close FROM bars ORDER BY close DESC, date, series_id LIMIT 15")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("series_id", "date", "close").orderBy(F.desc("close"), "date", "series_id").limit(15)


# -- recursive smoothing and indicators --------------------------------------------------------------
def _recursive(source: str, specs: dict[str, tuple[str, float, int]]) -> str:
    """Recursive SQL for exponential averages over a table with series_id, date and value columns without inner NULLs."""
    values = sorted({v for v, _, _ in specs.values()})
    first = ", ".join(f"CAST({v} AS DOUBLE) AS {n}, CASE WHEN {v} IS NULL THEN 0 ELSE 1 END AS c_{n}" for n, (v, _, _) in specs.items())
    step = ", ".join(f"CASE WHEN r.{n} IS NULL THEN o.{v} ELSE (1 - {a!r}) * r.{n} + {a!r} * o.{v} END, r.c_{n} + CASE WHEN o.{v} IS NULL THEN 0 ELSE 1 END" for n, (v, a, _) in specs.items())
    return f"""o AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn, {', '.join(values)} FROM {source}),
r AS (SELECT series_id, date, rn, {first} FROM o WHERE rn = 1 UNION ALL SELECT o.series_id, o.date, o.rn, {step} FROM r JOIN o ON o.series_id = r.series_id AND o.rn = r.rn + 1)"""


def _least(specs) -> str:
    return ", ".join(f"CASE WHEN c_{n} >= {max(1, m)} THEN {n} END AS {n}" for n, (_, _, m) in specs.items())


_EMA = {f"ema_{n}": ("close", 2 / (n + 1), n) for n in (5, 8, 13, 21, 50, 100, 200)}


@query(f"""WITH RECURSIVE {BARS}, {_recursive('bars', _EMA)}, e AS (SELECT series_id, date, {_least(_EMA)} FROM r)
SELECT series_id, date, {', '.join(f'round({n}, 4) AS {n}, round(close / {n} - 1, 6) AS ema_distance_{n[4:]}, round({n} / lag({n}) {W} - 1, 6) AS ema_slope_{n[4:]}' for n in _EMA)} FROM e JOIN bars USING (series_id, date)""")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential averages by the chunked scan, with distances and slopes."""
    spans = (5, 8, 13, 21, 50, 100, 200)
    df = indicators.ema_features(bars(spark, sf_dir), KEYS, TS, spans)
    return rounded(rounded(df, [f"ema_{n}" for n in spans], 4), [f"ema_{k}_{n}" for n in spans for k in ("distance", "slope")]).select("series_id", "date", *[c for c in df.columns if c.startswith("ema_")])


_RSI = {f"{c}_{n}": (c, 1 / n, n) for n in (7, 14, 21, 28) for c in ("g", "l")}


@query(f"""WITH RECURSIVE {BARS}, d AS (SELECT series_id, date, greatest(close - lag(close) {W}, 0) AS g0, greatest(lag(close) {W} - close, 0) AS l0, lag(close) {W} AS p FROM bars),
x AS (SELECT series_id, date, CASE WHEN p IS NOT NULL THEN g0 END AS g, CASE WHEN p IS NOT NULL THEN l0 END AS l FROM d), {_recursive('x', _RSI)}, e AS (SELECT series_id, date, {_least(_RSI)} FROM r)
SELECT series_id, date, {', '.join(f'round(100 - 100 / (1 + g_{n} / nullif(l_{n}, 0)), 4) AS rsi_{n}, round(50 - 100 / (1 + g_{n} / nullif(l_{n}, 0)), 4) AS rsi_distance50_{n}' for n in (7, 14, 21, 28))} FROM e""")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = indicators.rsi(bars(spark, sf_dir), KEYS, TS)
    names = [c for c in df.columns if c.startswith("rsi")]
    return rounded(df, names, 4).select("series_id", "date", *names)


_ATR = {f"atr_{n}": ("tr", 1 / n, n) for n in (7, 14, 21)}


@query(f"""WITH RECURSIVE {BARS}, x AS (SELECT series_id, date, greatest(high - low, coalesce(abs(high - lag(close) {W}), 0), coalesce(abs(low - lag(close) {W}), 0)) AS tr FROM bars),
{_recursive('x', _ATR)}, e AS (SELECT series_id, date, {_least(_ATR)} FROM r)
SELECT series_id, date, round(tr, 4) AS true_range, {', '.join(f'round(atr_{n}, 4) AS atr_{n}, round(atr_{n} / close, 6) AS atr_norm_{n}' for n in (7, 14, 21))} FROM e JOIN bars USING (series_id, date) JOIN x USING (series_id, date)""")
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = indicators.atr(bars(spark, sf_dir), KEYS, TS)
    a, b = [f"atr_{n}" for n in (7, 14, 21)], [f"atr_norm_{n}" for n in (7, 14, 21)]
    return rounded(rounded(df, [*a, "true_range"], 4), b).select("series_id", "date", "true_range", *a, *b)


_FAST = {f"e{n}": ("close", 2 / (n + 1), 1) for n in (5, 12, 26, 35)}
_SIGNAL = lambda n: f"s{n} AS (SELECT series_id, date, rn, m{n}, m{n} AS g FROM m WHERE rn = 1 UNION ALL SELECT m.series_id, m.date, m.rn, m.m{n}, (1 - {2 / (n + 1)!r}) * s{n}.g + {2 / (n + 1)!r} * m.m{n} FROM s{n} JOIN m ON m.series_id = s{n}.series_id AND m.rn = s{n}.rn + 1)"
_MACD = lambda n, x: f"round(s{n}.m{n}, 3) + 0.0 AS macd_{x}, round(s{n}.g, 3) + 0.0 AS macd_signal_{x}, round(s{n}.m{n} - s{n}.g, 3) + 0.0 AS macd_gap_{x}, round((s{n}.m{n} - s{n}.g) / close, 6) + 0.0 AS macd_hist_{x}"


@query(f"""WITH RECURSIVE {BARS}, {_recursive('bars', _FAST)}, m AS (SELECT series_id, date, rn, e12 - e26 AS m9, e5 - e35 AS m5 FROM r), {_SIGNAL(9)}, {_SIGNAL(5)}
SELECT series_id, date, {_MACD(9, '12_26_9')}, {_MACD(5, '5_35_5')} FROM s9 JOIN s5 USING (series_id, date) JOIN bars USING (series_id, date)""")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = indicators.macd(bars(spark, sf_dir), KEYS, TS)
    digits = {"macd": 3, "macd_signal": 3, "macd_gap": 3, "macd_hist": 6}
    return df.select("series_id", "date", *[(F.round(f"{c}_{x}", d) + 0.0).alias(f"{c}_{x}") for x in ("12_26_9", "5_35_5") for c, d in digits.items()])


@query(f"""WITH {BARS}, b AS (SELECT series_id, date, close, {', '.join(f"{roll('close', n, 'avg')} AS m{n}, {roll('close', n, 'stddev_samp')} AS s{n}" for n in (14, 20, 30))} FROM bars)
SELECT series_id, date, {', '.join(f'round(m{n}, 4) AS bb_mid_{n}, round(m{n} + 2 * s{n}, 4) AS bb_upper_{n}, round(m{n} - 2 * s{n}, 4) AS bb_lower_{n}, round((close - (m{n} - 2 * s{n})) / nullif(4 * s{n}, 0), 4) AS bb_percent_b_{n}, round(4 * s{n} / m{n}, 4) AS bb_width_{n}' for n in (14, 20, 30))} FROM b""")
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = indicators.bollinger(bars(spark, sf_dir), KEYS, TS)
    names = [c for c in df.columns if c.startswith("bb_")]
    return rounded(df, names, 4).select("series_id", "date", *names)


_LR = f"l AS (SELECT *, ln(close / lag(close) {W}) AS lr FROM bars)"


@query(f"""WITH {BARS}, {_LR} SELECT series_id, date, {', '.join(f"round(ln(close / lag(close, {n}) {W}), 6) AS log_return_{n}d, round({roll('lr', n, 'stddev_samp')}, 6) AS volatility_{n}d, round(close / {roll('close', n, 'max')} - 1, 6) AS drawdown_{n}d, round((close - {roll('close', n, 'min')}) / nullif({roll('close', n, 'max')} - {roll('close', n, 'min')}, 0), 6) AS channel_pos_{n}d" for n in (3, 30, 90))} FROM l""")
def drawdown_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = indicators.returns_and_range(bars(spark, sf_dir), KEYS, TS, (3, 30, 90))
    names = [c for c in df.columns if c.endswith("d") and c[:3] in ("log", "vol", "dra", "cha")]
    return rounded(df, names).select("series_id", "date", *names)


@query(f"""WITH {BARS} SELECT series_id, date, round((high - low) / close, 6) AS candle_range_pct, round((close - open) / open, 6) AS candle_body_pct,
    round((close - low) / nullif(high - low, 0), 6) AS candle_close_location, round(open / lag(close) {W} - 1, 6) AS candle_gap_pct FROM bars""")
def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = indicators.candles(bars(spark, sf_dir), KEYS, TS)
    names = [c for c in df.columns if c.startswith("candle")]
    return rounded(df, names).select("series_id", "date", *names)


@query(f"""WITH {BARS}, {_LR} SELECT series_id, date, round({roll('lr', 14, 'stddev_samp')} * sqrt(365) * 100, 4) AS realized_vol_14, round({roll('lr', 30, 'stddev_samp')} * sqrt(365) * 100, 4) AS realized_vol_30,
    round({roll('lr', 7, 'stddev_samp')} * sqrt(7), 6) AS weekly_vol FROM l""")
def realized_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = indicators.realised_volatility(bars(spark, sf_dir), KEYS, TS)
    return rounded(rounded(df, ["realized_vol_14", "realized_vol_30"], 4), ["weekly_vol"]).select("series_id", "date", "realized_vol_14", "realized_vol_30", "weekly_vol")


@query(f"""WITH RECURSIVE {BARS_ALL}, {_recursive('bars', {'e': ('close', 2 / 13, 1)})} SELECT series_id, date, round(e, 4) AS ema_12 FROM r""")
def affine_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan itself over one long series, in chunks of 50 days."""
    b = bars(spark, sf_dir, F.lit("all")).select("series_id", "date", "close")
    first = F.row_number().over(clean.by(KEYS, TS)) == 1
    b = b.withColumn("_first", first)
    maps = {"e": (F.when(F.col("_first"), 0.0).otherwise(11 / 13), F.when(F.col("_first"), F.col("close")).otherwise(F.col("close") * 2 / 13))}
    return scan.affine_scan(b, KEYS, TS, maps, F.floor(F.unix_date("date") / 50)).select("series_id", "date", F.round("e", 4).alias("ema_12"))


# -- scalar functions ------------------------------------------------------------------------------
@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings), m AS (SELECT vec_id, list_transform(l, lambda x: exp(x - list_max(l))) AS p FROM v)
SELECT vec_id, round(p[1] / list_sum(p), 6) AS p0, round(p[2] / list_sum(p), 6) AS p1, round(p[4] / list_sum(p), 6) AS p3 FROM m""")
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over the first four entries of each vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("l"))
    return e.select("vec_id", scalar.softmax("l").alias("p")).select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in (0, 1, 3)])


@query("""SELECT l_orderkey, l_linenumber, round((l_discount + l_tax) / 2, 6) AS mean_rate, greatest(l_discount, l_tax) AS max_rate, round(100 * l_tax / nullif(l_discount, 0), 4) AS tax_pct_of_discount,
    round(l_tax * sqrt(365) * 100, 4) AS annualised_tax, round(sin(2 * pi() * l_discount), 6) AS phase_sin, round(cos(2 * pi() * l_discount), 6) AS phase_cos FROM lineitem""")
def row_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and maxima over columns, percentages, annualised and cyclic values."""
    sin, cos = scalar.cyclic("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(scalar.mean_of(["l_discount", "l_tax"]), 6).alias("mean_rate"), scalar.max_of(["l_discount", "l_tax"]).alias("max_rate"), F.round(scalar.percent_of("l_tax", "l_discount"), 4).alias("tax_pct_of_discount"),
        F.round(scalar.annualised("l_tax"), 4).alias("annualised_tax"), F.round(sin, 6).alias("phase_sin"), F.round(cos, 6).alias("phase_cos"),
    )


@query("""SELECT event_id, coalesce(CAST(props->>'$.k' AS BIGINT), -1) AS k, date_trunc('hour', ts) AS hour, CAST(ts AS DATE) + 30 AS due FROM events""")
def json_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON text as a map entry with a default, truncated times and date arithmetic."""
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, sf_dir, "events").select("event_id", scalar.map_get(m, "k", -1).cast("long").alias("k"), F.date_trunc("hour", "ts").alias("hour"), F.date_add("ts", 30).alias("due"))


@query(f"""WITH {BARS}, f AS (SELECT series_id, date, close, lag(close) {W} AS naive, {roll('close', 7, 'avg')} AS smooth, {roll('close', 30, 'avg')} AS slow FROM bars)
SELECT 'naive' AS a, 'smooth' AS b, round(corr(naive, smooth), 6) AS r, count(smooth) AS n FROM f UNION ALL SELECT 'naive', 'slow', round(corr(naive, slow), 6), count(slow) FROM f UNION ALL SELECT 'smooth', 'slow', round(corr(smooth, slow), 6), count(slow) FROM f""")
def model_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of three forecasts' outputs over rows where both are known."""
    from ..operators import splits

    w = clean.by(KEYS, TS)
    f = bars(spark, sf_dir).select(windows.lag("close", 1, w).alias("naive"), windows.rolling("close", 7, w, "mean").alias("smooth"), windows.rolling("close", 30, w, "mean").alias("slow"))
    return rounded(splits.correlations(f, ["naive", "smooth", "slow"]), ["r"])


@query(f"WITH {BARS} SELECT 'bands' AS name, series_id, date, close, volume FROM bars UNION ALL SELECT 'history', series_id, date, close, volume FROM daily")
def forecast_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast tables written side by side and read back from where they were put."""
    path = shared_path(spark, "run")
    places = sources.write_forecast({"bands": bars(spark, sf_dir), "history": raw_daily(spark, sf_dir)}, path)
    held = [spark.read.parquet(p).select(F.lit(n).alias("name"), "series_id", "date", "close", "volume") for n, p in places.items()]
    return held[0].unionByName(held[1])


@query(f"""WITH {BARS_ALL} SELECT CAST(date_trunc('month', date) AS DATE) AS date, arg_max(close, date) AS Close, max(high) AS High, min(low) AS Low, arg_min(open, date) AS Open, CAST(sum(volume) AS BIGINT) AS Volume FROM daily GROUP BY 1""")
def source_csv_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monthly OHLCV file in its own column order, read by name with its schema."""
    path = shared_path(spark, "monthly")
    months = calendars.roll_up(raw_daily(spark, sf_dir, F.lit("all")), KEYS, TS, F.trunc("date", "MM"), "date")
    months.select("date", *[F.col(c.lower()).alias(c) for c in ("Close", "High", "Low", "Open", "Volume")]).write.option("header", True).csv(path)
    return sources.read_csv(spark, path, sources.MONTHLY_OHLCV)


@query(f"""WITH {BARS_ALL}, v AS (SELECT date, CASE WHEN isodow(date) <= 5 THEN round(100 * (high - low) / close, 6) END AS dvol FROM bars), k AS (SELECT * FROM v WHERE dvol IS NOT NULL)
SELECT bars.date, close, dvol FROM bars LEFT JOIN k USING (date)""")
def source_csv_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of closes and one of implied volatility with missing days, read with their schemas and joined by day."""
    prices, quoted = shared_path(spark, "prices"), shared_path(spark, "dvol")
    b = bars(spark, sf_dir, F.lit("all"))
    b.select("date", "close").write.option("header", True).csv(prices)
    b.where("weekday(date) < 5").select("date", F.round(100 * (F.col("high") - F.col("low")) / F.col("close"), 6).alias("dvol")).write.option("header", True).csv(quoted)
    return sources.read_csv(spark, prices, sources.PRICE).join(sources.read_csv(spark, quoted, sources.IMPLIED_VOLATILITY), "date", "left")


_GAPPY = f"g AS (SELECT s.series_id, s.date, d.close, d.volume, {roll('d.close', 3, 'avg').replace('PARTITION BY series_id ORDER BY date', 'PARTITION BY s.series_id ORDER BY s.date')} AS mean_3 FROM spine s LEFT JOIN daily d ON d.series_id = s.series_id AND d.date = s.date)"


@query(f"""WITH {BARS}, {_GAPPY}, f AS (SELECT series_id, date, close, coalesce(volume, 0) AS volume, mean_3 FROM g)
SELECT 'filled' AS rows, series_id, date, close, volume, round(mean_3, 4) AS mean_3 FROM f UNION ALL SELECT 'known_mean', series_id, date, close, volume, round(mean_3, 4) FROM g WHERE mean_3 IS NOT NULL
UNION ALL SELECT 'complete', series_id, date, close, volume, round(mean_3, 4) FROM g WHERE close IS NOT NULL AND volume IS NOT NULL AND mean_3 IS NOT NULL""")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without orders: volume filled with 0; rows without NULL in one column; rows without any NULL."""
    g = calendars.on_spine(raw_daily(spark, sf_dir), KEYS, TS, "interval 1 day").select("series_id", "date", "close", "volume")
    g = g.withColumn("mean_3", windows.rolling("close", 3, clean.by(KEYS, TS), "mean"))
    parts = {"filled": clean.fill_constant(g, {"volume": 0}), "known_mean": clean.complete(g, ["mean_3"]), "complete": clean.complete(g)}
    return rounded(joins.stack([df.withColumn("rows", F.lit(n)) for n, df in parts.items()]), ["mean_3"], 4)
