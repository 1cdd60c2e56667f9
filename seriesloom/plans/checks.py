"""Data quality, labels and splits, selection, metrics and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import calendars, clean, indicators, joins, metrics, quality, splits, text, windows
from ..sources import tables as sources
from ..storage import shared_path
from .base import BARS, BARS_ALL, KEYS, TS, W, bars, query, raw_daily, roll, rounded, table, written
from .series import articles

NULLABLE = ["close", "open", "volume"]
_GAPPY = "SELECT series_id, date, open, close, volume, CASE WHEN close > 100000 THEN high END AS high FROM spine LEFT JOIN daily USING (series_id, date)"


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.on_spine(raw_daily(spark, sf_dir), KEYS, TS).withColumn("high", F.when(F.col("close") > 100000, F.col("high")))


# -- data quality ----------------------------------------------------------------------------------
@query(f"WITH {BARS}, g AS ({_GAPPY}) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS pct_missing FROM g" for c in ("close", "high", "volume", "date")))
def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gappy(spark, sf_dir).withColumn("date", F.col("date").cast("string"))
    cast = g.select(*[F.col(c).cast("string").alias(c) for c in ("close", "high", "volume", "date")])
    return rounded(quality.missing_profile(cast, cast.columns), ["pct_missing"])


@query(f"WITH {BARS}, g AS (SELECT series_id, lag(date) {W} AS gap_after, date AS gap_before FROM daily) SELECT series_id, gap_after, gap_before, CAST(gap_before - gap_after - 1 AS INTEGER) AS n_days FROM g WHERE gap_before - gap_after > 1")
def date_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.date_gaps(raw_daily(spark, sf_dir), KEYS, TS)


_DATE_TEXT = "CASE WHEN o_orderkey % 50 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderkey % 51 = 0 THEN '1999-02-31' ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query(f"""WITH t AS (SELECT {_DATE_TEXT} AS d FROM orders) SELECT count(d) AS n_values, count(*) FILTER (WHERE regexp_matches(d, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')) AS n_iso,
    count(*) FILTER (WHERE regexp_matches(d, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND try_cast(d AS DATE) IS NULL) AS n_not_a_date FROM t""")
def date_format_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("o_orderkey") % 50 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 51 == 0, "1999-02-31").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return quality.date_format_profile(table(spark, sf_dir, "orders").select(d.alias("d")), "d")


_IQR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v FROM lineitem" for c in _IQR) + """),
b AS (SELECT column_name, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS c FROM v GROUP BY 1), f AS (SELECT column_name, a - 1.5 * (c - a) AS lower, c + 1.5 * (c - a) AS upper FROM b)
SELECT column_name, round(lower, 4) AS lower, round(upper, 4) AS upper, count(*) AS n, count(*) FILTER (WHERE v < lower OR v > upper) AS n_outliers,
    round(100.0 * avg(CASE WHEN v < lower OR v > upper THEN 1 ELSE 0 END), 6) AS pct_outliers, min(v) FILTER (WHERE v < lower OR v > upper) AS min_outlier, max(v) FILTER (WHERE v < lower OR v > upper) AS max_outlier
FROM v JOIN f USING (column_name) GROUP BY column_name, lower, upper""")
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(quality.iqr_outliers(table(spark, sf_dir, "lineitem"), _IQR), ["lower", "upper"], 4), ["pct_outliers"])


@query(f"""WITH {BARS}, p AS (SELECT series_id, count(*) AS n, min(date) AS a, max(date) AS b, count(DISTINCT date) AS d FROM daily GROUP BY 1)
SELECT 'daily' AS table_name, 7 AS n_columns, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_series, min(a) AS first_date, max(b) AS last_date, CAST(sum(b - a + 1 - d) AS BIGINT) AS n_gap_days FROM p""")
def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.table_summary(raw_daily(spark, sf_dir), "daily", KEYS, TS)


@query(f"""WITH {BARS}, m AS (SELECT series_id, date, {roll('close', 20, 'avg')} AS ma, CASE WHEN volume > 0 THEN close END AS traded, row_number() {W} AS rn FROM bars)
SELECT 'ma' AS column_name, count(*) FILTER (WHERE ma IS NULL AND rn <= 20) AS n_warm_up, count(*) FILTER (WHERE ma IS NULL AND rn > 20) AS n_gap FROM m UNION ALL
SELECT 'traded', count(*) FILTER (WHERE traded IS NULL AND rn <= 1), count(*) FILTER (WHERE traded IS NULL AND rn > 1) FROM m""")
def missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULLs of a warm-up against true gaps; the bars themselves must be complete."""
    b = quality.require_complete(written(bars(spark, sf_dir), "bars"), ["open", "high", "low", "close"])
    m = b.withColumns({"ma": windows.rolling("close", 20, clean.by(KEYS, TS), "mean"), "traded": F.when(F.col("volume") > 0, F.col("close"))})
    return quality.classify_missing(m, KEYS, TS, {"ma": 20, "traded": 1})


_ARTICLES = """a AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 13 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) END AS published, text, quality - toxic AS polarity, lang, source FROM documents LEFT JOIN labels USING (doc_id)),
n AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM a),
e AS (SELECT *, CASE WHEN published IS NULL THEN 'invalid_timestamp' WHEN norm = '' THEN 'empty' WHEN polarity IS NULL THEN 'missing_label' END AS early FROM n),
t AS (SELECT *, row_number() OVER (PARTITION BY early IS NULL, norm ORDER BY published, id) AS turn FROM e),
u AS (SELECT *, coalesce(early, CASE WHEN turn > 1 THEN 'duplicate' ELSE 'retained' END) AS reason FROM t)"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir).withColumn("polarity", F.col("assessment.result.sentiment.polarity"))
    return text.clean_and_audit(a, "raw_text", "published_at", "polarity", "id")


@query(f"WITH {_ARTICLES} SELECT reason, count(*) AS n FROM u GROUP BY reason")
def dedup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {BARS_ALL} SELECT count(*) AS n_paired, 0 AS n_different FROM bars WHERE date <= DATE '1999-01-01'")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators before a cut don't change when what follows it does."""

    def features(df: DataFrame) -> DataFrame:
        df = indicators.macd(indicators.returns_and_range(df, KEYS, TS, (7, 30)), KEYS, TS, ((12, 26, 9),))
        return df

    b = written(bars(spark, sf_dir, F.lit("all")), "bars")
    return quality.leakage(b, features, KEYS, TS, ["open", "high", "low", "close"], ["log_return_30d", "volatility_30d", "drawdown_7d", "macd_hist_12_26_9"], __import__("datetime").date(1999, 1, 1))


# -- labels, splits, selection ---------------------------------------------------------------------
_LABEL = f"""l AS (SELECT *, ln(close / lag(close) {W}) AS lr FROM bars),
y AS (SELECT series_id, date, ln(lead(close, 7) {W} / close) AS fr, {roll('lr', 7, 'stddev_samp')} * sqrt(7) AS wv FROM l),
z AS (SELECT series_id, date, fr, wv, CASE WHEN fr > 0.5 * wv THEN 1 WHEN fr < -0.5 * wv THEN 0 END AS label FROM y)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.threshold_label(bars(spark, sf_dir), KEYS, TS)


@query(f"WITH {BARS}, {_LABEL} SELECT series_id, date, round(fr, 6) AS future_return, round(wv, 6) AS weekly_vol, label FROM z")
def threshold_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labelled(spark, sf_dir), ["future_return", "weekly_vol"]).select("series_id", "date", "future_return", "weekly_vol", "label")


_RN = "k AS (SELECT series_id, date, label, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM z WHERE label IS NOT NULL)"


@query(f"""WITH {BARS}, {_LABEL}, {_RN}, e AS (SELECT *, CAST(floor(n * 0.6) AS BIGINT) AS te, CAST(floor(n * 0.6) AS BIGINT) + CAST(floor(n * 0.2) AS BIGINT) AS ve FROM k)
SELECT series_id, date, label, rn, CASE WHEN rn < te THEN 'train' WHEN rn >= te + 7 AND rn < ve THEN 'validation' WHEN rn >= ve + 7 THEN 'test' END AS split FROM e""")
def purged_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.purged_split(labelled(spark, sf_dir).where("label is not null"), KEYS, TS).select("series_id", "date", "label", "rn", "split")


@query(f"""WITH {BARS}, {_LABEL}, {_RN}, f AS (SELECT *, CAST(floor(n * 0.5) AS BIGINT) AS st, unnest(range(4)) AS fold FROM k), g AS (SELECT *, CAST(floor((n - st) / 4.0) AS BIGINT) AS sz FROM f),
h AS (SELECT *, st + fold * sz AS lo, CASE WHEN fold < 3 THEN st + (fold + 1) * sz ELSE n END AS hi FROM g),
o AS (SELECT series_id, date, CAST(fold AS INTEGER) AS fold, CASE WHEN rn < lo - 7 THEN 'train' WHEN rn >= lo AND rn < hi THEN 'validation' END AS role FROM h WHERE lo - 7 > 0 AND hi > lo)
SELECT * FROM o WHERE role IS NOT NULL""")
def purged_cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.purged_folds(labelled(spark, sf_dir).where("label is not null"), KEYS, TS, 4).select("series_id", "date", "fold", "role")


def _walk_sql(purge: int) -> str:
    return f"""y AS (SELECT series_id, date, close, ln(lead(close, 30) {W} / close) AS target FROM bars),
v AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM y WHERE target IS NOT NULL),
f AS (SELECT *, n // 6 AS sz, unnest(range(1, 6)) AS fold FROM v),
wf AS (SELECT series_id, date, target, CAST(fold AS INTEGER) AS fold, CASE WHEN rn < sz * fold - {purge} THEN 'train' WHEN rn >= sz * fold AND rn < sz * (fold + 1) THEN 'test' END AS role FROM f)"""


def walk(spark: SparkSession, sf_dir: str, purge: int) -> DataFrame:
    target = windows.future_return("close", 30, clean.by(KEYS, TS))
    df = bars(spark, sf_dir).withColumn("target", target).where("target is not null")
    return splits.walk_forward(df, KEYS, TS, 5, purge)


@query(f"WITH {BARS}, {_walk_sql(30)} SELECT series_id, date, fold, role FROM wf WHERE role IS NOT NULL")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk(spark, sf_dir, 30).select("series_id", "date", "fold", "role")


@query("""WITH d AS (SELECT doc_id, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS date FROM documents), u AS (SELECT DISTINCT date FROM d),
r AS (SELECT date, row_number() OVER (ORDER BY date) / CAST(count(*) OVER () AS DOUBLE) AS s FROM u)
SELECT doc_id, date, CASE WHEN s <= 0.7 THEN 'train' WHEN s <= 0.85 THEN 'validation' ELSE 'test' END AS split FROM d JOIN r USING (date)""")
def date_quantile_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("date"))
    return splits.date_quantile_split(d, "date").select("doc_id", "date", "split")


@query(f"""WITH {BARS}, {_LABEL}, {_RN}, f AS (SELECT *, n // 6 AS sz, unnest(range(1, 6)) AS fold FROM k)
SELECT series_id, CAST(fold AS INTEGER) AS fold, count(DISTINCT label) >= 2 AS has_two_classes FROM f WHERE rn < sz * fold GROUP BY 1, 2""")
def two_class_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = splits.walk_forward(labelled(spark, sf_dir).where("label is not null"), KEYS, TS, 5)
    return splits.two_classes(folds.where("role = 'train'"), ["series_id", "fold"], "label")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count({a}) AS n FROM lineitem" for a, b in _PAIRS))
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(splits.correlations(table(spark, sf_dir, "lineitem"), _NUM), ["r"])


_PRUNED = ["close", "ma7", "ma8", "lag1", "twice", "one"]
_PAIR = lambda a, b: f"CASE WHEN abs(coalesce(CASE WHEN stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) > 0 AND stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL) > 0 THEN corr({a}, {b}) END, 0)) > 0.9 THEN '{a} {b}' END"


@query(f"""WITH RECURSIVE {BARS}, f AS (SELECT close, {roll('close', 7, 'avg')} AS ma7, {roll('close', 8, 'avg')} AS ma8, lag(close) {W} AS lag1, close * 2 AS twice, 1.0::DOUBLE AS one FROM bars),
b AS (SELECT [{', '.join(_PAIR(x, y) for i, x in enumerate(_PRUNED) for y in _PRUNED[i + 1:])}] AS bad FROM f), o AS (SELECT {_PRUNED} AS names),
k AS (SELECT 0 AS i, []::VARCHAR[] AS kept UNION ALL SELECT i + 1, CASE WHEN len(list_filter(kept, lambda x: list_contains(bad, x || ' ' || names[i + 1]))) > 0 THEN kept ELSE list_append(kept, names[i + 1]) END FROM k CROSS JOIN b CROSS JOIN o WHERE i < {len(_PRUNED)})
SELECT unnest(kept) AS feature FROM k WHERE i = {len(_PRUNED)}""")
def corr_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept features: the later one of each pair above 0.9 goes; a constant column stays."""
    w = clean.by(KEYS, TS)
    f = bars(spark, sf_dir).select("close", windows.rolling("close", 7, w, "mean").alias("ma7"), windows.rolling("close", 8, w, "mean").alias("ma8"), windows.lag("close", 1, w).alias("lag1"), (F.col("close") * 2).alias("twice"), F.lit(1.0).alias("one"))
    kept = splits.prune(f, ["close", "ma7", "ma8", "lag1", "twice", "one"], 0.9)
    return spark.createDataFrame([(k,) for k in kept], "feature string")


# -- metrics ---------------------------------------------------------------------------------------
_FORECAST = f"p AS (SELECT series_id, date, close AS actual, lag(close) {W} AS naive, {roll('close', 30, 'avg')} AS mid, {roll('close', 30, 'min')} AS lower, {roll('close', 30, 'max')} AS upper, lead(close, 7) {W} AS target FROM bars), q AS (SELECT * FROM p WHERE mid IS NOT NULL AND target IS NOT NULL)"


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range forecast a week ahead: the last month's mean, least and largest close."""
    w = clean.by(KEYS, TS)
    df = bars(spark, sf_dir).select("series_id", "date", F.col("close").alias("actual"), windows.lag("close", 1, w).alias("naive"), *[windows.rolling("close", 30, w, h).alias(n) for n, h in (("mid", "mean"), ("lower", "min"), ("upper", "max"))], F.lead("close", 7).over(w).alias("target"))
    return df.where("mid is not null and target is not null")


@query(f"""WITH {BARS}, {_FORECAST} SELECT series_id, count(*) AS n, round(avg(power(mid - target, 2)), 2) AS mse, round(avg(abs(mid - target)), 4) AS mae, round(1 - sum(power(mid - target, 2)) / (var_pop(target) * count(*)), 6) AS r2,
    round(avg(abs((mid - target) / target)), 6) AS mape, round(median(abs((mid - target) / target)), 6) AS median_ape FROM q GROUP BY 1""")
def point_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(rounded(metrics.point_metrics(forecasts(spark, sf_dir), KEYS, "target", "mid"), ["mse"], 2), ["mae"], 4), ["r2", "mape", "median_ape"])


@query(f"""WITH {BARS}, {_FORECAST} SELECT series_id, count(*) AS n, round(avg(abs((mid - target) / target)), 6) AS mape, round(avg(abs((naive - target) / target)), 6) AS naive_mape, round(100 * avg((upper - lower) / mid), 4) AS width_pct FROM q WHERE naive IS NOT NULL GROUP BY 1""")
def naive_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle's MAPE beside that of the day before's close, and the range's width in percent."""
    df = metrics.relative_metrics(forecasts(spark, sf_dir).where("naive is not null"), KEYS, "target", "mid", "naive", "lower", "upper")
    return rounded(rounded(df, ["mape", "naive_mape"]), ["width_pct"], 4)


@query(f"""WITH {BARS}, {_FORECAST} SELECT series_id, count(*) AS n, round(avg(CAST(target BETWEEN lower AND upper AS INTEGER)), 6) AS coverage, round(avg(upper - lower), 4) AS width, round(avg(CAST(target > upper AS INTEGER)), 6) AS upper_miss,
    round(avg(CAST(target < lower AS INTEGER)), 6) AS lower_miss, round(avg(abs(target - mid)), 4) AS mae_mid, round(avg((greatest(0.1 * (target - lower), -0.9 * (target - lower)) + greatest(0.5 * (target - mid), -0.5 * (target - mid)) + greatest(0.9 * (target - upper), -0.1 * (target - upper))) / 3), 4) AS pinball,
    round(avg(CAST(sign(mid) = sign(target) AS INTEGER)), 6) AS direction_accuracy FROM q GROUP BY 1""")
def interval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.interval_metrics(forecasts(spark, sf_dir), KEYS, "target", "lower", "mid", "upper")
    return rounded(rounded(df, ["coverage", "upper_miss", "lower_miss", "direction_accuracy"]), ["width", "mae_mid", "pinball"], 4)


@query(f"WITH {BARS}, {_FORECAST}, u AS (SELECT series_id, (target - lower) / nullif(upper - lower, 0) AS u FROM q WHERE target BETWEEN lower AND upper) SELECT series_id, CAST(least(floor(u * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM u GROUP BY 1, 2")
def pit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = forecasts(spark, sf_dir).where("target between lower and upper").withColumn("u", scalar.safe_divide(F.col("target") - F.col("lower"), F.col("upper") - F.col("lower")))
    return metrics.pit_histogram(u, KEYS, "u").withColumn("bin", F.col("bin").cast("long"))


@query(f"WITH {BARS}, {_FORECAST} SELECT series_id, year(date) AS year, count(*) AS n, round(avg(CAST(target BETWEEN lower AND upper AS INTEGER)), 6) AS coverage FROM q GROUP BY 1, 2")
def coverage_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.coverage_by_year(forecasts(spark, sf_dir), KEYS, TS, "target", "lower", "upper"), ["coverage"])


CLASSES = ["negative", "neutral", "positive"]
_SIGN = lambda x, d: f"CASE WHEN {x} > {d} THEN 'positive' WHEN {x} < -{d} THEN 'negative' ELSE 'neutral' END"
_THREE = f"p3 AS (SELECT series_id, date, ln(lead(close, 7) {W} / close) AS fr, ln(close / lag(close, 7) {W}) AS pr, ln(close / lag(close, 1) {W}) AS p1 FROM bars), c3 AS (SELECT series_id, date, {_SIGN('fr', 0.3)} AS truth, {_SIGN('-pr', 0.3)} AS a, {_SIGN('-p1', 0.3)} AS b FROM p3 WHERE fr IS NOT NULL AND pr IS NOT NULL)"


def three_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction in three classes, with two contrarian predictions of it."""
    w = clean.by(KEYS, TS)
    df = bars(spark, sf_dir).select("series_id", "date", windows.future_return("close", 7, w).alias("fr"), windows.log_return("close", 7, w).alias("pr"), windows.log_return("close", 1, w).alias("p1"))
    label = lambda c: F.when(c > 0.3, "positive").when(c < -0.3, "negative").otherwise("neutral")
    return df.where("fr is not null and pr is not null").select("series_id", "date", label(F.col("fr")).alias("truth"), label(-F.col("pr")).alias("a"), label(-F.col("p1")).alias("b"))


_REPORT = f"""WITH {BARS}, {_THREE}, k AS (SELECT unnest({CLASSES}) AS class), s AS (SELECT DISTINCT series_id FROM c3),
m AS (SELECT s.series_id, k.class, count(*) FILTER (WHERE truth = class AND a = class) AS tp, count(*) FILTER (WHERE a = class) AS said, count(*) FILTER (WHERE truth = class) AS support FROM s CROSS JOIN k JOIN c3 ON c3.series_id = s.series_id GROUP BY 1, 2),
rep AS (SELECT series_id, class, support, coalesce(tp / nullif(CAST(said AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(support AS DOUBLE), 0), 0) AS recall, coalesce(2.0 * tp / nullif(said + support, 0), 0) AS f1 FROM m)"""


@query(f"{_REPORT} SELECT series_id, class, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rep")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_report(metrics.confusion(three_class(spark, sf_dir), KEYS, "truth", "a"), KEYS, CLASSES), ["precision", "recall", "f1"])


@query(f"{_REPORT} SELECT r.series_id, round(avg(f1), 6) AS macro_f1, max(n) AS n, round(max(acc), 6) AS accuracy FROM rep r JOIN (SELECT series_id, count(*) AS n, avg(CAST(truth = a AS INTEGER)) AS acc FROM c3 GROUP BY 1) x USING (series_id) GROUP BY 1")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion_metrics(metrics.confusion(three_class(spark, sf_dir), KEYS, "truth", "a"), KEYS, CLASSES), ["macro_f1", "accuracy"])


@query(f"WITH {BARS}, {_THREE} SELECT series_id, truth, a AS predicted, count(*) AS n FROM c3 GROUP BY 1, 2, 3")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(three_class(spark, sf_dir), KEYS, "truth", "a")


@query(f"WITH {BARS}, {_THREE} SELECT CASE WHEN a = truth AND b = truth THEN 'both' WHEN a = truth THEN 'only_a' WHEN b = truth THEN 'only_b' ELSE 'neither' END AS outcome, count(*) AS n FROM c3 GROUP BY 1")
def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.paired_outcomes(three_class(spark, sf_dir), "truth", "a", "b")


_BINARY = f"bs AS (SELECT series_id, date, CAST(ln(lead(close, 7) {W} / close) > 0 AS INTEGER) AS y, round(0.5 - (close - {roll('close', 14, 'min')}) / nullif({roll('close', 14, 'max')} - {roll('close', 14, 'min')}, 0) * 0.4 + 0.2, 3) AS s FROM bars), bb AS (SELECT * FROM bs WHERE y IS NOT NULL AND s IS NOT NULL)"


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the close rises in a week, scored by its place in the last fortnight's channel."""
    w = clean.by(KEYS, TS)
    low, high = windows.rolling("close", 14, w, "min"), windows.rolling("close", 14, w, "max")
    s = F.round(0.5 - scalar.safe_divide(F.col("close") - low, high - low) * 0.4 + 0.2, 3)
    return bars(spark, sf_dir).select("series_id", "date", (windows.future_return("close", 7, w) > 0).cast("int").alias("y"), s.alias("s")).where("y is not null and s is not null")


_SCORES = """round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, round((coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1,
    round((coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) + coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy,
    round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc"""
_COUNTS = lambda on: f"count(*) FILTER (WHERE y = 1 AND {on}) AS tp, count(*) FILTER (WHERE y = 0 AND {on}) AS fp, count(*) FILTER (WHERE y = 1 AND NOT {on}) AS fn, count(*) FILTER (WHERE y = 0 AND NOT {on}) AS tn"


@query(f"""WITH {BARS}, {_BINARY}, c AS (SELECT series_id, {_COUNTS('(s >= 0.5)')} FROM bb GROUP BY 1),
r AS (SELECT series_id, y, rank() OVER (PARTITION BY series_id ORDER BY s) + (count(*) OVER (PARTITION BY series_id, s) - 1) / 2.0 AS r FROM bb),
u AS (SELECT series_id, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM r GROUP BY 1)
SELECT series_id, tp, fp, fn, tn, {_SCORES}, round(auc, 6) AS auc FROM c JOIN u USING (series_id)""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.evaluate_binary(binary(spark, sf_dir), KEYS, "y", "s"), ["accuracy", "macro_f1", "balanced_accuracy", "mcc", "auc"])


_GRID = f"t AS (SELECT unnest({metrics.threshold_grid()}) AS threshold), g AS (SELECT series_id, threshold, {_COUNTS('(s >= threshold)')} FROM bb CROSS JOIN t GROUP BY 1, 2)"


@query(f"WITH {BARS}, {_BINARY}, {_GRID} SELECT series_id, CAST(threshold AS DOUBLE) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, {_SCORES} FROM g")
def threshold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.threshold_scores(binary(spark, sf_dir), KEYS, "y", "s"), ["accuracy", "macro_f1", "balanced_accuracy", "mcc"])


@query(f"""WITH {BARS}, {_BINARY}, {_GRID}, m AS (SELECT series_id, CAST(threshold AS DOUBLE) AS threshold, {_SCORES} FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(macro_f1, 6) DESC, threshold) AS k FROM m)
SELECT series_id, threshold, macro_f1 FROM r WHERE k = 1""")
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_threshold(binary(spark, sf_dir), KEYS, "y", "s"), ["macro_f1"])


_LOSSES = f"ls AS (SELECT series_id, date, year(date) AS year, abs(target - mid) AS mid_loss, abs(target - actual) AS actual_loss, abs(target - naive) AS naive_loss, target NOT BETWEEN lower AND upper AS miss FROM q)"


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda c: F.abs(F.col("target") - F.col(c)).alias(f"{c}_loss")
    return forecasts(spark, sf_dir).select("series_id", "date", F.year("date").alias("year"), e("mid"), e("actual"), e("naive"), (~F.col("target").between(F.col("lower"), F.col("upper"))).alias("miss"))


@query(f"""WITH {BARS}, {_FORECAST}, {_LOSSES}, c AS (SELECT series_id, count(*) AS n, count(*) FILTER (WHERE miss) AS misses FROM ls GROUP BY 1)
SELECT series_id, n, misses, round(-2 * ((n - misses) * ln(0.8) + misses * ln(0.2) - (n - misses) * ln(1 - misses / CAST(n AS DOUBLE)) - misses * ln(misses / CAST(n AS DOUBLE))), 4) AS lr FROM c""")
def kupiec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.kupiec(losses(spark, sf_dir), KEYS, F.col("miss"), 0.2), ["lr"], 4)


@query(f"""WITH {BARS}, {_FORECAST}, {_LOSSES}, d AS (SELECT series_id, date, mid_loss - actual_loss AS d FROM ls), c AS (SELECT *, d - avg(d) OVER (PARTITION BY series_id) AS c FROM d),
l AS (SELECT *, {', '.join(f'lag(c, {k}) {W} AS c{k}' for k in range(1, 7))} FROM c)
SELECT series_id, count(*) AS n, round(avg(d), 3) AS mean_difference, round(avg(d) / sqrt((sum(c * c) + {' + '.join(f'2 * sum(c * c{k})' for k in range(1, 7))}) / count(*) / count(*)), 4) AS dm FROM l GROUP BY 1""")
def diebold_mariano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(metrics.diebold_mariano(losses(spark, sf_dir), KEYS, TS, "mid_loss", "actual_loss", 6), ["mean_difference"], 3), ["dm"], 4)


def method_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses(spark, sf_dir).unpivot(["series_id", "date", "year"], ["mid_loss", "actual_loss", "naive_loss"], "method", "loss")


_METHODS = "ml AS (" + " UNION ALL ".join(f"SELECT series_id, year, '{m}' AS method, {m} AS loss FROM ls" for m in ("mid_loss", "actual_loss", "naive_loss")) + ")"


@query(f"""WITH {BARS}, {_FORECAST}, {_LOSSES}, {_METHODS}, y AS (SELECT year, method, avg(loss) AS loss FROM ml GROUP BY 1, 2), b AS (SELECT year, loss AS base FROM y WHERE method = 'naive_loss')
SELECT year, method, round(loss, 3) AS loss, round(loss / base - 1, 6) + 0.0 AS relative_loss, loss = min(loss) OVER (PARTITION BY year) AS is_best FROM y JOIN b USING (year)""")
def relative_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method's loss against the naive one's by year, and the best of each year."""
    y = method_losses(spark, sf_dir).groupBy("year", "method").agg(F.avg("loss").alias("loss"))
    y = metrics.relative_loss(y, ["year"], "method", "loss", "naive_loss").withColumn("is_best", F.min("loss").over(Window.partitionBy("year")) == F.col("loss"))
    return y.select("year", "method", F.round("loss", 3).alias("loss"), (F.round("relative_loss", 6) + 0.0).alias("relative_loss"), "is_best")


@query(f"""WITH {BARS}, {_FORECAST}, {_LOSSES}, {_METHODS}, pp AS (SELECT method, avg(loss) FILTER (WHERE year < 1999) AS s, avg(loss) FILTER (WHERE year >= 1999) AS t FROM ml GROUP BY 1) SELECT method, round(s, 3) AS selection_loss, round(t, 3) AS test_loss FROM pp ORDER BY s, method LIMIT 1""")
def selection_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method chosen before 1999, with its loss from 1999 on."""
    df = method_losses(spark, sf_dir).withColumn("period", F.when(F.col("year") < 1999, "select").otherwise("test"))
    return rounded(metrics.choose_on(df, "period", "select", "test", "method", "loss"), ["selection_loss", "test_loss"], 3)


@query(f"""WITH {BARS}, {_FORECAST}, {_LOSSES}, s AS (SELECT year AS stage, avg(mid_loss) AS mid_loss, avg(CAST(miss AS INTEGER)) AS miss FROM (SELECT * FROM ls) GROUP BY 1)
SELECT stage, round(mid_loss, 3) AS mid_loss, round(miss, 6) AS miss, round(mid_loss - lag(mid_loss) OVER (ORDER BY stage), 3) AS mid_loss_change, round(miss - lag(miss) OVER (ORDER BY stage), 6) + 0.0 AS miss_change FROM s""")
def staged_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = losses(spark, sf_dir).select(F.col("year").alias("stage"), "mid_loss", F.col("miss").cast("double").alias("miss"))
    out = metrics.staged_change(df, "stage", ["mid_loss", "miss"])
    return rounded(rounded(out, ["mid_loss", "mid_loss_change"], 3), ["miss", "miss_change"]).withColumn("miss_change", F.col("miss_change") + 0.0)


@query(f"""WITH {BARS}, {_FORECAST}, {_LOSSES}, c AS (SELECT year, series_id, round(1 - avg(CAST(miss AS INTEGER)), 6) AS c FROM ls GROUP BY 1, 2)
SELECT year, max(c) FILTER (WHERE series_id = '1-URGENT') AS "1-URGENT", max(c) FILTER (WHERE series_id = '2-HIGH') AS "2-HIGH", max(c) FILTER (WHERE series_id = '5-LOW') AS "5-LOW" FROM c GROUP BY 1""")
def coverage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = losses(spark, sf_dir).groupBy("year").pivot("series_id", ["1-URGENT", "2-HIGH", "5-LOW"])
    return df.agg(F.round(1 - F.avg(F.col("miss").cast("double")), 6))


# -- text ------------------------------------------------------------------------------------------
@query(f"WITH {_ARTICLES} SELECT id, CASE WHEN polarity < 0 THEN 'negative' WHEN polarity > 0 THEN 'positive' WHEN polarity = 0 THEN 'neutral' END AS label, regexp_matches(text, '(?i)\\b(the|and)\\b') AS mentioned FROM u WHERE reason = 'retained'")
def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).where("reason = 'retained'").select("id", text.weak_label("polarity").alias("label"), scalar.mentions("raw_text", ["the", "and"]).alias("mentioned"))


_DAILY_TEXT = f"""WITH {_ARTICLES}, s AS (SELECT published AS date, (length(text) % 20 - 9) / 10.0 AS score FROM a WHERE published IS NOT NULL),
d AS (SELECT date, sum(CASE WHEN score > 0.7 THEN score ELSE 0 END) AS p, sum(CASE WHEN score < 0 THEN -score ELSE 0 END) AS n, count(*) AS v FROM s GROUP BY 1)
SELECT date, round(p, 4) AS positive_total, round(n, 4) AS negative_total, v AS volume, round(p - n, 4) + 0.0 AS balance, round(p / nullif(p + n, 0), 6) AS pct_positive, round(n / nullif(p + n, 0), 6) AS pct_negative, round((p - n) / v, 6) + 0.0 AS balance_per_volume FROM d"""


@query(_DAILY_TEXT)
def daily_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir).withColumn("score", (F.char_length("raw_text") % 20 - 9) / F.lit(10.0))
    df = rounded(text.daily_sentiment(a, "published_at", "score"), ["positive_total", "negative_total", "balance"], 4)
    return rounded(df, ["pct_positive", "pct_negative", "balance_per_volume"]).withColumns({c: F.col(c) + 0.0 for c in ("balance", "balance_per_volume")})


@query(_DAILY_TEXT)
def news_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily news table written in a folder for each month, and read back with its schema."""
    daily = daily_text_features(spark, sf_dir)
    path = shared_path(spark, "news")
    sources.write_table(daily.withColumn("month", F.date_format("date", "yyyy-MM")), path, ("month",))
    return spark.read.schema(daily.schema).parquet(path).select(daily.columns)


@query(f"WITH {_ARTICLES}, p AS (SELECT id, string_split(text, chr(10)) AS l FROM a), x AS (SELECT id, unnest(l) AS event, generate_subscripts(l, 1) - 1 AS k FROM p) SELECT id, CAST(k AS INTEGER) AS event_no, event FROM x")
def recap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.split_events(articles(spark, sf_dir).select("id", F.col("assessment.result.events").alias("events")), "events", "id")


RULES = [(r"!!", "negative"), (r"\*\*\*|\$\$\$", "negative"), (r"(?i)licen[sc]e", "neutral")]
_OVER = f"""{_ARTICLES}, ru AS (SELECT id, lang, CASE WHEN polarity < 0 THEN 'negative' WHEN polarity > 0 THEN 'positive' ELSE 'neutral' END AS reference, CASE WHEN length(text) % 3 = 0 THEN 'negative' WHEN length(text) % 3 = 1 THEN 'neutral' ELSE 'positive' END AS model_label,
    CASE WHEN contains(text, '!!') THEN 'negative' WHEN contains(text, '***') OR contains(text, '$$$') THEN 'negative' WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'neutral' END AS rule_label FROM a WHERE polarity IS NOT NULL),
ov AS (SELECT *, rule_label IS NOT NULL AS eligible, coalesce(rule_label, model_label) AS final_label FROM ru)"""


def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    model = F.get(F.array(*map(F.lit, CLASSES)), (F.char_length("text") % 3))
    a = a.select(F.col("doc_id").cast("string").alias("id"), "lang", "text", scalar.sign_label(F.col("quality") - F.col("toxic")).alias("reference"), model.alias("model_label"))
    return text.apply_override(a, "text", "model_label", RULES)


@query(f"""WITH {_OVER} SELECT lang, count(*) AS n, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE final_label = reference) AS correct,
    count(*) FILTER (WHERE eligible AND model_label = reference AND final_label <> reference) AS unsafe, count(*) FILTER (WHERE NOT eligible AND model_label <> reference) AS missed FROM ov GROUP BY lang""")
def override_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.override_metrics(overridden(spark, sf_dir), ["lang"], "reference", "model_label")


@query("""SELECT doc_id, length(text) AS score FROM documents""")
def score_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score computed once for each distinct text and joined back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return joins.score_once(d, "text", lambda x: x.withColumn("score", F.char_length("text").cast("long"))).select("doc_id", "score")


@query(f"""WITH {_ARTICLES}, s AS (SELECT published AS date, CASE WHEN polarity < 0 THEN 'negative' WHEN polarity > 0 THEN 'positive' ELSE 'neutral' END AS label FROM u WHERE reason = 'retained'), d AS (SELECT DISTINCT date FROM s),
r AS (SELECT date, row_number() OVER (ORDER BY date) / CAST(count(*) OVER () AS DOUBLE) AS q FROM d), p AS (SELECT CASE WHEN q <= 0.7 THEN 'train' WHEN q <= 0.85 THEN 'validation' ELSE 'test' END AS split, label FROM s JOIN r USING (date)),
c AS (SELECT split, label, count(*) AS n FROM p GROUP BY 1, 2) SELECT split, label, n, round(n / CAST(sum(n) OVER (PARTITION BY split) AS DOUBLE), 6) AS share FROM c""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audited(spark, sf_dir).where("reason = 'retained'").select(F.to_date("published_at").alias("date"), text.weak_label("polarity").alias("label"))
    return rounded(text.label_distribution(splits.date_quantile_split(a, "date"), ["split"], "label"), ["share"])


_F1 = lambda c: f"coalesce(2.0 * count(*) FILTER (WHERE gold = '{c}' AND predicted = '{c}') / nullif(count(*) FILTER (WHERE gold = '{c}') + count(*) FILTER (WHERE predicted = '{c}'), 0), 0)"
_GOLD2 = "CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN 'neutral' ELSE reference END"


@query(f"""WITH {_OVER}, g AS (SELECT id, 'v1' AS version, reference AS gold, model_label, final_label, CAST(id AS BIGINT) % 17 = 0 AS uncertain FROM ov UNION ALL SELECT id, 'v2', {_GOLD2}, model_label, final_label, CAST(id AS BIGINT) % 23 = 0 FROM ov),
m AS (SELECT version, 'model' AS model, gold, model_label AS predicted, uncertain FROM g UNION ALL SELECT version, 'override', gold, final_label, uncertain FROM g),
sz AS (SELECT version, model, count(*) FILTER (WHERE uncertain) AS n_uncertain, count(*) FILTER (WHERE NOT uncertain) AS n_certain FROM m GROUP BY 1, 2),
sc AS (SELECT version, model, round(avg(CAST(gold = predicted AS INTEGER)), 6) AS accuracy, round(({_F1('negative')} + {_F1('neutral')} + {_F1('positive')}) / 3, 6) AS macro_f1 FROM m WHERE NOT uncertain GROUP BY 1, 2)
SELECT version, model, n_uncertain, n_certain, accuracy, macro_f1 FROM sz JOIN sc USING (version, model)""")
def version_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two label sets against two gold versions: accuracy and macro F1 of the certain rows; uncertain ones are counted."""
    df, id = overridden(spark, sf_dir), F.col("id").cast("long")
    second = F.when(id % 11 == 0, "neutral").otherwise(F.col("reference"))
    gold = {"v1": (F.col("reference"), id % 17 == 0), "v2": (second, id % 23 == 0)}
    cells = [F.struct(F.lit(v).alias("version"), F.lit(m).alias("model"), g.alias("gold"), F.col(c).alias("predicted"), u.alias("uncertain")) for v, (g, u) in gold.items() for m, c in (("model", "model_label"), ("override", "final_label"))]
    rows = df.select(F.inline(F.array(*cells)))
    sizes = rows.groupBy("version", "model").agg(F.count_if("uncertain").alias("n_uncertain"), F.count_if(~F.col("uncertain")).alias("n_certain"))
    counts = metrics.confusion(rows.where("not uncertain"), ["version", "model"], "gold", "predicted")
    scores = metrics.confusion_metrics(counts, ["version", "model"], CLASSES).drop("n")
    return rounded(sizes.join(scores, ["version", "model"]), ["accuracy", "macro_f1"])
