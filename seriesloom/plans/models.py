"""Forecast and classification plans, from features to scored results."""

from __future__ import annotations

import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import classify, clean, forecast, indicators, joins, linear, metrics, splits, volatility, windows
from ..operators.calendars import calendar_features
from ..operators.fits import together
from .base import BARS, BARS_ALL, KEYS, TS, W, bars, query, raw_daily, roll, rounded, table, written
from .checks import _walk_sql, labelled, walk

Q10, Q50, Q90 = 0.1, 0.5, 0.9

#: Sizes of the boosting and stacking queries.
ROUNDS, GRID, TUNING_FOLDS, META_SIZES = 10, classify.SMALL_GRID, 2, (20, 10)


# -- bands -----------------------------------------------------------------------------------------
_BAND = "tr AS (SELECT series_id, fold, quantile_cont(target, [0.1, 0.5, 0.9]) AS q FROM wf WHERE role = 'train' GROUP BY 1, 2), bd AS (SELECT wf.*, q[1] AS lower, q[2] AS mid, q[3] AS upper FROM wf JOIN tr USING (series_id, fold) WHERE role = 'test')"
_BAND_METRICS = """count(*) AS n, round(avg(CAST(target BETWEEN lower AND upper AS INTEGER)), 6) AS coverage, round(avg(upper - lower), 6) AS width, round(avg(CAST(target > upper AS INTEGER)), 6) AS upper_miss, round(avg(CAST(target < lower AS INTEGER)), 6) AS lower_miss,
    round(avg(abs(target - mid)), 6) AS mae_mid, round(avg((greatest(0.1 * (target - lower), -0.9 * (target - lower)) + greatest(0.5 * (target - mid), -0.5 * (target - mid)) + greatest(0.9 * (target - upper), -0.1 * (target - upper))) / 3), 6) AS pinball, round(avg(CAST(sign(mid) = sign(target) AS INTEGER)), 6) AS direction_accuracy"""
_METRICS = ["coverage", "width", "upper_miss", "lower_miss", "mae_mid", "pinball", "direction_accuracy"]


@query(f"WITH {BARS}, {_walk_sql(30)}, {_BAND} SELECT series_id, fold, {_BAND_METRICS} FROM bd GROUP BY 1, 2")
def walk_forward_constant_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: daily bars on a spine, 30-day target, purged walk-forward folds, constant quantile band, scores."""
    test = forecast.constant_band(walk(spark, sf_dir, 30), KEYS, "target")
    return rounded(metrics.interval_metrics(test, ["series_id", "fold"], "target", "lower", "mid", "upper"), _METRICS)


@query(f"WITH {BARS}, {_walk_sql(30)}, {_BAND} SELECT series_id, date, fold, round(lower, 6) AS lower, round(mid, 6) AS mid, round(upper, 6) AS upper FROM bd")
def constant_quantile_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = forecast.constant_band(walk(spark, sf_dir, 30), KEYS, "target")
    return rounded(test, ["lower", "mid", "upper"]).select("series_id", "date", "fold", "lower", "mid", "upper")


_VOL = f"vo AS (SELECT series_id, date, {roll('lr', 30, 'stddev_samp')} AS sigma FROM (SELECT *, ln(close / lag(close) {W}) AS lr FROM bars))"


@query(f"""WITH {BARS}, {_walk_sql(30)}, {_VOL}, z AS (SELECT wf.*, sigma, target / nullif(sigma, 0) AS z FROM wf JOIN vo USING (series_id, date) WHERE role IS NOT NULL),
zq AS (SELECT series_id, fold, quantile_cont(z, 0.1) AS a, quantile_cont(z, 0.9) AS b FROM z WHERE role = 'train' AND z IS NOT NULL GROUP BY 1, 2), bd AS (SELECT z.*, a * sigma AS lower, 0.0 AS mid, b * sigma AS upper FROM z JOIN zq USING (series_id, fold) WHERE role = 'test')
SELECT series_id, fold, count(*) AS n, round(avg(CAST(target BETWEEN lower AND upper AS INTEGER)), 6) AS coverage, round(avg(upper - lower), 6) AS width FROM bd GROUP BY 1, 2""")
def vol_scaled_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = indicators.realised_volatility(bars(spark, sf_dir), KEYS, TS).select("series_id", "date", windows.rolling("log_return", 30, clean.by(KEYS, TS), "std").alias("sigma"))
    test = forecast.scaled_band(walk(spark, sf_dir, 30).join(sigma, ["series_id", "date"]), KEYS, "target", "sigma")
    df = metrics.interval_metrics(test, ["series_id", "fold"], "target", "lower", "mid", "upper")
    return rounded(df, ["coverage", "width"]).select("series_id", "fold", "n", "coverage", "width")


# -- feature stages and boosting -------------------------------------------------------------------
UNIVARIATE = ["lag_1", "lag_3", "lag_7", "roll_mean_7", "roll_std_7", "roll_mean_30", "roll_std_30", "dayofweek", "month", "quarter", "dayofyear"]
TECHNICAL = ["ema_8", "ema_21", "rsi_14", "bb_percent_b_20", "bb_width_20", "atr_norm_14", "volatility_30d", "drawdown_30d", "channel_pos_30d", "log_return_7d"]
MACRO = ["volume", "price_release", "spread_release"]
ONCHAIN = ["chain_transfers", "chain_quantity", "chain_quantity_change", "chain_mean_value", "chain_active_suppliers"]
CALENDAR = ["dayofweek", "month", "quarter", "dayofyear"]
STAGES = [UNIVARIATE, UNIVARIATE + TECHNICAL, UNIVARIATE + TECHNICAL + MACRO, UNIVARIATE + TECHNICAL + MACRO + ONCHAIN]


def onchain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily activity of the whole market, from shipments: the stand-in for on-chain measures."""
    day = F.to_date("l_shipdate").alias("date")
    found = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(day).agg(
        F.count("*").cast("double").alias("chain_transfers"), F.sum("l_quantity").alias("chain_quantity"), F.avg("l_extendedprice").alias("chain_mean_value"), F.approx_count_distinct("l_suppkey").cast("double").alias("chain_active_suppliers")
    )
    return found.withColumn("chain_quantity_change", windows.percent_change("chain_quantity", Window.orderBy("date"), 7))  # a row for each day


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages' features in one table: univariate, technical, volume and lagged monthly releases, activity."""
    w = clean.by(KEYS, TS)
    df = calendar_features(bars(spark, sf_dir), "date")
    df = df.withColumns({f"lag_{n}": windows.lag("close", n, w) for n in (1, 3, 7)} | {f"roll_{h}_{n}": windows.rolling("close", n, w, h) for h in ("mean", "std") for n in (7, 30)})
    df = indicators.returns_and_range(df, KEYS, TS, (7, 30))
    df = indicators.ema_features(df, KEYS, TS, (8, 21))
    df = indicators.bollinger(indicators.rsi(df, KEYS, TS, (14,)), KEYS, TS, (20,))
    df = indicators.atr(df, KEYS, TS, (14,))
    low = raw_daily(spark, sf_dir).groupBy("series_id", F.trunc("date", "MM").alias("date")).agg(F.avg("close").alias("price_release"), F.avg(F.col("high") - F.col("low")).alias("spread_release"))
    df = joins.release_lagged(df, low, KEYS, TS, {"price_release": 75, "spread_release": 45})
    df = df.join(onchain(spark, sf_dir), "date", "left")
    return df.withColumn("target", windows.future_return("close", 30, w))


@query()
def staged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept features of each stage after correlation pruning on the first 60 % of rows; stage 1 is not pruned."""
    df = written(feature_table(spark, sf_dir), "features")
    train = written(splits.purged_split(df, KEYS, TS, horizon=30).where("split = 'train'"), "train")
    rows = []
    for i, wanted in enumerate(STAGES):
        names = clean.present(df, [*wanted, "not_a_column"])
        kept = names if i == 0 else splits.prune(train, names, 0.95)
        rows += [(i + 1, k, n) for k, n in enumerate(kept)]
    return spark.createDataFrame(rows, "stage int, place int, feature string")


def model_folds(spark: SparkSession, sf_dir: str, columns: list[str], folds: int = 3) -> DataFrame:
    ready = clean.complete(feature_table(spark, sf_dir), [*columns, "target"])
    return written(splits.walk_forward(ready, KEYS, TS, folds, 30), "folds")


@query()
def gbt_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees in purged walk-forward folds over all series, on calendar features alone and on all of stage 2:
    errors by fold.

    The last tenth of a fold's training days ends the rounds early.
    """
    folds = model_folds(spark, sf_dir, STAGES[1])
    last = folds.where("role = 'train'").groupBy("fold").agg(F.date_sub(F.max("date"), (F.datediff(F.max("date"), F.min("date")) / 10).cast("int")).alias("late"))
    folds = written(folds.join(F.broadcast(last), "fold"), "folds")  # a row for each fold
    made = [forecast.boosted_points(folds, c, "target", rounds=ROUNDS, depth=4, stop=F.col("date") > F.col("late")).withColumn("features", F.lit(n)) for n, c in (("calendar", CALENDAR), ("stage 2", STAGES[1]))]
    return metrics.point_metrics(joins.stack(made), ["features", "fold"], "target", "prediction")


@query()
def pinball_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile boosting for each fold's band: size-dependent leaves and penalties, a cosine learning rate, four
    fifths of rows and columns a round.  Folds and quantiles are boosted together.
    """
    every = model_folds(spark, sf_dir, STAGES[1])
    sizes = {r["fold"]: r["n"] for r in every.where("role = 'train'").groupBy("fold").agg(F.count("*").alias("n")).collect()}  # a row for each fold

    def band(fold, n: int, name: str, q: float) -> DataFrame:
        leaf, cut, shrink = forecast.adaptive_settings(n)
        got = forecast.pinball_boosting(
            every.where(F.col("fold") == fold), STAGES[1], "target", q, F.col("role") == "train", ROUNDS, 3, lambda i: rate * forecast.cosine_rate(i, ROUNDS), int(leaf), shrink, cut, 0.8, 0.8
        )
        return written(got.select("fold", "series_id", "date", "role", "target", F.lit(name).alias("side"), "prediction"), "quantile")

    rate = 3 if ROUNDS < 20 else 1  # few rounds take longer steps
    made = together(spark, [partial(band, fold, n, name, q) for fold, n in sorted(sizes.items()) for name, q in (("lower", Q10), ("mid", Q50), ("upper", Q90))])
    wide = joins.stack(made).groupBy("fold", "series_id", "date", "role", "target").pivot("side", ["lower", "mid", "upper"]).agg(F.first("prediction"))
    wide = wide.withColumns({"lower": F.least("lower", "mid", "upper"), "upper": F.greatest("lower", "mid", "upper")})
    return metrics.interval_metrics(wide, ["fold", "role"], "target", "lower", "mid", "upper")


# -- direction classification ----------------------------------------------------------------------
@query()
def stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base learners, their average and stacked meta-learners: thresholds from validation, scores on test.

    Tuned over GRID on purged folds, each scaled by its own training rows; the operators' default is FULL_GRID.
    """
    df = feature_table(spark, sf_dir).drop("target")
    label = labelled(spark, sf_dir).select("series_id", "date", F.col("label").alias("y"))
    ready = clean.complete(df.join(label, ["series_id", "date"]), [*STAGES[1], "y"]).withColumn("y", F.col("y").cast("double"))
    parts = splits.purged_split(ready, KEYS, TS).where("split is not null").drop("rn", "n")
    coded = classify.scaled(classify.with_class_weights(parts, "y", F.col("split") == "train"), STAGES[1], F.col("split") == "train")
    coded = written(coded.select("series_id", "date", "split", "y", "weight", "raw", "features"), "direction")
    folds = written(splits.purged_folds(coded.where("split = 'train'"), KEYS, TS, TUNING_FOLDS), "tuning")
    scores, fitted = classify.base_predictions(coded, folds, ["series_id", "date"], GRID)
    models = list(fitted)
    wide = written(classify.wide_scores(scores, ["series_id", "date"], models), "wide")
    meta_folds = splits.purged_folds(wide.where("split = 'validation'"), KEYS, TS, TUNING_FOLDS)
    meta = classify.stack_predictions(wide, ["series_id", "date"], models, meta_folds, *META_SIZES)
    average = wide.select("series_id", "date", "y", F.when(F.col("split") == "test", "test").otherwise("oof").alias("split"), F.lit("average").alias("model"), F.col("average").alias("score"))
    base = scores.select("series_id", "date", "y", F.when(F.col("split") == "test", "test").otherwise("oof").alias("split"), "model", "score")
    every = written(joins.stack([base, average, meta.select("series_id", "date", "y", "split", "model", "score")]), "scores")
    chosen = metrics.best_threshold(every.where("split = 'oof'"), ["model"], "y", "score").withColumnRenamed("macro_f1", "oof_macro_f1")
    test = every.where("split = 'test'").join(F.broadcast(chosen), "model")  # a row for each model
    counts = metrics.binary_scores(metrics.binary_counts(test, ["model", "threshold", "oof_macro_f1"], "y", F.col("score") >= F.col("threshold")))
    return counts.join(metrics.auc(test, ["model"], "y", "score"), "model").orderBy(F.desc("macro_f1"), "model")


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 largest importances of each learner, fitted to the training part."""
    df = feature_table(spark, sf_dir)
    ready = clean.complete(df, [*STAGES[1], "target"]).withColumn("y", (F.col("target") > 0).cast("double"))
    train = splits.purged_split(ready, KEYS, TS, horizon=30).where("split = 'train'")
    coded = written(classify.scaled(classify.with_class_weights(train, "y", F.lit(True)), STAGES[1], F.lit(True)).select("y", "weight", "features"), "importance")
    sets = classify.learners(GRID, coded.count())
    fitted = dict(zip(sets, together(spark, [partial(c[0].fit, coded) for c in sets.values()]), strict=True))
    w = Window.partitionBy("model").orderBy(F.desc(F.abs("importance")), "feature")
    return classify.importances(fitted, STAGES[1], spark).withColumn("rank", F.row_number().over(w)).where("rank <= 15")


@query(f"""WITH {BARS}, s AS (SELECT series_id, date, close, date <= DATE '2000-01-01' AS train FROM bars), e AS (SELECT min(close) AS a, max(close) AS b FROM s WHERE train)
SELECT series_id, date, round((close - a) / (b - a), 6) AS close_scaled, round(close, 2) AS restored FROM s CROSS JOIN e""")
def minmax_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled by the training part's extremes, and back."""
    df = classify.minmax(bars(spark, sf_dir).select("series_id", "date", "close"), ["close"], F.col("date") <= "2000-01-01")
    return df.select("series_id", "date", F.round("close_scaled", 6).alias("close_scaled"), F.round(classify.minmax_inverse(df, "close_scaled", "close"), 2).alias("restored"))


@query("""SELECT lang, round(avg(quality), 6) AS positive_rate, round((1 - avg(quality)) / nullif(avg(quality), 0), 6) AS positive_weight FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return rounded(classify.positive_rate(d, ["lang"], "quality"), ["positive_rate", "positive_weight"])


# -- seasonal models -------------------------------------------------------------------------------
_MONTHS = "m AS (SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS date, round(sum(close), 2) AS v FROM bars GROUP BY 1, 2)"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("series_id", F.trunc("date", "MM").alias("date")).agg(F.round(F.sum("close"), 2).alias("v"))


_FRAME = lambda a, b: f"CASE WHEN count(v) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) = 12 THEN avg(v) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) END"


@query(f"""WITH {BARS}, {_MONTHS}, t AS (SELECT *, ({_FRAME(6, 5)} + {_FRAME(5, 6)}) / 2 AS trend FROM m), s AS (SELECT series_id, month(date) AS k, avg(v - trend) AS mean FROM t GROUP BY 1, 2),
c AS (SELECT series_id, k, mean - avg(mean) OVER (PARTITION BY series_id) AS seasonal FROM s)
SELECT t.series_id, date, round(v, 2) AS v, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(v - trend - seasonal, 3) AS residual FROM t JOIN c ON c.series_id = t.series_id AND c.k = month(date)""")
def decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = forecast.decompose(monthly(spark, sf_dir), KEYS, TS, "v", F.month("date"))
    return rounded(rounded(df, ["v"], 2), ["trend", "seasonal", "residual"], 3)


_ACF = f"""r AS (SELECT series_id, date, v - avg(v) OVER (PARTITION BY series_id) AS x, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn FROM m),
p AS (SELECT a.series_id, b.rn - a.rn AS lag, sum(a.x * b.x) AS p FROM r a JOIN r b ON a.series_id = b.series_id AND b.rn - a.rn BETWEEN 0 AND 50 GROUP BY 1, 2)"""


@query(f"WITH {BARS}, {_MONTHS}, {_ACF} SELECT series_id, CAST(lag AS INTEGER) AS lag, round(p / max(p) FILTER (WHERE lag = 0) OVER (PARTITION BY series_id), 6) + 0.0 AS acf FROM p WHERE lag <= 40")
def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rounded(joins.autocorrelation(monthly(spark, sf_dir), KEYS, TS, "v", 40), ["acf"])
    return df.select("series_id", F.col("lag").cast("int").alias("lag"), (F.col("acf") + 0.0).alias("acf"))


@query(f"""WITH RECURSIVE {BARS}, {_MONTHS}, {_ACF}, a AS (SELECT series_id, lag, p / max(p) FILTER (WHERE lag = 0) OVER (PARTITION BY series_id) AS r FROM p), l AS (SELECT series_id, list(r ORDER BY lag) FILTER (WHERE lag > 0) AS r FROM a GROUP BY 1),
f AS (SELECT series_id, 1 AS k, [r[1]] AS phi, r FROM l
    UNION ALL SELECT series_id, k + 1, list_append(list_transform(phi, lambda x, i: x - last * phi[k - i + 1]), last), r FROM (SELECT *, (r[k + 1] - list_dot_product(phi, list_reverse(r[1:k]))) / (1 - list_dot_product(phi, r[1:k])) AS last FROM f WHERE k < 50))
SELECT series_id, CAST(k AS INTEGER) AS lag, round(phi[k], 5) + 0.0 AS pacf FROM f UNION ALL SELECT series_id, 0, 1.0 FROM l""")
def pacf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial autocorrelations of monthly sums to lag 50."""
    found = joins.autocorrelation(monthly(spark, sf_dir), KEYS, TS, "v", 50)
    df = forecast.partial_autocorrelation(found.withColumn("lag", F.col("lag").cast("int")), KEYS)
    return df.withColumn("pacf", F.round("pacf", 5) + 0.0)


@query(f"""WITH {BARS}, d AS (SELECT series_id, date, lag(close) {W} AS x, close - lag(close) {W} AS y FROM bars), s AS (SELECT series_id, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS xx, regr_syy(y, x) AS yy, regr_sxy(y, x) AS xy FROM d WHERE x IS NOT NULL GROUP BY 1)
SELECT series_id, n, round(b, 6) AS slope, round(b / sqrt((yy - b * xy) / (n - 2) / xx), 4) AS t, b / sqrt((yy - b * xy) / (n - 2) / xx) < -2.86 AS stationary FROM s""")
def dickey_fuller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(forecast.dickey_fuller(bars(spark, sf_dir), KEYS, TS, "close"), ["slope"]), ["t"], 4)


@query()
def augmented_dickey_fuller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-root test of each series' closes, with the lags of least AIC and the p-value."""
    return linear.augmented_dickey_fuller(bars(spark, sf_dir), KEYS, TS, "close")


@query()
def seasonal_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend, year and week terms of each series, scored within the training years and after them."""
    df = written(bars(spark, sf_dir), "market").withColumn("part", F.when(F.col("date") <= "2000-01-01", "train").otherwise("test"))
    fitted = linear.seasonal_regression(df, KEYS, TS, "close", F.col("part") == "train")
    return metrics.point_metrics(fitted, ["series_id", "part"], "close", "prediction")


@query()
def hourly_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event values of each event type by trend, week and day, scored on the last tenth of the time."""
    events = table(spark, sf_dir, "events")
    hours = events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias("v"))
    hours = written(hours, "hours")
    low, high = hours.agg(F.min(F.unix_seconds("hour")), F.max(F.unix_seconds("hour"))).collect()[0]
    df = hours.withColumn("part", F.when(F.unix_seconds("hour") <= low + 0.9 * (high - low), "train").otherwise("test"))
    fitted = linear.seasonal_regression(df, KEYS, "hour", "v", F.col("part") == "train", yearly=0, weekly=3, daily=4)
    return metrics.point_metrics(fitted, ["series_id", "part"], "v", "prediction")


@query()
def arma_order_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AIC of 54 seasonal autoregressions with moving averages of monthly sums, ranked for each series."""
    return linear.arma_order_search(monthly(spark, sf_dir), KEYS, TS, "v").drop("coefficients")


@query()
def ar_order_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.ar_order_search(monthly(spark, sf_dir), KEYS, TS, "v").drop("coefficients")


@query()
def ar_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step forecasts within the sample (step 0), then 200 months beyond it."""
    m = written(monthly(spark, sf_dir), "monthly")
    best = written(forecast.ar_order_search(m, KEYS, TS, "v"), "orders")
    ahead = forecast.ar_forecast(m, best, KEYS, TS, "v", 200)
    return joins.stack([forecast.ar_fitted(m, best, KEYS, TS, "v").withColumn("step", F.lit(0)), ahead])


# -- volatility ------------------------------------------------------------------------------------
def market(spark: SparkSession, sf_dir: str, series=None) -> DataFrame:
    """Weekly-smoothed closes: daily log returns of the 7-day mean price."""
    w = clean.by(KEYS, TS)
    b = bars(spark, sf_dir, series).withColumn("close", windows.rolling("close", 7, w, "mean"))
    return b.withColumn("r", windows.log_return("close", 1, w)).where("r is not null").select("series_id", "date", "close", "r")


_GRID = [(a, b) for a, b in forecast.GRID]


def _likelihood_sql(i: int) -> str:
    """Likelihoods of the candidates g<i> of each series, and the best of them, k<i>."""
    return f"""s{i} AS (SELECT ce.series_id, rn, alpha, beta, v, v AS s2, e FROM ce JOIN va USING (series_id) JOIN g{i} USING (series_id) WHERE rn = 1
    UNION ALL SELECT s{i}.series_id, ce.rn, alpha, beta, v, (1 - alpha - beta) * v + alpha * s{i}.e * s{i}.e + beta * s2, ce.e FROM s{i} JOIN ce ON ce.series_id = s{i}.series_id AND ce.rn = s{i}.rn + 1),
l{i} AS (SELECT series_id, alpha, beta, count(*) AS n, sum(-0.5 * (ln(s2) + e * e / s2)) AS ll, arg_max(s2, rn) AS last, max(v) AS v FROM s{i} GROUP BY 1, 2, 3),
k{i} AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(ll, 6) DESC, alpha, beta) AS k FROM l{i})"""


def _refined_sql() -> str:
    parts = []
    for i, (steps, gaps) in enumerate(volatility.ROUNDS, 1):
        parts.append(f"""g{i} AS (SELECT DISTINCT * FROM (SELECT series_id, alpha * f AS alpha, least(1 - (1 - (alpha + beta)) * g, {volatility.MOST_PERSISTENT}::DOUBLE) - alpha * f AS beta FROM k{i - 1},
    (SELECT unnest({list(steps)}::DOUBLE[]) AS f), (SELECT unnest({list(gaps)}::DOUBLE[]) AS g) WHERE k = 1) WHERE beta >= 0), {_likelihood_sql(i)}""")
    return ", ".join(parts) + f", k AS (SELECT * FROM k{len(volatility.ROUNDS)})"


_GARCH = f"""sm AS (SELECT series_id, date, {roll('close', 7, 'avg')} AS close FROM bars), rr AS (SELECT series_id, date, ln(close / lag(close) {W}) AS r FROM sm),
ce AS (SELECT series_id, date, r - avg(r) OVER (PARTITION BY series_id) AS e, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn FROM rr WHERE r IS NOT NULL), va AS (SELECT series_id, avg(e * e) AS v FROM ce GROUP BY 1),
g0 AS (SELECT series_id, alpha, beta FROM va, (SELECT unnest({[a for a, _ in _GRID]}::DOUBLE[]) AS alpha, unnest({[b for _, b in _GRID]}::DOUBLE[]) AS beta)), {_likelihood_sql(0)}, {_refined_sql()}"""


@query(f"""WITH RECURSIVE {BARS}, {_GARCH}
SELECT series_id, alpha, beta, round(alpha + beta, 6) AS persistence, n, round(ll, 3) AS log_likelihood, round(sqrt(last), 6) AS last_sigma, round(sqrt(v), 6) AS long_run_sigma FROM k WHERE k = 1""")
def garch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = forecast.garch_grid(market(spark, sf_dir), KEYS, TS, "r").drop("last_residual")
    return rounded(rounded(df, ["log_likelihood"], 3), ["persistence", "last_sigma", "long_run_sigma"])


def implied(returns: DataFrame) -> DataFrame:
    """A stand-in for quoted volatility: the last quarter's deviation, a fifth higher, on working days since 1998."""
    v = windows.rolling("r", 90, clean.by(KEYS, TS), "std") * 365**0.5 * 120
    return returns.withColumn("dvol", v).where("dvol is not null and weekday(date) < 5 and date >= '1998-01-01'").select("series_id", "date", "dvol")


def volatility_inputs(spark: SparkSession, sf_dir: str, series=None) -> tuple[DataFrame, DataFrame]:
    returns = written(market(spark, sf_dir, series), "returns")
    quoted = written(joins.asof(returns.select("series_id", "date"), implied(returns), KEYS, TS, ["dvol"]), "implied")
    fit = written(forecast.start_sigma(forecast.garch_grid(returns, KEYS, TS, "r"), returns, quoted, KEYS, TS, "r", "dvol"), "fit")
    return returns, fit


_AHEAD = "OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)"
_FIT = f"""WITH RECURSIVE {BARS}, {_GARCH},
fit AS (SELECT series_id, alpha, beta, n, ll, sqrt(last) AS last_sigma, sqrt(v) AS long_run_sigma FROM k WHERE k = 1),
qu AS (SELECT series_id, date, CASE WHEN isodow(date) <= 5 AND date >= DATE '1998-01-01' AND count(r) OVER q = 90 THEN stddev_samp(r) OVER q * sqrt(365) * 120 END AS dvol FROM rr WHERE r IS NOT NULL
    WINDOW q AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)),
iv AS (SELECT series_id, date, last_value(dvol IGNORE NULLS) {W} / 100 / sqrt(365) AS iv FROM qu),
re AS (SELECT series_id, date, iv, CASE WHEN count(r) {_AHEAD} = 30 THEN stddev_samp(r) {_AHEAD} END AS rea FROM iv JOIN (SELECT * FROM rr WHERE r IS NOT NULL) USING (series_id, date)),
sv AS (SELECT series_id, median(rea / nullif(iv, 0)) AS vrp, count(*) FILTER (WHERE rea IS NOT NULL AND iv IS NOT NULL) AS m, arg_max(iv, date) FILTER (WHERE iv IS NOT NULL) AS implied_sigma FROM re GROUP BY 1),
st AS (SELECT fit.*, vrp, implied_sigma, coalesce(CASE WHEN m >= 60 THEN vrp * implied_sigma END, last_sigma) AS start_sigma FROM fit LEFT JOIN sv USING (series_id))"""


@query(f"""{_FIT} SELECT series_id, alpha, beta, round(alpha + beta, 6) AS persistence, n, round(ll, 3) AS log_likelihood, round(last_sigma, 6) AS last_sigma, round(long_run_sigma, 6) AS long_run_sigma,
    round(vrp, 6) AS vrp, round(implied_sigma, 6) AS implied_sigma, round(start_sigma, 6) AS start_sigma FROM st""")
def start_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implied volatility as of each day, the median premium and the start volatility."""
    _, fit = volatility_inputs(spark, sf_dir)
    df = rounded(fit.drop("last_residual"), ["log_likelihood"], 3)
    return rounded(df, ["persistence", "last_sigma", "long_run_sigma", "vrp", "implied_sigma", "start_sigma"])


PATHS, STEPS, SEED, CALIBRATION = 10_000, 30, 7, 1.1


def simulated(spark: SparkSession, sf_dir: str, at_steps: list[int] | None = None, methods: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    returns, fit = volatility_inputs(spark, sf_dir)
    spot = returns.groupBy("series_id").agg(F.max_by("close", "date").alias("spot"), F.max("date").alias("as_of"))
    pool = forecast.residual_pool(returns, fit, KEYS, TS, "r")
    return written(forecast.bootstrap_paths(fit.withColumn("calibration", F.lit(CALIBRATION)), pool, KEYS, STEPS, PATHS, SEED, None, methods, at_steps), "paths"), spot


_DRAW = lambda *more: f"('0x' || substr(md5(concat_ws('|', '{SEED}', series_id{''.join(f', {m}' for m in more)})), 1, 13))::BIGINT"
_UNIT = lambda salt: f"(({_DRAW('path', 'step', str(salt))} + 1) / {float(forecast.DRAW_RANGE + 1)!r}::DOUBLE)"
_PATHS = f"""{_FIT},
es AS (SELECT series_id, ce.rn, e, alpha, beta, v FROM ce JOIN k USING (series_id) WHERE k.k = 1),
z1 AS (SELECT series_id, rn, e, alpha, beta, v, v AS s2 FROM es WHERE rn = 1
    UNION ALL SELECT z1.series_id, es.rn, es.e, es.alpha, es.beta, es.v, (1 - es.alpha - es.beta) * es.v + es.alpha * z1.e * z1.e + es.beta * s2 FROM z1 JOIN es ON es.series_id = z1.series_id AND es.rn = z1.rn + 1),
po AS (SELECT series_id, rn - 1 AS place, e / sqrt(s2) AS z, e FROM z1), sz AS (SELECT series_id, count(*) AS size FROM po GROUP BY 1),
dr AS (SELECT series_id, path, step, {_DRAW('path', 'step')} % size AS place, sqrt(-2 * ln({_UNIT(1)})) * cos(2 * pi() * {_UNIT(2)}) AS normal
    FROM sz CROSS JOIN (SELECT unnest(range(1, {PATHS + 1})) AS path) CROSS JOIN (SELECT unnest(range(1, {STEPS + 1})) AS step)),
dw AS (SELECT dr.series_id, path, step, z, e, normal FROM dr JOIN po ON po.series_id = dr.series_id AND po.place = dr.place),
wk AS (SELECT series_id, method, 0 AS path, 0 AS step, 0.0::DOUBLE AS x, 0.0::DOUBLE AS v, 0.0::DOUBLE AS alpha, 0.0::DOUBLE AS beta, 0.0::DOUBLE AS lv FROM st CROSS JOIN (SELECT unnest({forecast.METHODS}) AS method) WHERE false
    UNION ALL SELECT * FROM (SELECT series_id, method, path, 0 AS step, 0.0::DOUBLE AS x, CASE method WHEN 'fhs_dvol' THEN start_sigma * start_sigma WHEN 'fhs_cal' THEN last_sigma * {CALIBRATION}::DOUBLE * (last_sigma * {CALIBRATION}::DOUBLE) ELSE last_sigma * last_sigma END AS v, alpha, beta, long_run_sigma * long_run_sigma AS lv
        FROM st CROSS JOIN (SELECT unnest({forecast.METHODS}) AS method) CROSS JOIN (SELECT unnest(range(1, {PATHS + 1})) AS path))),
pa AS (SELECT * FROM wk UNION ALL
    SELECT series_id, method, path, step, x + ee, (1 - alpha - beta) * lv + alpha * ee * ee + beta * v, alpha, beta, lv FROM (
        SELECT pa.series_id, method, pa.path, dw.step, x, v, alpha, beta, lv, CASE method WHEN 'iid' THEN e WHEN 'garch_normal' THEN normal * sqrt(v) ELSE z * sqrt(v) END AS ee
        FROM pa JOIN dw ON dw.series_id = pa.series_id AND dw.path = pa.path AND dw.step = pa.step + 1)),
sp AS (SELECT series_id, arg_max(close, date) AS spot, max(date) AS as_of FROM (SELECT sm.series_id, sm.date, sm.close FROM sm JOIN rr ON rr.series_id = sm.series_id AND rr.date = sm.date WHERE r IS NOT NULL) GROUP BY 1)"""


@query(f"""{_PATHS}, qt AS (SELECT series_id, method, step, quantile_cont(spot * exp(x), [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS q, max(spot) AS spot, max(as_of) AS as_of FROM pa JOIN sp USING (series_id) WHERE step IN (1, 7, 14, 21, 30) GROUP BY 1, 2, 3)
SELECT series_id, method, step, CAST(as_of + step AS DATE) AS date, round(spot, 3) AS spot, {', '.join(f'round(q[{i + 1}], 3) AS {p}' for i, p in enumerate(['p5', 'p10', 'p25', 'p50', 'p75', 'p90', 'p95']))},
    {', '.join(f'round(100 * (q[{i}] / spot - 1), 4) AS {p}_pct' for i, p in ((1, 'p5'), (4, 'p50'), (7, 'p95')))} FROM qt""")
def bootstrap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of each method at days 1, 7, 14, 21 and 30, in prices and as changes from the spot; 10 000 paths."""
    paths, spot = simulated(spark, sf_dir, [1, 7, 14, 21, 30])
    near = paths.join(spot, KEYS)
    found = forecast.bands(near, ["series_id", "spot", "as_of"], F.col("spot")).withColumn("date", F.date_add("as_of", F.col("step"))).drop("as_of")
    found = found.withColumns({f"{p}_pct": F.round(100 * (F.col(p) / F.col("spot") - 1), 4) for p in ("p5", "p50", "p95")})
    return rounded(found, ["spot", "p5", "p10", "p25", "p50", "p75", "p90", "p95"], 3)


@query(f"""{_PATHS}, lv AS (SELECT unnest([-0.2, -0.1, 0.0, 0.1, 0.2])::DOUBLE AS change)
SELECT series_id, method, change, round(avg(CAST(exp(x) >= 1 + change AS INTEGER)), 6) AS prob_above FROM pa CROSS JOIN lv WHERE step = {STEPS} GROUP BY 1, 2, 3""")
def exceedance_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of 10 000 paths that end at or above each level, by method."""
    return rounded(forecast.exceedance(simulated(spark, sf_dir, [STEPS])[0], KEYS, step=STEPS), ["prob_above"])


@query(f"""{_PATHS}, en AS (SELECT series_id, path, round(x, 9) AS x, percent_rank() OVER (PARTITION BY series_id ORDER BY round(x, 9), path) AS u FROM pa WHERE method = 'fhs' AND step = {STEPS}),
gr2 AS (SELECT *, CAST(floor((u - 0.05) / (0.95 - 0.05) * 23 + 0.5) AS INTEGER) AS g FROM en), ch AS (SELECT *, row_number() OVER (PARTITION BY series_id, g ORDER BY round(abs(u - (0.05 + g * (0.95 - 0.05) / 23)), 9), path) AS kk FROM gr2 WHERE g BETWEEN 0 AND 23)
SELECT pa.series_id, pa.method, pa.path, step, round(pa.x, 6) AS log_change FROM pa JOIN ch ON ch.series_id = pa.series_id AND ch.path = pa.path AND ch.kk = 1 WHERE pa.method = 'fhs' AND step > 0""")
def sampled_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 whole paths of 10 000, spread evenly by where they end."""
    paths, _ = simulated(spark, sf_dir, methods=["fhs"])
    return rounded(forecast.sample_paths(paths, KEYS), ["log_change"])


@query(f"""{_FIT}, kn AS (SELECT series_id, date, iv, rea / nullif(iv, 0) AS ratio, lead(date, 30) {W} AS known_at FROM re),
pr AS (SELECT a.series_id, a.date, any_value(a.iv) AS iv, count(b.ratio) AS n, median(b.ratio) AS m FROM kn a LEFT JOIN kn b ON b.series_id = a.series_id AND b.known_at <= a.date AND b.ratio IS NOT NULL GROUP BY 1, 2)
SELECT series_id, date, round(iv, 6) AS implied_sigma, n AS ratios, round(CASE WHEN n >= 60 THEN m END, 6) AS vrp FROM pr""")
def expanding_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implied volatility of each day, and the median of realised over implied among windows that ended by then."""
    returns = written(market(spark, sf_dir), "returns")
    quoted = written(joins.asof(returns.select("series_id", "date"), implied(returns), KEYS, TS, ["dvol"]), "implied")
    return rounded(forecast.expanding_premium(returns, quoted, KEYS, TS, "r", "dvol"), ["implied_sigma", "vrp"])


LEVELS, HORIZONS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95], [7, 14, 30]


def backtest_origins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(origins, pool, actuals) of the backtest: weekly origins of each series from its third year on.

    Parameters are refitted each year on the returns before it; an origin's volatility is filtered from returns up to
    it, and its start value is the day's implied volatility times the premium known by then.
    """
    returns = written(market(spark, sf_dir), "returns")
    years = sorted(r["y"] for r in returns.select(F.year("date").alias("y")).distinct().collect())[2:]
    fit = written(volatility.fit(returns, KEYS, TS, "r", [datetime.date(y, 1, 1) for y in years]), "fit")
    pool = written(volatility.residual_pool(returns, fit, KEYS, TS, "r"), "pool")
    sigma = volatility.filtered(returns, fit, KEYS, TS, "r").where("not seen and year(cut) = year(date)").select("series_id", "cut", "date", "sigma")
    quoted = written(joins.asof(returns.select("series_id", "date"), implied(returns), KEYS, TS, ["dvol"]), "implied")
    premium = forecast.expanding_premium(returns, quoted, KEYS, TS, "r", "dvol")
    w = clean.by(KEYS, TS)
    ahead = returns.withColumns({f"actual_{h}": windows.future_return("close", h, w) for h in HORIZONS}).where(f"weekday(date) = 0 and actual_{HORIZONS[-1]} is not null")
    held = ahead.join(sigma, [*KEYS, TS]).join(fit.select("series_id", "cut", "alpha", "beta", "long_run_sigma"), ["series_id", "cut"]).join(premium, [*KEYS, TS])
    held = held.withColumns({"last_sigma": F.col("sigma"), "start_sigma": F.coalesce(F.col("implied_sigma") * F.col("vrp"), F.col("sigma")), "calibration": F.lit(CALIBRATION)})
    origins = written(held.select("series_id", "date", "cut", *forecast.STARTS, *[f"actual_{h}" for h in HORIZONS]), "origins")
    return origins, pool, origins.select("series_id", "date", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"actual_{h}").alias("actual")) for h in HORIZONS])).alias("a")).select("series_id", "date", "a.*")


@query()
def band_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly origins of every series, three horizons, all methods on the same dates: coverage, pinball, misses, tests.

    1 000 paths from each origin draw from all residuals before its year.
    """
    origins, pool, actual = backtest_origins(spark, sf_dir)
    q = forecast.bootstrap_quantiles(origins, pool, ["series_id", "date"], LEVELS, HORIZONS, 1000, SEED, ["series_id", "cut"]).withColumnRenamed("step", "h")
    scored = written(q.join(actual, ["series_id", "date", "h"]).withColumns({"lower": F.col("q")[1], "mid": F.col("q")[3], "upper": F.col("q")[5], "c50": F.col("actual").between(F.col("q")[2], F.col("q")[4]).cast("double"), "c90": F.col("actual").between(F.col("q")[0], F.col("q")[6]).cast("double")}), "backtest")
    base = metrics.interval_metrics(scored, ["h", "method"], "actual", "lower", "mid", "upper")
    more = scored.groupBy("h", "method").agg(F.avg("c50").alias("coverage_50"), F.avg("c90").alias("coverage_90"), (F.floor(F.datediff(F.max("date"), F.min("date")) / F.col("h"))).alias("independent"))
    tested = metrics.kupiec(scored, ["h", "method"], ~F.col("actual").between(F.col("lower"), F.col("upper")), 0.2).select("h", "method", "lr")
    out = base.join(more, ["h", "method"]).join(tested, ["h", "method"])
    out = metrics.relative_loss(out, ["h"], "method", "pinball", "fhs")
    return out.withColumn("is_best", F.min("pinball").over(Window.partitionBy("h")) == F.col("pinball"))


# -- text baseline ---------------------------------------------------------------------------------
@query("""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS ws FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM w), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
v AS (SELECT term, df, row_number() OVER (ORDER BY encode(term)) - 1 AS id FROM (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2)), n AS (SELECT count(*) AS n FROM w)
SELECT doc_id, term, id, round(tf * ln((n + 1)::DOUBLE / (df + 1)::DOUBLE), 6) AS weight FROM c JOIN v USING (term), n""")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each word and word pair of each document, with the term's dense id in an exact vocabulary."""
    from ..operators import text

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    counts = text.term_counts(docs, ["doc_id"], "text")  # counted anew by each reader: smaller than its rows on disk
    return rounded(text.tfidf(counts, text.vocabulary(counts), docs.count()), ["weight"])


@query()
def tfidf_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF and balanced logistic regression on weak labels, split by date, scored by part."""
    from ..operators import text
    from .checks import audited

    a = audited(spark, sf_dir).where("reason = 'retained'").select("id", F.to_date("published_at").alias("date"), F.col("raw_text").alias("text"), text.weak_label("polarity").alias("label"))
    parts = splits.date_quantile_split(written(a, "retained"), "date")  # which reads them twice
    found, strength = text.tfidf_logistic(parts, "text", "label", "split")
    counts = metrics.confusion(found, ["split"], "label", "predicted")
    return metrics.confusion_metrics(counts, ["split"], ["negative", "neutral", "positive"]).withColumn("chosen_c", F.lit(strength))


