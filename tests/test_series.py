"""Operators against pandas and hand-made frames."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.functions import scalar
from seriesloom.operators import calendars, classify, clean, forecast, indicators, joins, linear, metrics, quality, quantiles, scan, splits, volatility, windows
from seriesloom.storage import written

KEYS, TS = ["series_id"], "date"


def frame(spark, values, start=dt.date(2020, 1, 1), series="a", name="v"):
    rows = [(series, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"series_id string, date date, {name} double").repartition(3)


def column(df, name):
    return [r[name] for r in df.orderBy("series_id", "date").collect()]


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_scan_equals_sequential(spark, chunk):
    rnd = random.Random(chunk)
    x = [rnd.uniform(50, 150) for _ in range(200)]
    got = scan.ema(frame(spark, x), KEYS, TS, {"e": ("v", 0.15, 5)}, F.floor(F.unix_date("date") / chunk))
    want = pd.Series(x).ewm(alpha=0.15, adjust=False, min_periods=5).mean()
    assert np.allclose(np.array(column(got, "e"), dtype=float), want, rtol=1e-12, equal_nan=True)


def test_scan_with_gaps_equals_pandas(spark):
    x = [None, None, 3.0, 4.0, None, None, 9.0, 1.0, None, 2.0] * 5
    got = scan.ema(frame(spark, x), KEYS, TS, {"e": ("v", 0.3, 2)}, F.floor(F.unix_date("date") / 6))
    want = pd.Series(x, dtype=float).ewm(alpha=0.3, adjust=False, min_periods=2).mean()
    assert np.allclose(np.array(column(got, "e"), dtype=float), want, rtol=1e-12, equal_nan=True)


def test_rsi_is_null_without_losses_and_equals_wilder(spark):
    assert column(indicators.rsi(frame(spark, range(1, 40), name="close"), KEYS, TS, (7,)), "rsi_7") == [None] * 39
    rnd = random.Random(1)
    x = pd.Series([100 + rnd.gauss(0, 5) for _ in range(120)])
    d = x.diff()
    g, l = (s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for s in (d.clip(lower=0), -d.clip(upper=0)))  # noqa: E741
    got = column(indicators.rsi(frame(spark, x, name="close"), KEYS, TS, (14,)), "rsi_14")
    assert np.allclose(np.array(got, dtype=float), 100 - 100 / (1 + g / l), equal_nan=True)


def test_rolling_is_null_until_full_and_across_gaps(spark):
    x = [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0, 8.0]
    got = column(frame(spark, x).withColumn("m", windows.rolling("v", 3, clean.by(KEYS, TS), "std")), "m")
    assert np.allclose(np.array(got, dtype=float), pd.Series(x).rolling(3).std(), equal_nan=True)


def test_halo_equals_plain_windows(spark):
    df = frame(spark, [random.Random(2).random() * i for i in range(300)])
    w = clean.by(KEYS, TS)
    plain = df.withColumns({"m": windows.rolling("v", 30, w, "mean"), "l": F.lead("v", 7).over(w)})
    block = Window.partitionBy("series_id", "_block").orderBy("date")
    halo = windows.drop_halo(windows.with_halo(df, TS, 40, 30, 7).withColumns({"m": windows.rolling("v", 30, block, "mean"), "l": F.lead("v", 7).over(block)}))
    for c in ("m", "l"):
        assert np.allclose(np.array(column(plain, c), dtype=float), np.array(column(halo, c), dtype=float), equal_nan=True)


def test_weeks_end_on_monday_like_pandas(spark):
    days = [dt.datetime(2015, 1, 4, 23), dt.datetime(2015, 1, 5, 9), dt.datetime(2015, 1, 6, 1), dt.datetime(2015, 1, 27, 3)]
    df = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days)], "series_id string, ts timestamp, v double")
    got = calendars.on_spine(calendars.resample_first(df, KEYS, "ts", ["v"], calendars.week_ending_monday("ts")), KEYS, "bin", "interval 7 day")
    want = pd.DataFrame({"v": range(4)}, index=pd.DatetimeIndex(days)).groupby(pd.Grouper(freq="W-MON")).first()["v"]
    rows = got.orderBy("bin").collect()
    assert [r.bin for r in rows] == [d.date() for d in want.index]
    assert [r.v for r in rows] == [None if np.isnan(v) else v for v in want]


def test_fills_and_flags(spark):
    df = frame(spark, [None, None, 3.0, None, 5.0, None])
    got = clean.ffill(clean.bfill_leading(df, ["v"], KEYS, TS), ["v"], KEYS, TS)
    assert column(got, "v") == [3, 3, 3, 3, 5, 5] and column(got, "v_is_backfilled") == [True, True, False, False, False, False]
    nothing = clean.bfill_leading(frame(spark, [None, None]), ["v"], KEYS, TS)
    assert column(nothing, "v") == [None, None] and column(nothing, "v_is_backfilled") == [False, False]


@pytest.mark.parametrize("bucket", [None, "week", "month"])
def test_asof(spark, bucket):
    left = frame(spark, range(60), name="x")
    right = spark.createDataFrame([("a", dt.date(2020, 1, 5), 1.0), ("a", dt.date(2020, 1, 20), None), ("a", dt.date(2020, 2, 3), 2.0), ("b", dt.date(2019, 1, 1), 9.0)], "series_id string, date date, y double")
    got = column(joins.asof(left, right, KEYS, TS, ["y"], bucket and F.trunc("date", bucket)), "y")
    assert got == [None] * 4 + [1.0] * 29 + [2.0] * 27


def test_release_lag_uses_no_future(spark):
    low = spark.createDataFrame([("a", dt.date(2020, 1, 1), 5.0, 7.0)], "series_id string, date date, p double, q double")
    got = joins.release_lagged(frame(spark, range(50)), low, KEYS, TS, {"p": 45, "q": 0})
    assert column(got, "p") == [None] * 45 + [5.0] * 5 and column(got, "q") == [7.0] * 50


def test_leakage_is_found(spark):
    df = frame(spark, range(1, 80))
    w = clean.by(KEYS, TS)
    cut = dt.date(2020, 2, 10)
    honest = quality.leakage(df, lambda x: x.withColumn("f", windows.rolling("v", 5, w, "mean")), KEYS, TS, ["v"], ["f"], cut).collect()[0]
    leaky = quality.leakage(df, lambda x: x.withColumn("f", F.lead("v", 1).over(w)), KEYS, TS, ["v"], ["f"], cut).collect()[0]
    assert honest.n_different == 0 and honest.n_paired == 41 and leaky.n_different == 1


def test_folds_are_disjoint_and_purged(spark):
    df = frame(spark, range(100))
    for folds in (splits.walk_forward(df, KEYS, TS, 4, purge=5), splits.purged_folds(df, KEYS, TS, 4, horizon=5)):
        by_fold = {}
        for r in folds.collect():
            by_fold.setdefault(r.fold, {}).setdefault(r.role, []).append(r.rn)
        assert len(by_fold) == 4
        for parts in by_fold.values():
            held = parts.get("test") or parts["validation"]
            assert max(parts["train"]) == min(held) - 6 and sorted(parts["train"]) == list(range(len(parts["train"])))
    whole = splits.walk_forward(df, KEYS, TS, 3).where("role = 'test'").count()
    assert whole == 75


def test_purged_split_drops_the_purge(spark):
    got = splits.purged_split(frame(spark, range(100)), KEYS, TS).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 60, "validation": 13, "test": 13, None: 14}


def test_prune_keeps_the_first_and_constants(spark):
    rnd = random.Random(3)
    rows = [(x, 2 * x + 1, -x, rnd.random(), 1.0) for x in (rnd.random() for _ in range(50))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    assert splits.prune(df, ["a", "b", "c", "d", "e"]) == ["a", "d", "e"]
    assert splits.prune(df, ["b", "a", "d"]) == ["b", "d"] and splits.prune(df, ["a"]) == ["a"]


def test_thresholds_first_of_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "y int, s double").withColumn("g", F.lit("x"))
    best = metrics.best_threshold(df, ["g"], "y", "s").collect()[0]
    assert best.threshold == 0.21 and best.macro_f1 == 1
    rnd = random.Random(4)
    rows = [(rnd.randrange(2), round(rnd.random(), 2)) for _ in range(300)]
    got = metrics.threshold_scores(spark.createDataFrame(rows, "y int, s double"), [], "y", "s", [0.3, 0.5]).orderBy("threshold").collect()
    for r, t in zip(got, (0.3, 0.5), strict=True):
        assert (r.tp, r.fp, r.fn, r.tn) == tuple(sum(y == a and (s >= t) == b for y, s in rows) for a, b in ((1, True), (0, True), (1, False), (0, False)))


def test_auc_with_ties_equals_pair_counts(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(2), rnd.randrange(6) / 5) for _ in range(120)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    got = metrics.auc(spark.createDataFrame(rows, "y int, s double"), [], "y", "s").collect()[0].auc
    assert abs(got - want) < 1e-12
    assert metrics.auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), [], "y", "s").collect()[0].auc is None


def test_constant_column_has_no_correlation(spark):
    got = splits.correlations(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "a double, b double"), ["a", "b"]).collect()
    assert got[0].r is None and got[0].n == 2


def test_scalars(spark):
    row = spark.createDataFrame([(1.0, 0.0, -2.0, [1.0, 2.0])], "a double, z double, n double, l array<double>").select(
        scalar.safe_divide("a", "z").alias("d"), scalar.log("n").alias("g"), scalar.ordinal(F.lit("x"), ["y", "z"]).alias("o"), scalar.sign_label("n").alias("s"), scalar.softmax("l").alias("m"), scalar.gain("n").alias("up"), scalar.loss("n").alias("down")
    ).collect()[0]
    assert (row.d, row.g, row.o, row.s, row.up, row.down) == (None, None, None, "negative", 0, 2)
    assert np.allclose(row.m, np.exp([1, 2]) / np.exp([1, 2]).sum())


def test_pinball_boosting_lowers_the_loss(spark):
    rnd = random.Random(6)
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i % 10), (i % 10) + rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "series_id string, date date, x double, y double")
    loss = lambda d: d.agg(F.avg(metrics.pinball("y", "prediction", 0.9))).collect()[0][0]
    none, some = (forecast.pinball_boosting(df, ["x"], "y", 0.9, F.lit(True), rounds=n) for n in (0, 6))
    assert loss(some) < 0.6 * loss(none)


def test_paths_repeat_and_bands_are_ordered(spark):
    pool = spark.createDataFrame([("a", k, 11, 0.1 * k - 0.5, 0.001 * k - 0.005) for k in range(11)], "series_id string, place long, size long, z double, e double")
    schema = "series_id string, alpha double, beta double, long_run_sigma double, last_sigma double, start_sigma double, calibration double"
    origins = spark.createDataFrame([("a", 0.05, 0.9, 0.01, 0.012, 0.011, 1.0)], schema)
    a = forecast.bootstrap_paths(origins, pool, KEYS, 10, 60)
    b = forecast.bootstrap_paths(origins.repartition(5), pool.repartition(3), KEYS, 10, 60)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    for r in forecast.bands(a, KEYS, F.lit(100.0)).collect():
        assert r.p5 <= r.p10 <= r.p25 <= r.p50 <= r.p75 <= r.p90 <= r.p95
    assert forecast.sample_paths(a, KEYS, 5).groupBy("method").agg(F.countDistinct("path").alias("n")).collect()[0].n == 5
    p = {r.change: r.prob_above for r in forecast.exceedance(a.where("method = 'fhs'"), KEYS).collect()}
    assert p[-0.2] >= p[0.0] >= p[0.2]


def test_settings_and_rates():
    assert forecast.adaptive_settings(100) == (1.0, 0.5, 0.0) and forecast.adaptive_settings(5000) == (10.0, 2.0, 1.0)
    rates = [forecast.cosine_rate(i, 10) for i in range(10)]
    assert rates == sorted(rates, reverse=True) and abs(rates[0] - 0.1) < 1e-12 and abs(rates[-1] - 0.01) < 1e-12


def test_partial_autocorrelation_of_an_ar1(spark):
    rows = [("a", k, 0.6**k) for k in range(6)]
    got = forecast.partial_autocorrelation(spark.createDataFrame(rows, "series_id string, lag int, acf double"), KEYS).orderBy("lag").collect()
    assert np.allclose([r.pacf for r in got], [1, 0.6, 0, 0, 0, 0], atol=1e-12)


def test_missing_values_raise(spark):
    with pytest.raises(ValueError, match="v"):
        quality.require_complete(frame(spark, [1.0, None]), ["v"])
    assert quality.require_complete(frame(spark, [1.0]), ["v"]).count() == 1


def test_scan_is_linear_and_spans_are_cut(spark):
    n = 60_000
    df = spark.range(n).select(F.lit("a").alias("series_id"), F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 60).alias("date"), ((F.col("id") * 7919) % 97).cast("double").alias("v"))
    got = scan.ema(df, KEYS, "date", {"e": ("v", 0.1, 5)}).orderBy("date").select("e").toPandas()["e"]
    want = pd.Series([float(i * 7919 % 97) for i in range(n)]).ewm(alpha=0.1, adjust=False, min_periods=5).mean()
    assert np.allclose(got.to_numpy(dtype=float), want, rtol=1e-9, equal_nan=True)


def test_running_states(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda x: x.cast("double")).alias("v"), F.array().cast("array<double>").alias("none"))
    row = df.select(scan.running(F.col("v"), F.lit(0.0), lambda s, x: s / 2 + x).alias("r")).collect()[0]
    want, state = [], 0.0
    for x in range(1, 51):
        state = state / 2 + x
        want.append(state)
    assert np.allclose(row.r, want)


def test_auc_by_buckets_equals_pairs(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), float(rnd.random() < 0.4), rnd.choice([round(rnd.gauss(0, 2), 1), rnd.random() * 1e6, -5.0])) for _ in range(400)]
    got = {r.k: r.auc for r in metrics.auc(spark.createDataFrame(rows, "k string, y double, s double"), ["k"], "y", "s").collect()}
    for k in "ab":
        pos, neg = [s for g, y, s in rows if g == k and y], [s for g, y, s in rows if g == k and not y]
        assert abs(got[k] - np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])) < 1e-12
    one = metrics.auc(spark.createDataFrame([(1.0, 0.3)], "y double, s double"), [], "y", "s").collect()
    assert one[0].auc is None


def test_autoregression_equals_least_squares(spark):
    rnd = random.Random(11)
    level, values = 100.0, []
    for i in range(90):
        level += rnd.gauss(0, 1) + 3 * np.sin(i * np.pi / 6)
        values.append(level)
    df = frame(spark, values)
    found = forecast.ar_order_search(df, KEYS, TS, "v")
    v = np.diff(np.array(values))
    y = v[12:] - v[:-12]
    rows = {(r.p, r.seasonal_p): r for r in found.collect()}
    for (p, sp), r in rows.items():
        lags = [*range(1, p + 1), *[12 * k for k in range(1, sp + 1)]]
        at = np.arange(24, len(y))
        x = np.column_stack([np.ones(len(at)), *[y[at - k] for k in lags]])
        beta, *_ = np.linalg.lstsq(x, y[at], rcond=None)
        rss = ((y[at] - x @ beta) ** 2).sum()
        assert r.n == len(at) and np.allclose(r.coefficients, beta, rtol=1e-6, atol=1e-8)
        assert abs(r.aic - (len(at) * np.log(rss / len(at)) + 2 * (len(lags) + 2))) < 1e-6
    best = min(rows.values(), key=lambda r: (r.aic, r.p, r.seasonal_p))
    assert best["rank"] == 1
    ahead = [r.forecast for r in forecast.ar_forecast(df, found, KEYS, TS, "v", 3).orderBy("step").collect()]
    changes, twice, last, want = v.tolist(), y.tolist(), values[-1], []
    for _ in range(3):
        lags = [*range(1, best.p + 1), *[12 * k for k in range(1, best.seasonal_p + 1)]]
        twice.append(best.coefficients[0] + sum(b * twice[-k] for b, k in zip(best.coefficients[1:], lags, strict=True)))
        changes.append(twice[-1] + changes[-12])
        last += changes[-1]
        want.append(last)
    assert np.allclose(ahead, want)
    inside = {r.date: r.forecast for r in forecast.ar_fitted(df, found, KEYS, TS, "v").collect()}
    i = 70
    lags = [*range(1, best.p + 1), *[12 * k for k in range(1, best.seasonal_p + 1)]]
    j = i - 13  # y[j] = v[j + 12] - v[j], v[k] = values[k + 1] - values[k]
    step = best.coefficients[0] + sum(b * y[j - k] for b, k in zip(best.coefficients[1:], lags, strict=True))
    assert abs(inside[dt.date(2020, 1, 1) + dt.timedelta(days=i)] - (values[i - 1] + v[i - 13] + step)) < 1e-6


def test_grids_and_adaptive_penalties(spark):
    from seriesloom.operators import classify

    assert {n: len(c) for n, c in classify.learners().items()} == {"gbt": 36, "gbt_shallow": 36, "forest": 12, "logistic": 9}
    assert {n: len(c) for n, c in classify.learners(classify.SMALL_GRID).items()} == {"gbt": 1, "gbt_shallow": 1, "forest": 2, "logistic": 2}
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i % 10), float(i % 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "series_id string, date date, x double, y double")
    still = forecast.pinball_boosting(df, ["x"], "y", 0.5, F.lit(True), rounds=2, cut=1e9)
    assert still.agg(F.countDistinct("prediction")).collect()[0][0] == 1
    moved = forecast.pinball_boosting(df, ["x"], "y", 0.5, F.lit(True), rounds=2, rows_share=0.5, columns_share=0.5)
    assert moved.agg(F.countDistinct("prediction")).collect()[0][0] > 1


def test_folds_are_scaled_by_their_own_training_rows(spark):
    from seriesloom.operators import classify

    df = classify.with_raw(spark.createDataFrame([("train", 1.0), ("train", 3.0), ("validation", 100.0)], "role string, x double"), ["x"])
    got = {r.x: r.features[0] for r in classify.rescaled(df, F.col("role") == "train").collect()}
    assert abs(got[1.0] + got[3.0]) < 1e-12 and abs(got[100.0] - 98 / 2**0.5) < 1e-9


def test_quantiles_of_groups(spark):
    from seriesloom.operators.quantiles import quantiles

    rnd = random.Random(13)
    rows = [("ab"[i % 3 == 0], rnd.choice([rnd.gauss(0, 100), 7.0, None, -1e9])) for i in range(900)] + [("c", 5.0), ("d", None), ("e", 2.0), ("e", 2.0)]
    points = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.k: r._q for r in quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", points).collect()}
    assert set(got) == set("abce")
    for k in got:
        assert np.allclose(got[k], np.quantile([v for g, v in rows if g == k and v is not None], points))


@pytest.mark.parametrize("kind", ["tail", "ties", "narrow"])
def test_quantiles_under_skew(spark, kind):
    """400 000 values under one far larger one, mostly ties, or in a narrow range: few rows are ranked, exactly."""
    x = {"tail": "if(id = 17, 1e9, exp(randn(3)))", "ties": "if(id % 3 = 0, 5.0, round(randn(3), 2))", "narrow": "0.99 + rand(3) / 1e7"}[kind]
    df = written(spark.range(400_000, numPartitions=6).select(F.lit("a").alias("k"), F.expr(x).alias("v")), "skew")
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    want = np.quantile(df.select("v").toPandas()["v"], points)
    assert np.allclose(quantiles.quantiles(df, ["k"], "v", points).collect()[0]._q, want, rtol=1e-12)
    assert np.allclose(quantiles.quantiles(df, [], "v", points).collect()[0]._q, want, rtol=1e-12)
    distinct = df.distinct()
    sizes = [r["count"] for r in quantiles.depth_buckets(distinct, ["k"], "v").groupBy("_b").count().collect()]
    assert max(sizes) <= 0.02 * sum(sizes)


def test_fills_in_buckets_equal_plain_fills(spark):
    rnd = random.Random(12)
    df = frame(spark, [None if rnd.random() < 0.8 else rnd.random() for _ in range(200)])
    for days in (1, 7, 500):
        got = clean.ffill(df, ["v"], KEYS, TS, F.floor(F.unix_date(TS) / days))
        assert got.columns == df.columns and column(got, "v") == column(clean.ffill(df, ["v"], KEYS, TS), "v")


def garch_rows(series, alpha, beta, n, seed=0, start=dt.date(2000, 1, 1)):
    rng, s2, rows = np.random.default_rng(seed), 1e-4, []
    for i in range(n):
        e = rng.normal() * s2**0.5
        rows.append((series, start + dt.timedelta(days=i), float(e + 2e-4)))
        s2 = 1e-4 * (1 - alpha - beta) + alpha * e * e + beta * s2
    return rows


def garch_path(r, alpha, beta):
    e, v = r - r.mean(), r.var()
    s2 = np.full(len(r), v)
    for t in range(1, len(r)):
        s2[t] = (1 - alpha - beta) * v + alpha * e[t - 1] ** 2 + beta * s2[t - 1]
    return e, s2, float((-0.5 * (np.log(s2) + e * e / s2)).sum())


@pytest.mark.parametrize("days", [150, 100_000])
def test_refits_by_date_equal_plain_recursions(spark, days):
    """Each cut's fit, filtered volatility and pool are those of the returns before it; refinement never loses."""
    rows = garch_rows("a", 0.04, 0.955, 900) + garch_rows("b", 0.1, 0.8, 700, 1)
    df = spark.createDataFrame(rows, "series_id string, date date, r double").repartition(3)
    cuts, chunk = [dt.date(2001, 1, 1), dt.date(2002, 1, 1)], F.floor(F.unix_date("date") / days)
    fits = volatility.fit(df, KEYS, TS, "r", cuts, chunk=chunk)
    found = {(f.series_id, f.cut): f for f in fits.collect()}
    assert len(found) == 4
    seen = volatility.filtered(df, fits, KEYS, TS, "r", chunk).toPandas()
    pool = volatility.residual_pool(df, fits, KEYS, TS, "r", chunk).toPandas()
    for (series, cut), f in found.items():
        every = np.array([r for s, _, r in rows if s == series])
        r = np.array([r for s, d, r in rows if s == series and d < cut])
        e, s2, ll = garch_path(r, f.alpha, f.beta)
        assert np.isclose(ll, f.log_likelihood, rtol=1e-10) and np.isclose(f.last_sigma, s2[-1] ** 0.5) and f.n == len(r)
        assert ll >= max(garch_path(r, a, b)[2] for a, b in volatility.GRID) - 1e-6
        own = pool[(pool.series_id == series) & (pool.cut == cut)].sort_values("place")
        assert np.allclose(own.z, e / s2**0.5) and np.allclose(own.e, e) and (own["size"] == len(r)).all()
        mine = seen[(seen.series_id == series) & (seen.cut == cut)].sort_values("place")
        s2 = np.full(len(every), r.var())
        for t in range(1, len(every)):
            s2[t] = (1 - f.alpha - f.beta) * r.var() + f.alpha * (every[t - 1] - r.mean()) ** 2 + f.beta * s2[t - 1]
        assert np.allclose(mine.sigma, s2**0.5) and mine.seen.sum() == len(r)


def test_persistence_beyond_the_grid_is_reached(spark):
    df = spark.createDataFrame(garch_rows("a", 0.02, 0.9785, 6000, 5), "series_id string, date date, r double")
    coarse, fine = (volatility.fit(df, KEYS, TS, "r", rounds=n).collect()[0] for n in ([], None))
    assert coarse.persistence <= 0.97 + 1e-9 < fine.persistence <= volatility.MOST_PERSISTENT + 1e-12
    assert fine.log_likelihood > coarse.log_likelihood


def test_odd_returns(spark):
    """Null returns don't count; a series of one return, and no series at all."""
    rows = [("a", dt.date(2020, 1, 1), None), ("a", dt.date(2020, 1, 2), 0.1), ("b", dt.date(2020, 1, 1), None)]
    df = spark.createDataFrame(rows, "series_id string, date date, r double")
    assert volatility.fit(df, KEYS, TS, "r").count() == 0  # no variance, so no likelihood
    assert volatility.fit(df.where("false"), KEYS, TS, "r", [dt.date(2020, 1, 1)]).count() == 0


def brute_walks(origin, pool, text, paths, steps, method, draw):
    at = draw(text, paths, steps) % len(pool)
    normal = forecast.normals(text, paths, steps, draw)
    out = np.zeros((paths, steps))
    for p in range(paths):
        sigma = {"fhs_dvol": origin["start_sigma"], "fhs_cal": origin["last_sigma"] * origin["calibration"]}.get(method, origin["last_sigma"])
        s2, x = sigma**2, 0.0
        for t in range(steps):
            z, e = pool[at[p, t]]
            shock = e if method == "iid" else (normal[p, t] if method == "garch_normal" else z) * s2**0.5
            x += shock
            s2 = (1 - origin["alpha"] - origin["beta"]) * origin["long_run_sigma"] ** 2 + origin["alpha"] * shock**2 + origin["beta"] * s2
            out[p, t] = x
    return out


def test_paths_and_quantiles_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = [(float(z), float(z) / 90) for z in rng.normal(size=37)]
    rows = [("a", k, 37, *x) for k, x in enumerate(pool)]
    origin = {"alpha": 0.1, "beta": 0.8, "long_run_sigma": 0.01, "last_sigma": 0.02, "start_sigma": 0.015, "calibration": 1.3}
    dates = [dt.date(2020, 1, 6) + dt.timedelta(days=7 * i) for i in range(5)]
    schema = "series_id string, date date, " + ", ".join(f"{c} double" for c in forecast.STARTS)
    origins = spark.createDataFrame([("a", d, *(origin[c] for c in forecast.STARTS)) for d in dates] + [("none", dates[0], *[0.1] * 6)], schema)
    held = spark.createDataFrame(rows, "series_id string, place long, size long, z double, e double").repartition(3)
    keys = ["series_id", "date"]
    got = forecast.bootstrap_paths(origins, held, keys, 6, 20, 9, KEYS, at_steps=[2, 6], group_origins=2).toPandas()
    q = {(r.date, r.method, r.step): r.q for r in forecast.bootstrap_quantiles(origins, held, keys, [0.1, 0.5], [2, 6], 20, 9, KEYS, group_origins=2).collect()}
    assert len(got) == 5 * 5 * 20 * 2 and len(q) == 5 * 5 * 2 and set(got.series_id) == {"a"}
    for d in dates:
        for method in forecast.METHODS:
            want = brute_walks(origin, pool, f"9|a|{d}", 20, 6, method, forecast.drawn)
            own = got[(got.date == d) & (got.method == method)].sort_values(["path", "step"]).log_change.to_numpy().reshape(20, 2)
            assert np.allclose(own, want[:, [1, 5]])
            want = brute_walks(origin, pool, f"9|a|{d}", 20, 6, method, forecast.mixed)
            assert all(np.allclose(q[d, method, s], np.quantile(want[:, s - 1], [0.1, 0.5])) for s in (2, 6))


def test_draws_are_even():
    for draw in (forecast.drawn, forecast.mixed):
        u = draw("7|a", 400, 30) / forecast.DRAW_RANGE
        assert abs(u.mean() - 0.5) < 0.01 and abs(u.std() - 12**-0.5) < 0.01 and len(np.unique(u)) == u.size
        assert not np.array_equal(draw("7|b", 3, 3), draw("7|a", 3, 3)) and np.array_equal(draw("7|a", 3, 3), draw("7|a", 3, 3))


@pytest.mark.parametrize(("buckets", "chunk_rows"), [(4, 7), (256, 65_536), (16, 1)])
def test_running_median_equals_sorting(spark, buckets, chunk_rows):
    """Also with ties, heavy tails, times without values and values between the asked times."""
    rnd = random.Random(5)
    start = dt.datetime(2020, 1, 1)
    asked = [(k, start + dt.timedelta(hours=6 * i)) for k in "ab" for i in range(60)] + [("c", start)]
    values = [(k, start + dt.timedelta(hours=rnd.randrange(-40, 420)), rnd.choice([1.0, rnd.random(), rnd.gauss(0, 1) * 1e9, None])) for k in "ab" for _ in range(90)]
    v = spark.createDataFrame(values, "series_id string, at timestamp, v double").repartition(3)
    a = spark.createDataFrame(asked, "series_id string, at timestamp").repartition(2)
    got = {(r.series_id, r.at): (r.n, r.median) for r in quantiles.running_median(v, a, KEYS, "at", "v", buckets, chunk_rows).collect()}
    assert len(got) == len(asked)
    for k, t in got:
        known = [x for s, u, x in values if s == k and u <= t and x is not None]
        assert got[k, t][0] == len(known)
        assert got[k, t][1] == (np.median(known) if known else None)


def test_expanding_premium_uses_no_future(spark):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), random.Random(i).gauss(0, 0.01)) for i in range(200)]
    df = spark.createDataFrame(rows, "series_id string, date date, r double")
    later = df.withColumn("r", F.when(F.col("date") > "2020-05-20", F.col("r") * 50).otherwise(F.col("r")))
    quoted = df.select("series_id", "date", (F.lit(20.0) + F.dayofmonth("date")).alias("dvol"))
    a, b = ({r.date: (r.vrp, r.ratios) for r in forecast.expanding_premium(x, quoted, KEYS, TS, "r", "dvol", 10, 20).collect()} for x in (df, later))
    cut = dt.date(2020, 5, 20)
    assert all(a[d] == b[d] for d in a if d <= cut) and any(a[d] != b[d] for d in a if d > cut)
    assert a[dt.date(2020, 1, 15)] == (None, 5) and a[cut][0] is not None


def test_no_window_runs_over_a_series(spark):
    x = spark.range(300).select(F.lit("a").alias("series_id"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), *[F.col("id").cast("double").alias(c) for c in ("open", "high", "low", "close")])
    made = [scan.ema(x, KEYS, TS, {"e": ("close", 0.2, 3)}), indicators.ema_features(x, KEYS, TS, (5,)), indicators.rsi(x, KEYS, TS, (7,)), indicators.macd(x, KEYS, TS), indicators.atr(x, KEYS, TS, (7,)), clean.bfill_leading(x, ["close"], KEYS, TS), clean.ffill(x, ["close"], KEYS, TS), splits.numbered(x, KEYS, TS)]
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "windowspecdefinition(series_id#" not in plan or all("_chunk#" in line for line in plan.split("\n") if "windowspecdefinition" in line)


@pytest.mark.parametrize("days", [1, 9, 1000])
def test_built_in_scans_equal_pandas(spark, days):
    rnd = random.Random(8)
    x = [rnd.choice([None, rnd.random()]) for _ in range(120)]
    df, chunk = frame(spark, x), F.floor(F.unix_date("date") / days)
    s = pd.Series(x, dtype=float)
    assert np.allclose(np.array(column(clean.ffill(df, ["v"], KEYS, TS, chunk), "v"), dtype=float), s.ffill(), equal_nan=True)
    assert np.allclose(np.array(column(scan.lagged(df, {"p": "v"}, KEYS, TS, chunk), "p"), dtype=float), s.shift(1), equal_nan=True)
    got = scan.row_numbers(df, KEYS, TS, chunk).orderBy(TS).collect()
    assert [r.rn for r in got] == list(range(120)) and {r.n for r in got} == {120}


def test_one_series_of_five_million_rows(spark):
    n = 5_000_000
    df = spark.range(n).select(F.lit("a").alias("series_id"), F.timestamp_seconds(F.lit(1_000_000_000) + F.col("id") * 60).alias("date"), ((F.col("id") * 7919) % 97).cast("double").alias("v"))
    got = scan.ema(df, KEYS, "date", {"e": ("v", 0.1, 5)}).where(F.unix_seconds("date") >= 1_000_000_000 + (n - 1000) * 60).orderBy("date").toPandas()["e"]
    want = pd.Series([float(i * 7919 % 97) for i in range(n - 2000, n)]).ewm(alpha=0.1, adjust=False).mean()[-1000:]
    assert np.allclose(got.to_numpy(dtype=float), want.to_numpy(), rtol=1e-9)


@pytest.mark.parametrize("days", [1, 5, 1000])
@pytest.mark.parametrize("keyed", [True, False])
def test_loss_differences_in_blocks_equal_one_window(spark, days, keyed):
    rnd = random.Random(3)
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i + (i > 20) * 9), float(np.sin(i / 9)) + rnd.random(), rnd.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, date date, x double, y double").repartition(3)
    got = metrics.diebold_mariano(df, ["k"] if keyed else [], "date", "x", "y", 4, F.floor(F.unix_date("date") / days)).collect()
    d = np.array([x - y for _, _, x, y in rows])
    c = d - d.mean()
    v = c @ c + 2 * sum(c[k:] @ c[:-k] for k in range(1, 5))
    assert len(got) == 1 and got[0].n == 60 and np.isclose(got[0].dm, d.mean() / np.sqrt(v) * 60)


def adf_by_hand(y, most):
    d = np.diff(y)

    def fit(p, start):
        at = np.arange(start, len(y))
        x = np.column_stack([np.ones(len(at)), y[at - 1], *[d[at - 1 - k] for k in range(1, p + 1)]])
        b, *_ = np.linalg.lstsq(x, d[at - 1], rcond=None)
        rss = ((d[at - 1] - x @ b) ** 2).sum()
        return b, rss, x

    n = len(y) - most - 1
    best = min(range(most + 1), key=lambda p: n * np.log(fit(p, most + 1)[1] / n) + 2 * (p + 2))
    b, rss, x = fit(best, best + 1)
    return b[1] / np.sqrt(rss / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]), best, len(x)


@pytest.mark.parametrize("days", [37, 10_000])
def test_augmented_dickey_fuller_equals_least_squares(spark, days):
    rng = np.random.default_rng(1)
    walk, stay = 5_000 + np.cumsum(rng.normal(size=260)), [0.0, 0.0]
    for _ in range(198):
        stay.append(0.5 * stay[-1] - 0.3 * stay[-2] + rng.normal())
    df = frame(spark, walk).union(frame(spark, stay, series="b")).union(frame(spark, [3.0] * 30, series="c")).union(frame(spark, [1.0, 2.0], series="d"))
    got = {r.series_id: r for r in linear.augmented_dickey_fuller(df, KEYS, TS, "v", chunk=F.floor(F.unix_date("date") / days)).collect()}
    for k, y in (("a", walk), ("b", np.array(stay))):
        t, lags, n = adf_by_hand(y, int(np.ceil(12 * (len(y) / 100) ** 0.25)))
        assert np.isclose(got[k].t, t, rtol=1e-6) and (got[k].lags, got[k].n) == (lags, n)
    assert got["a"].p_value > 0.1 and got["b"].p_value < 0.001 and got["c"].t is None and got["d"].t is None
    assert abs(linear.unit_root_p(-2.86) - 0.05) < 0.001 and abs(linear.unit_root_p(-3.43) - 0.01) < 0.001 and linear.unit_root_p(9) == 1


@pytest.mark.parametrize("days", [20, 10_000])
def test_orders_with_moving_averages_equal_least_squares(spark, days):
    rng = np.random.default_rng(4)
    e = rng.normal(size=200)
    v = np.cumsum(e + 0.6 * np.r_[0, e[:-1]] + 3 * np.sin(np.arange(200) * np.pi / 6)) + 1000
    found = linear.arma_order_search(frame(spark, v), KEYS, TS, "v", chunk=F.floor(F.unix_date("date") / days)).collect()
    x = (v - v.mean()) / v.std()
    w = np.diff(x)
    w = w[12:] - w[:-12]
    at = np.arange(24, len(w))
    long = np.column_stack([np.ones(len(at)), *[w[at - k] for k in (1, 2, 3, 12, 13, 24)]])
    shock = np.full(len(w), np.nan)
    shock[at] = w[at] - long @ np.linalg.lstsq(long, w[at], rcond=None)[0]
    at = np.arange(36, len(w))
    assert len(found) == 54 and sorted(r["rank"] for r in found) == list(range(1, 55))
    for r in found:
        lags = [*range(1, r.p + 1), *[12 * k for k in range(1, r.seasonal_p + 1)]]
        moved = [*range(1, r.q + 1), *[12 * k for k in range(1, r.seasonal_q + 1)]]
        z = np.column_stack([np.ones(len(at)), *[w[at - k] for k in lags], *[shock[at - k] for k in moved]])
        b, *_ = np.linalg.lstsq(z, w[at], rcond=None)
        rss = ((w[at] - z @ b) ** 2).sum()
        assert r.n == len(at) and np.allclose(r.coefficients, b, rtol=1e-6, atol=1e-8)
        assert np.isclose(r.aic, len(at) * np.log(rss / len(at)) + 2 * (z.shape[1] + 1))
    best = min(found, key=lambda r: r["rank"])
    assert best.aic == min(r.aic for r in found) and best.q >= 1


@pytest.mark.parametrize("days", [9, 10_000])
def test_additive_regression_by_series_equals_numpy(spark, days):
    """Hourly rows with a daily course; each series has its own fit, the same in any chunks."""
    rng = np.random.default_rng(2)
    start, rows = dt.datetime(2021, 3, 1), []
    for k, (slope, size) in {"a": (0.01, 3.0), "b": (-0.02, 0.5)}.items():
        for i in range(900):
            rows.append((k, start + dt.timedelta(hours=i), 10 + slope * i + size * math.sin(2 * math.pi * i / 24) + rng.normal() * 0.1))
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("b", start + dt.timedelta(hours=950), None), ("c", start, None)], "k string, at timestamp, v double").repartition(3)
    cut = start + dt.timedelta(hours=800)
    got = linear.seasonal_regression(df, ["k"], "at", "v", F.col("at") < F.lit(cut), 0, 2, 3, 4, 0.01, F.floor(F.unix_date(F.col("at").cast("date")) / days)).toPandas()
    for k in "ab":
        own = [(t.replace(tzinfo=dt.timezone.utc).timestamp(), v, t < cut) for s, t, v in rows if s == k]
        s, v, train = (np.array(x) for x in zip(*own, strict=True))
        x = linear.additive_design(s, s[train].min(), s[train].max(), 4, [(365.25, 0), (7.0, 2), (1.0, 3)])
        m, d = x[train].mean(axis=0), x[train].std(axis=0)
        z = (x - m) / d
        b = np.linalg.solve(z[train].T @ z[train] / train.sum() + 0.01 * np.eye(z.shape[1]), z[train].T @ (v[train] - v[train].mean()) / train.sum())
        mine = got[(got.k == k) & got["at"].notna()].sort_values("at").prediction.to_numpy()[:900]
        assert np.allclose(mine, v[train].mean() + z @ b, atol=1e-6)
        assert np.abs(mine - v)[train].mean() < 0.3
    assert got[(got.k == "c") | got["at"].isna()].prediction.isna().all() and len(got) == len(rows) + 3


def test_class_weights_by_hand(spark):
    """n / (classes * the class's rows) over the rows that count; other rows take the same weights, unknown labels none."""
    rows = [("x", 1), ("x", 1), ("x", 1), ("y", 1), ("y", 0), ("z", 0), (None, 1)]
    df = spark.createDataFrame(rows, "label string, train int")
    got = {(r.label, r.train): r.weight for r in classify.with_class_weights(df, "label", F.col("train") == 1).collect()}
    assert got == {("x", 1): 4 / (2 * 3), ("y", 1): 4 / (2 * 1), ("y", 0): 4 / (2 * 1), ("z", 0): None, (None, 1): None}


def test_release_lags_in_years_equal_one_stream(spark):
    days = [dt.date(2019, 11, 1) + dt.timedelta(days=i) for i in range(500)]
    d = spark.createDataFrame([(k, x) for k in "ab" for x in days], "series_id string, date date")
    low = spark.createDataFrame([(k, x, float(i), None if i % 3 else float(-i)) for k in "ab" for i, x in enumerate(days[::31])], "series_id string, date date, p double, q double")
    every = [sorted(map(tuple, joins.release_lagged(d, low, KEYS, TS, {"p": 45, "q": 10}, b).collect())) for b in (None, F.lit(0), F.month("date") + 12 * F.year("date"))]
    assert every[0] == every[1] == every[2] and any(r[2] is not None for r in every[0])


def test_release_lags_compute_the_low_table_once(spark):
    """Three lags and both readings of the stream share one computation, counted by the rows it sees."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    low = spark.createDataFrame([("a", dt.date(2020, 1, 1), 5.0, 7.0, 1.0)], "series_id string, date date, p double, q double, s double")
    got = joins.release_lagged(frame(spark, range(50)), low.mapInArrow(count, low.schema), KEYS, TS, {"p": 45, "q": 0, "s": 10}).collect()
    assert len(got) == 50 and seen.value == 1
