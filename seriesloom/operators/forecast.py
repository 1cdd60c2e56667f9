"""Forecast models as Spark jobs over series: bands, boosting, seasonal terms, autoregression, volatility."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import written
from . import volatility
from .clean import by
from .fits import together
from .quantiles import quantiles, running_median
from .windows import centred_mean

BAND = (0.1, 0.5, 0.9)
ACCURACY = 10_000


# -- baselines -------------------------------------------------------------------------------------
def constant_band(folds: DataFrame, keys: list[str], target: str, q: tuple[float, ...] = BAND) -> DataFrame:
    """Test rows with the quantiles of the target over their fold's training rows."""
    train = quantiles(folds.where("role = 'train'"), [*keys, "fold"], target, list(q))
    return folds.where("role = 'test'").join(train, [*keys, "fold"]).withColumns({"lower": F.col("_q")[0], "mid": F.col("_q")[1], "upper": F.col("_q")[2]}).drop("_q")


def scaled_band(folds: DataFrame, keys: list[str], target: str, sigma: str, q: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """Training quantiles of target over volatility, times the row's volatility; the middle is 0."""
    held = folds.withColumn("_z", F.try_divide(target, F.col(sigma)))
    train = quantiles(held.where("role = 'train'"), [*keys, "fold"], "_z", list(q))
    out = held.where("role = 'test'").join(train, [*keys, "fold"])
    return out.withColumns({"lower": F.col("_q")[0] * F.col(sigma), "mid": F.lit(0.0), "upper": F.col("_q")[1] * F.col(sigma)}).drop("_q", "_z")


# -- boosting --------------------------------------------------------------------------------------
def adaptive_settings(n: int) -> tuple[float, float, float]:
    """(least rows in a leaf, L1, L2) for a training size: weak below 150 rows, then growing with the size."""
    return (1.0, 0.5, 0.0) if n < 150 else (float(min(max(n // 100, 2), 10)), 2.0, 1.0)


def cosine_rate(i: int, rounds: int, high: float = 0.1, low: float = 0.01) -> float:
    """Learning rate that falls from `high` to `low` along half a cosine."""
    return low + (high - low) * (1 + math.cos(math.pi * i / max(1, rounds - 1))) / 2


def _features(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def boosted_points(folds: DataFrame, columns: list[str], target: str, rounds: int = 100, depth: int = 5, rate: float = 0.1, share: float = 0.8, leaf: int = 5, stop: Column | None = None) -> DataFrame:
    """Walk-forward predictions of gradient-boosted trees (squared loss): one fit for each fold, fits run together.

    Training rows where `stop` holds are kept from the trees and end the rounds when their loss stops falling.
    """
    from pyspark.ml.regression import GBTRegressor

    coded = written(_features(folds.withColumn("_stop", F.lit(False) if stop is None else stop), columns), "boosted")
    model = GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=rate, featureSubsetStrategy=str(share), minInstancesPerNode=leaf, seed=42)
    if stop is not None:
        model = model.setValidationIndicatorCol("_stop")

    def fold_points(fold) -> DataFrame:
        own = coded.where(F.col("fold") == fold)
        fitted = model.fit(own.where("role = 'train'"))
        return fitted.transform(own.where("role = 'test'")).withColumn("n_trees", F.lit(fitted.getNumTrees))

    numbers = sorted(r["fold"] for r in coded.select("fold").distinct().collect())
    out = together(folds.sparkSession, [partial(fold_points, n) for n in numbers])
    return reduce(DataFrame.unionByName, out).drop("features", "_stop")


def pinball_boosting(
    df: DataFrame, columns: list[str], target: str, q: float, train: Column, rounds: int = 100, depth: int = 3, rate: float | Callable[[int], float] = 0.3, leaf: int = 10,
    shrink: float = 2.0, cut: float = 0.0, rows_share: float = 1.0, columns_share: float = 1.0, seed: int = 42,
) -> DataFrame:
    """`df` with `prediction`: trees fitted to the pinball gradient, leaves set to the quantile of their errors.

    Each round is one tree, one grouped percentile (off by 1/ACCURACY of the ranks at most) over its leaves and one
    join with that small table; every
    fifth round is written, so lineage stays short.  A leaf's step is its quantile over its m rows, where
    `cut` (L1) is taken off m times the quantile and `shrink` (L2) is added to m.  A round's tree sees the share of
    training rows that a hash of features and round picks, and a drawn share of the columns.
    """
    from pyspark.ml.feature import VectorSlicer
    from pyspark.ml.regression import DecisionTreeRegressor

    now = _features(df, columns).withColumn("_train", train)
    start = now.where("_train").agg(F.percentile_approx(target, q, ACCURACY)).collect()[0][0]
    now = written(now.withColumn("prediction", F.lit(float(start))), "pinball")
    tree = DecisionTreeRegressor(featuresCol="_own", labelCol="_g", maxDepth=depth, minInstancesPerNode=leaf, seed=seed).setLeafCol("_leaf").setPredictionCol("_p")
    drawn = np.random.default_rng(seed)
    for i in range(rounds):
        step = rate(i) if callable(rate) else rate
        own = sorted(drawn.choice(len(columns), max(1, round(columns_share * len(columns))), replace=False).tolist())
        graded = VectorSlicer(inputCol="features", outputCol="_own", indices=own).transform(now.withColumn("_g", F.when(F.col(target) > F.col("prediction"), q).otherwise(q - 1)))
        picked = F.col("_train") & (F.pmod(F.xxhash64(F.lit(seed + i), *columns), F.lit(10_000)) < int(rows_share * 10_000))
        placed = tree.fit(graded.where(picked)).transform(graded)
        leaves = placed.where(picked).groupBy("_leaf").agg(F.percentile_approx(F.col(target) - F.col("prediction"), q, ACCURACY).alias("_e"), F.count("*").alias("_m"))
        moved = placed.join(F.broadcast(leaves), "_leaf", "left")  # at most 2 ** depth rows
        pull = F.signum("_e") * F.greatest(F.abs("_e") * F.col("_m") - cut, F.lit(0.0)) / (F.col("_m") + shrink)
        now = moved.withColumn("prediction", F.col("prediction") + step * F.coalesce(pull, F.lit(0.0))).select(now.columns)
        if i % 5 == 4:
            now = written(now, "pinball")
    return now.drop("features", "_train")


# -- seasonal models -------------------------------------------------------------------------------
def decompose(df: DataFrame, keys: list[str], ts: str, value: str, season: Column, period: int = 12) -> DataFrame:
    """Additive trend (centred average), seasonal means centred on zero, and the rest."""
    df = df.withColumns({"trend": centred_mean(value, period, by(keys, ts)), "_s": season})
    df = df.withColumn("_d", F.col(value) - F.col("trend"))
    means = df.groupBy(*keys, "_s").agg(F.avg("_d").alias("_m"))
    means = means.withColumn("seasonal", F.col("_m") - F.avg("_m").over(Window.partitionBy(*keys))).drop("_m")
    return df.join(means, [*keys, "_s"]).withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_s", "_d")


def dickey_fuller(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """The t statistic of the level in a regression of changes on it (no lags), and the 5 % verdict."""
    w = by(keys, ts)
    d = df.withColumn("_x", F.lag(value).over(w)).withColumn("_y", F.col(value) - F.col("_x")).where("_x is not null and _y is not null")
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.regr_sxx("_y", "_x").alias("_xx"), F.regr_syy("_y", "_x").alias("_yy"), F.regr_sxy("_y", "_x").alias("_xy"))
    rss = F.col("_yy") - F.col("slope") * F.col("_xy")
    t = F.try_divide(F.col("slope"), F.sqrt(F.when(rss > 0, rss / (F.col("n") - 2) / F.col("_xx"))))
    return s.withColumn("t", t).withColumn("stationary", F.col("t") < -2.86).select(*keys, "n", "slope", "t", "stationary")


def partial_autocorrelation(acf: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lag, pacf) by the Durbin-Levinson recursion on each series' short array of autocorrelations."""

    def levinson(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("lag")["acf"].to_numpy()
        out, phi = [1.0], np.zeros(0)
        for k in range(1, len(r)):
            last = (r[k] - phi @ r[k - 1 : 0 : -1]) / (1 - phi @ r[1:k]) if k > 1 else r[1]
            phi = np.append(phi - last * phi[::-1], last)
            out.append(float(last))
        head = pdf[keys].iloc[[0] * len(out)].reset_index(drop=True)
        return head.assign(lag=range(len(out)), pacf=out)

    schema = ", ".join([*(f"{k} {acf.schema[k].dataType.simpleString()}" for k in keys), "lag int", "pacf double"])
    return acf.groupBy(*keys).applyInPandas(levinson, schema)


def ar_order_search(df: DataFrame, keys: list[str], ts: str, value: str, orders: int = 2, seasonal: int = 2, season: int = 12) -> DataFrame:
    """AIC of each autoregression of the differenced series with p ordinary and P seasonal lags.

    One aggregation forms the series' moments of all lags; each small system is solved from these.
    """
    w = by(keys, ts)
    lags = [*range(1, orders + 1), *[season * k for k in range(1, seasonal + 1)]]
    d = df.withColumn("_v", F.col(value) - F.lag(value).over(w)).withColumn("_y", F.col("_v") - F.lag("_v", season).over(w))
    d = d.withColumns({f"_x{k}": F.lag("_y", k).over(w) for k in lags}).withColumn("_x0", F.lit(1.0)).dropna(subset=["_y", *[f"_x{k}" for k in lags]])
    names = ["_x0", *[f"_x{k}" for k in lags], "_y"]
    moments = F.array(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names])
    sums = d.groupBy(*keys).agg(F.count("*").alias("n"), moments.alias("m"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, row in pdf.iterrows():
                m = np.array(row["m"]).reshape(len(names), len(names))
                for p in range(orders + 1):
                    for s in range(seasonal + 1):
                        use = [0, *range(1, p + 1), *range(orders + 1, orders + s + 1)]
                        a, b = m[np.ix_(use, use)], m[use, -1]
                        beta = np.linalg.lstsq(a, b, rcond=None)[0]
                        rss = max(float(m[-1, -1] - beta @ b), 1e-12)
                        rows.append([*row[keys], p, s, int(row["n"]), float(row["n"] * math.log(rss / row["n"]) + 2 * (len(use) + 1)), beta.tolist()])
            yield pd.DataFrame(rows, columns=[*keys, "p", "seasonal_p", "n", "aic", "coefficients"])

    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "p int, seasonal_p int, n long, aic double, coefficients array<double>"])
    out = sums.mapInPandas(solve, schema)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("aic", "p", "seasonal_p")))


def ar_forecast(df: DataFrame, best: DataFrame, keys: list[str], ts: str, value: str, steps: int, orders: int = 2, season: int = 12) -> DataFrame:
    """(keys, step, forecast): the chosen autoregression run forward from each series' last rows."""
    need = season * 3 + orders + 2
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    tail = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= need).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(ts, value))), lambda x: x[value]).alias("_tail"))
    given = tail.join(best.where("rank = 1"), keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, row in pdf.iterrows():
                level = list(map(float, row["_tail"]))
                change = [b - a for a, b in zip(level, level[1:], strict=False)]
                twice = [b - a for a, b in zip(change, change[season:], strict=False)]
                beta, p = list(row["coefficients"]), int(row["p"])
                for step in range(1, steps + 1):
                    y = beta[0] + sum(beta[k] * twice[-k] for k in range(1, p + 1)) + sum(beta[p + k] * (twice[-season * k] if len(twice) >= season * k else 0.0) for k in range(1, int(row["seasonal_p"]) + 1))
                    twice.append(y)
                    change.append(y + change[-season])
                    level.append(level[-1] + change[-1])
                    rows.append([*row[keys], step, level[-1]])
            yield pd.DataFrame(rows, columns=[*keys, "step", "forecast"])

    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "step int, forecast double"])
    return given.mapInPandas(run, schema)


def ar_fitted(df: DataFrame, best: DataFrame, keys: list[str], ts: str, value: str, orders: int = 2, season: int = 12) -> DataFrame:
    """(keys, ts, forecast): the chosen autoregression's one-step forecast of each row that has all its lags."""
    w = by(keys, ts)
    lags = [*range(1, orders + 1), *[season * k for k in range(1, 3)]]
    d = df.withColumn("_v", F.col(value) - F.lag(value).over(w)).withColumn("_y", F.col("_v") - F.lag("_v", season).over(w))
    d = d.withColumns({"_level": F.lag(value).over(w), "_season": F.lag("_v", season).over(w), **{f"_x{k}": F.lag("_y", k).over(w) for k in lags}})
    chosen = best.where("rank = 1").select(*keys, "p", "seasonal_p", "coefficients")
    d = d.join(chosen, keys)
    at = lambda i: F.get("coefficients", i)
    terms = [F.when(F.col("p") >= k, at(F.lit(k)) * F.col(f"_x{k}")).otherwise(0.0) for k in range(1, orders + 1)]
    terms += [F.when(F.col("seasonal_p") >= k, at(F.col("p") + k) * F.col(f"_x{season * k}")).otherwise(0.0) for k in (1, 2)]
    made = reduce(lambda x, y: x + y, terms, at(F.lit(0)))
    return d.select(*keys, ts, (F.col("_level") + F.col("_season") + made).alias("forecast")).where("forecast is not null")


# -- volatility ------------------------------------------------------------------------------------
GRID = volatility.GRID


def garch_grid(returns: DataFrame, keys: list[str], ts: str, r: str, grid: list[tuple[float, float]] = GRID, rounds: list | None = None) -> DataFrame:
    """The variance-targeted GARCH(1,1) of largest likelihood: alpha, beta, persistence, last and long-run sigma for
    each series (Bollerslev, 1986), by a common grid and then around each series' own best point."""
    return volatility.fit(returns, keys, ts, r, None, grid, rounds).drop("mean")


def premium_ratios(returns: DataFrame, implied: DataFrame, keys: list[str], ts: str, r: str, dvol: str, window: int = 30) -> DataFrame:
    """(keys, ts, _iv, _ratio, _known_at): daily implied volatility, and realised over implied of the `window` returns
    after each row, which is known at the last of these."""
    ahead = by(keys, ts).rowsBetween(1, window)
    daily = returns.where(F.col(r).isNotNull()).join(implied, [*keys, ts], "left").withColumn("_iv", F.col(dvol) / 100 / math.sqrt(365))
    full = F.count(r).over(ahead) == window
    daily = daily.withColumns({"_real": F.when(full, F.stddev_samp(r).over(ahead)), "_known_at": F.when(full, F.max(ts).over(ahead))})
    return daily.select(*keys, ts, "_iv", F.try_divide("_real", "_iv").alias("_ratio"), "_known_at")


def start_sigma(fit: DataFrame, returns: DataFrame, implied: DataFrame, keys: list[str], ts: str, r: str, dvol: str, window: int = 30, least: int = 60) -> DataFrame:
    """Where implied volatility is known: it times the median of realised over implied in completed windows;
    else the fitted sigma. All are daily."""
    daily = premium_ratios(returns, implied, keys, ts, r, dvol, window)
    ratios = daily.groupBy(*keys).agg(F.median("_ratio").alias("vrp"), F.count("_ratio").alias("_n"), F.max_by("_iv", F.when(F.col("_iv").isNotNull(), F.col(ts))).alias("implied_sigma"))
    out = fit.join(ratios, keys, "left")
    scaled = F.when(F.col("_n") >= least, F.col("vrp") * F.col("implied_sigma"))
    return out.withColumn("start_sigma", F.coalesce(scaled, "last_sigma")).drop("_n")


def expanding_premium(returns: DataFrame, implied: DataFrame, keys: list[str], ts: str, r: str, dvol: str, window: int = 30, least: int = 60) -> DataFrame:
    """(keys, ts, implied_sigma, ratios, vrp) for each known return: implied volatility of the day, and the median of
    realised over implied among windows that ended by then; NULL until there are `least` of them."""
    daily = written(premium_ratios(returns, implied, keys, ts, r, dvol, window), "premium")
    known = daily.where("_ratio is not null").select(*keys, F.col("_known_at").alias(ts), "_ratio")
    medians = running_median(known, daily.select(*keys, ts), keys, ts, "_ratio")
    held = daily.select(*keys, ts, F.col("_iv").alias("implied_sigma")).join(medians, [*keys, ts])
    return held.select(*keys, ts, "implied_sigma", F.col("n").alias("ratios"), F.when(F.col("n") >= least, F.col("median")).alias("vrp"))


def residual_pool(returns: DataFrame, fit: DataFrame, keys: list[str], ts: str, r: str) -> DataFrame:
    """(keys, place, size, z, e): every standardised residual and centred return of a series, numbered from 0."""
    known = returns.where(F.col(r).isNotNull())
    return volatility.residual_pool(known, fit if "mean" in fit.columns else fit.join(known.groupBy(*keys).agg(F.avg(r).alias("mean")), keys), keys, ts, r)


# -- simulated paths -------------------------------------------------------------------------------
METHODS = ["fhs", "fhs_dvol", "fhs_cal", "iid", "garch_normal"]
DRAW_RANGE = 1 << 52
STARTS = ["alpha", "beta", "long_run_sigma", "last_sigma", "start_sigma", "calibration"]


def drawn(text: str, paths: int, steps: int, salt: str = "") -> np.ndarray:
    """Repeatable whole numbers from 0 to 2^52 - 1, one for each path and step: the leading 13 hex digits of an md5 over
    text, path and step, and the salt."""
    head = text.encode()
    tails = [b"|%d%s" % (s, salt.encode()) for s in range(1, steps + 1)]
    data = b"".join([hashlib.md5(start + tail, usedforsecurity=False).digest() for p in range(1, paths + 1) for start in (head + b"|%d" % p,) for tail in tails])
    return (np.frombuffer(data, dtype=">u8")[::2] >> np.uint64(12)).astype(np.int64).reshape(paths, steps)


def mixed(text: str, paths: int, steps: int, salt: str = "") -> np.ndarray:
    """As `drawn`, by one md5 over text and salt and a mixed counter (the finaliser of splitmix64): much faster, but not
    what SQL could draw."""
    first = np.frombuffer(hashlib.md5((text + salt).encode(), usedforsecurity=False).digest()[:8], dtype="<u8")
    z = first + np.arange(1, paths * steps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(12)).astype(np.int64).reshape(paths, steps)


def normals(text: str, paths: int, steps: int, draw: Callable[..., np.ndarray] = drawn) -> np.ndarray:
    unit = lambda salt: (draw(text, paths, steps, salt) + 1) / (DRAW_RANGE + 1.0)
    return np.sqrt(-2 * np.log(unit("|1"))) * np.cos(2 * math.pi * unit("|2"))


def walk(start: dict[str, float], method: str, z: np.ndarray, e: np.ndarray, normal: np.ndarray | None) -> np.ndarray:
    """Log changes (paths x steps) of filtered historical simulation without drift: all paths are stepped together."""
    sigma = {"fhs_dvol": start["start_sigma"], "fhs_cal": start["last_sigma"] * start["calibration"]}.get(method, start["last_sigma"])
    v, alpha, beta = start["long_run_sigma"] ** 2, start["alpha"], start["beta"]
    if method == "iid":
        return np.cumsum(e, axis=1)
    shock = normal if method == "garch_normal" else z
    out, now = np.empty(z.shape), np.full(len(z), sigma * sigma)
    for t in range(z.shape[1]):
        out[:, t] = shock[:, t] * np.sqrt(now)
        now = (1 - alpha - beta) * v + alpha * out[:, t] ** 2 + beta * now
    return np.cumsum(out, axis=1)


def _simulated(origins: DataFrame, pool: DataFrame, keys: list[str], pool_keys: list[str], steps: int, paths: int, seed: int, methods: list[str], fields: list, report, group_origins: int, draw: Callable[..., np.ndarray]) -> DataFrame:
    """`report` of each origin's walks. A task holds one pool and at most some `group_origins` origins that use it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    own = origins.select(*dict.fromkeys([*pool_keys, *keys]), *[F.col(c).cast("double") for c in STARTS], text.alias("_text"))
    parts = own.groupBy(*pool_keys).agg(F.ceil(F.count("*") / group_origins).cast("int").alias("_parts"))
    asked = own.join(parts, pool_keys).withColumn("_part", F.pmod(F.xxhash64("_text"), "_parts").cast("int"))
    held = pool.join(parts, pool_keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(*pool_keys, "_part", "place", "z", "e")

    def run(asked: pa.Table, pool: pa.Table) -> pa.Table:
        parts = []
        if asked.num_rows and pool.num_rows:
            pool = pool.take(pc.sort_indices(pool.column("place")))
            z_all, e_all = pool.column("z").to_numpy(), pool.column("e").to_numpy()
            for i, row in enumerate(asked.select([*STARTS, "_text"]).to_pylist()):
                at = draw(row["_text"], paths, steps) % pool.num_rows
                z, e = z_all[at], e_all[at]
                normal = normals(row["_text"], paths, steps, draw) if "garch_normal" in methods else None
                for method in methods:
                    made = report(walk(row, method, z, e, normal))
                    n = len(made[0])
                    parts.append([*(asked.column(k).take(pa.array(np.full(n, i))) for k in keys), pa.array([method] * n), *made])
        names = [*keys, "method", *(f.name for f in fields)]
        kinds = {**{k: asked.schema.field(k).type for k in keys}, "method": pa.string()}
        if not parts:
            return pa.table({n: pa.array([], kinds.get(n) or to_arrow_type(next(f for f in fields if f.name == n).dataType)) for n in names})
        return pa.concat_tables([pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in p], names=names) for p in parts])

    schema = T.StructType([*[origins.schema[k] for k in keys], T.StructField("method", T.StringType()), *fields])
    by_part = [*pool_keys, "_part"]
    return asked.groupBy(*by_part).cogroup(held.groupBy(*by_part)).applyInArrow(run, schema)


def bootstrap_paths(
    origins: DataFrame, pool: DataFrame, keys: list[str], steps: int = 30, paths: int = 10_000, seed: int = 7, pool_keys: list[str] | None = None,
    methods: list[str] | None = None, at_steps: list[int] | None = None, group_origins: int = 16,
) -> DataFrame:
    """(keys, method, path, step, log_change): filtered historical simulation without drift (Barone-Adesi, 1999).

    `origins` has keys, alpha, beta, long_run_sigma, last_sigma, start_sigma and calibration; every method runs from
    each.  A path draws a residual of its pool for each step by `drawn`, so a run repeats however rows are partitioned.
    All paths of an origin are stepped together; only the steps `at_steps` are returned (all by default).  Origins
    without a pool have no rows.
    """
    wanted = np.array(at_steps or range(1, steps + 1))
    fields = [T.StructField("path", T.IntegerType()), T.StructField("step", T.IntegerType()), T.StructField("log_change", T.DoubleType())]

    def report(x: np.ndarray) -> list[pa.Array]:
        path = np.repeat(np.arange(1, len(x) + 1, dtype=np.int32), len(wanted))
        return [pa.array(path), pa.array(np.tile(wanted.astype(np.int32), len(x))), pa.array(x[:, wanted - 1].ravel())]

    return _simulated(origins, pool, keys, pool_keys or keys, steps, paths, seed, methods or METHODS, fields, report, group_origins, drawn)


def bootstrap_quantiles(
    origins: DataFrame, pool: DataFrame, keys: list[str], levels: list[float], at_steps: list[int], paths: int = 1_000, seed: int = 7, pool_keys: list[str] | None = None,
    methods: list[str] | None = None, group_origins: int = 64,
) -> DataFrame:
    """(keys, method, step, q): quantiles of such paths' log changes, linear between neighbours, without the paths; drawn by
    `mixed`."""
    steps = max(at_steps)
    fields = [T.StructField("step", T.IntegerType()), T.StructField("q", T.ArrayType(T.DoubleType()))]

    def report(x: np.ndarray) -> list[pa.Array]:
        q = np.quantile(x[:, np.array(at_steps) - 1], levels, axis=0).T
        return [pa.array(at_steps, pa.int32()), pa.array(q.tolist(), pa.list_(pa.float64()))]

    return _simulated(origins, pool, keys, pool_keys or keys, steps, paths, seed, methods or METHODS, fields, report, group_origins, mixed)


def bands(paths: DataFrame, keys: list[str], spot: Column, levels: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """Price quantiles of each step: p5 to p95."""
    q = paths.groupBy(*keys, "method", "step").agg(F.percentile(spot * F.exp("log_change"), list(levels)).alias("_q"))
    return q.select(*keys, "method", "step", *[F.col("_q")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(levels)])


def exceedance(paths: DataFrame, keys: list[str], changes: tuple[float, ...] = (-0.2, -0.1, 0.0, 0.1, 0.2), step: int | None = None) -> DataFrame:
    """Share of paths whose price at `step` (the last one by default) is at or above each level, as a change from the spot."""
    cells = F.array(*[F.struct(F.lit(c).alias("change"), (F.exp("log_change") >= 1 + c).cast("double").alias("hit")) for c in changes])
    if step is None:
        paths = paths.groupBy(*keys, "method", "path").agg(F.max_by("log_change", "step").alias("log_change"))
    else:
        paths = paths.where(F.col("step") == step)
    return paths.select(*keys, "method", F.inline(cells)).groupBy(*keys, "method", "change").agg(F.avg("hit").alias("prob_above"))


def sample_paths(paths: DataFrame, keys: list[str], count: int = 24, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """`count` whole paths spread evenly by their last value between two quantiles."""
    last = paths.groupBy(*keys, "method", "path").agg(F.max_by("log_change", "step").alias("_end"))
    w = Window.partitionBy(*keys, "method").orderBy(F.round("_end", 9), "path")
    ranked = last.withColumn("_u", F.percent_rank().over(w))
    grid = ranked.withColumn("_g", F.floor((F.col("_u") - low) / (high - low) * (count - 1) + 0.5).cast("int")).where(F.col("_g").between(0, count - 1))
    goal = low + F.col("_g") * (high - low) / (count - 1)
    near = Window.partitionBy(*keys, "method", "_g").orderBy(F.round(F.abs(F.col("_u") - goal), 9), "path")
    chosen = grid.withColumn("_k", F.row_number().over(near)).where("_k = 1").select(*keys, "method", "path")
    return paths.join(chosen, [*keys, "method", "path"])
