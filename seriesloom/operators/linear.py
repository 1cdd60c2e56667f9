"""Regressions for each series from Gram matrices of its chunks: unit roots, orders of autoregressions with moving
averages, and additive trend and season.

A chunk of a series is a row with its values and the last values before it, so lags need no window over the series.
Each chunk gives the products of its regressors; these are summed by series, and the small systems are solved there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written
from .scan import prefix, span_of

NUMBERS = T.ArrayType(T.DoubleType())
_LIST = pa.list_(pa.float64())


def series_chunks(df: DataFrame, keys: list[str], ts: str, value: str, tail: int, chunk: Column | None = None) -> DataFrame:
    """(keys, _chunk, _v, _before), written: a chunk's values in order of time, and up to `tail` values before it."""
    known = df.where(F.col(value).isNotNull()).select(*keys, (span_of(df, ts) if chunk is None else chunk.cast("long")).alias("_chunk"), F.struct(F.col(ts).alias("t"), F.col(value).cast("double").alias("v")).alias("_p"))
    rows = known.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list("_p")).alias("_p")).select(*keys, "_chunk", F.col("_p.v").alias("_v"))
    last = lambda a: F.slice(a, F.greatest(F.size(a) - tail, F.lit(0)) + 1, F.lit(max(1, tail)))
    rows = written(rows, "series-chunks")
    before = prefix(rows.select(*keys, "_chunk", last(F.col("_v")).alias("_tail")), keys, "_chunk", F.array().cast("array<double>"), lambda s, x: last(F.concat(s, x["_tail"])), "_before")
    return rows.join(before, [*keys, "_chunk"])


def grams(chunks: DataFrame, keys: list[str], design: Callable[..., np.ndarray], given: list[str]) -> DataFrame:
    """(keys, n, m): number and products of the rows of `design(values, first own place, *given)`, summed by series."""
    kinds = [chunks.schema[k] for k in keys]
    out = T.StructType([*kinds, T.StructField("n", T.LongType()), T.StructField("m", NUMBERS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = [], []
            for own, before, *more in zip(*(batch.column(c).to_pylist() for c in ("_v", "_before", *given)), strict=True):
                z = design(np.array(before + own), len(before), *more)
                n.append(len(z))
                m.append((z.T @ z).ravel().tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(n, pa.int64()), pa.array(m, _LIST)], names=[*keys, "n", "m"])

    def total(group: pa.Table) -> pa.Table:
        held = [np.array(x) for x in group.column("m").to_pylist()]
        return pa.table([*(group.column(k).slice(0, 1) for k in keys), pa.array([sum(group.column("n").to_pylist())], pa.int64()), pa.array([sum(held).tolist()], _LIST)], names=[*keys, "n", "m"])

    return chunks.select(*keys, "_v", "_before", *given).mapInArrow(run, out).groupBy(*keys).applyInArrow(total, out)


def solved(sums: DataFrame, keys: list[str], fields: list[T.StructField], solve: Callable[..., list[tuple]], given: list[str] | None = None) -> DataFrame:
    """Rows of `solve(n, Gram matrix, *given)` for each series."""
    given = given or []
    schema = T.StructType([*[sums.schema[k] for k in keys], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            places, rows = [], []
            for i, (n, m, *more) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "m", *given)), strict=True)):
                m = np.array(m)
                made = solve(n, m.reshape(math.isqrt(len(m)), -1), *more)
                places += [i] * len(made)
                rows += made
            columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *(pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, fields, strict=True))], names=schema.names)

    return sums.mapInArrow(run, schema)


def least_squares(m: np.ndarray, use: list[int]) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of squares of the last column on the columns `use`, from products."""
    beta = np.linalg.lstsq(m[np.ix_(use, use)], m[use, -1], rcond=None)[0]
    return beta, max(float(m[-1, -1] - beta @ m[use, -1]), 1e-300)


# -- unit roots ------------------------------------------------------------------------------------
# MacKinnon's (1994) response surface of the p-value for one series with a constant.
_TAU_STAR, _TAU_MIN, _TAU_MAX = -1.61, -18.83, 2.74
_SMALL_P = (2.1659, 1.4412, 0.038269)
_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(t: float) -> float:
    """P-value of a Dickey-Fuller statistic with a constant."""
    if t > _TAU_MAX:
        return 1.0
    if t < _TAU_MIN:
        return 0.0
    x = sum(c * t**i for i, c in enumerate(_SMALL_P if t <= _TAU_STAR else _LARGE_P))
    return 0.5 * math.erfc(-x / math.sqrt(2))


def changes_design(values: np.ndarray, first: int, lags: int, centre: float, scale: float) -> np.ndarray:
    """1, the level before, `lags` changes before, and the change, for own rows that have them all."""
    x = (values - centre) / (scale or 1.0)
    d = np.diff(x)
    at = np.arange(max(first, lags + 1), len(x))
    return np.column_stack([np.ones(len(at)), x[at - 1], *[d[at - 1 - k] for k in range(1, lags + 1)], d[at - 1]])


def augmented_dickey_fuller(df: DataFrame, keys: list[str], ts: str, value: str, most_lags: int | None = None, chunk: Column | None = None) -> DataFrame:
    """(keys, t, p_value, lags, n): the unit-root test with a constant, its lags chosen by AIC (Said and Dickey, 1984).

    Up to 12 (n / 100)^(1/4) lags, or `most_lags`, are tried on the rows that have all of them; the chosen regression
    takes all rows that it can.  NULL values don't count.  Series that are constant or too short have NULL results.
    """
    known = df.where(F.col(value).isNotNull())
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_size"), F.avg(value).alias("_centre"), F.stddev_pop(value).alias("_scale"))
    limit = F.ceil(12 * F.pow(F.col("_size") / 100, 0.25)) if most_lags is None else F.lit(most_lags)
    sizes = written(sizes.withColumn("_lags", F.greatest(F.lit(0), F.least(limit, F.floor(F.col("_size") / 2) - 2)).cast("int")), "sizes")
    longest = sizes.agg(F.coalesce(F.max("_lags"), F.lit(0))).collect()[0][0]
    chunks = written(series_chunks(known, keys, ts, value, longest + 2, chunk), "lagged-chunks")
    given = ["_lags", "_centre", "_scale"]

    def choose(n: int, m: np.ndarray) -> list[tuple]:
        tried = []
        for p in range(len(m) - 2):
            use = list(range(p + 2))
            rss = least_squares(m, use)[1]
            tried.append((n * math.log(rss / n) + 2 * len(use) if n > len(use) else math.inf, p))
        return [(min(tried)[1],)]

    def test(n: int, m: np.ndarray) -> list[tuple]:
        use = list(range(len(m) - 1))
        beta, rss = least_squares(m, use)
        if n <= len(use) or np.linalg.matrix_rank(m[np.ix_(use, use)]) < len(use):
            return [(None, None, len(m) - 3, n)]
        t = float(beta[1] / math.sqrt(rss / (n - len(use)) * np.linalg.inv(m[np.ix_(use, use)])[1, 1]))
        return [(t, unit_root_p(t), len(m) - 3, n)]

    best = solved(grams(chunks.join(sizes, keys), keys, changes_design, given), keys, [T.StructField("_lags", T.IntegerType())], choose)
    again = chunks.join(sizes.drop("_lags").join(best, keys), keys)
    fields = [T.StructField("t", T.DoubleType()), T.StructField("p_value", T.DoubleType()), T.StructField("lags", T.IntegerType()), T.StructField("n", T.LongType())]
    return solved(grams(again, keys, changes_design, given), keys, fields, test)


# -- orders with moving averages -------------------------------------------------------------------
def _twice(values: np.ndarray, season: int) -> np.ndarray:
    """First and seasonal differences; NaN where the past is missing, so that places stay."""
    d = np.full(len(values), np.nan)
    d[1:] = np.diff(values)
    out = np.full(len(values), np.nan)
    out[season:] = d[season:] - d[:-season] if len(values) > season else d[season:]
    return out


def _lagged(x: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    out[k:] = x[: max(0, len(x) - k)]
    return out


def _whole(z: np.ndarray, first: int) -> np.ndarray:
    own = z[first:]
    return own[np.isfinite(own).all(axis=1)]


def arma_order_search(df: DataFrame, keys: list[str], ts: str, value: str, orders: tuple[int, int, int, int] = (2, 2, 2, 1), season: int = 12, long_lags: tuple[int, ...] | None = None, chunk: Column | None = None) -> DataFrame:
    """AIC of each autoregression with moving averages of the differenced series, by Hannan and Rissanen (1982).

    (keys, p, q, seasonal_p, seasonal_q, n, aic, coefficients, rank) for all orders up to `orders`, 54 by default.
    First a long autoregression gives residuals; then the series is regressed on its own lags and on lagged
    residuals, every combination from one Gram matrix of its series.  Seasonal lags add to the others.  All
    combinations use the same rows.  NULL values don't count.
    """
    most_p, most_q, most_sp, most_sq = orders
    long_lags = long_lags or tuple(sorted({1, 2, 3, season, season + 1, 2 * season}))
    past = [*range(1, most_p + 1), *[season * k for k in range(1, most_sp + 1)]]
    shocks = [*range(1, most_q + 1), *[season * k for k in range(1, most_sq + 1)]]
    tail = season + 1 + max(max(past, default=0), max(shocks, default=0) + max(long_lags))
    known = df.where(F.col(value).isNotNull())
    scales = written(known.groupBy(*keys).agg(F.avg(value).alias("_centre"), F.stddev_pop(value).alias("_scale")), "scales")
    chunks = written(series_chunks(known, keys, ts, value, tail, chunk).join(scales, keys), "lagged-chunks")

    def scaled(values: np.ndarray, centre: float, scale: float) -> np.ndarray:
        return _twice((values - centre) / (scale or 1.0), season)

    def long_design(values: np.ndarray, first: int, centre: float, scale: float) -> np.ndarray:
        w = scaled(values, centre, scale)
        return _whole(np.column_stack([np.ones(len(w)), *[_lagged(w, k) for k in long_lags], w]), first)

    def short_design(values: np.ndarray, first: int, centre: float, scale: float, beta: list[float]) -> np.ndarray:
        w = scaled(values, centre, scale)
        e = w - np.column_stack([np.ones(len(w)), *[_lagged(w, k) for k in long_lags]]) @ np.array(beta)
        return _whole(np.column_stack([np.ones(len(w)), *[_lagged(w, k) for k in past], *[_lagged(e, k) for k in shocks], w]), first)

    def long_fit(n: int, m: np.ndarray) -> list[tuple]:
        return [(least_squares(m, list(range(len(m) - 1)))[0].tolist(),)] if n else []

    def search(n: int, m: np.ndarray) -> list[tuple]:
        rows = []
        for p in range(most_p + 1):
            for q in range(most_q + 1):
                for sp in range(most_sp + 1):
                    for sq in range(most_sq + 1):
                        at = 1 + len(past)
                        use = [0, *range(1, p + 1), *range(1 + most_p, 1 + most_p + sp), *range(at, at + q), *range(at + most_q, at + most_q + sq)]
                        if n > len(use):
                            beta, rss = least_squares(m, use)
                            rows.append((p, q, sp, sq, n, float(n * math.log(rss / n) + 2 * (len(use) + 1)), beta.tolist()))
        return rows

    fitted = solved(grams(chunks, keys, long_design, ["_centre", "_scale"]), keys, [T.StructField("_beta", NUMBERS)], long_fit)
    sums = grams(chunks.join(fitted, keys), keys, short_design, ["_centre", "_scale", "_beta"])
    whole = T.IntegerType()
    fields = [*[T.StructField(c, whole) for c in ("p", "q", "seasonal_p", "seasonal_q")], T.StructField("n", T.LongType()), T.StructField("aic", T.DoubleType()), T.StructField("coefficients", NUMBERS)]
    found = solved(sums, keys, fields, search)
    order = F.struct(F.round("aic", 9), "p", "q", "seasonal_p", "seasonal_q")
    ranks = found.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("_order"))  # at most all combinations of a series
    return found.join(ranks, keys).withColumn("rank", F.array_position("_order", order).cast("int")).drop("_order")


# -- trend and season ------------------------------------------------------------------------------
DAY = 86_400.0


def additive_design(seconds: np.ndarray, low: float, high: float, hinges: int, terms: list[tuple[float, int]]) -> np.ndarray:
    """Trend from 0 to 1 over the training time, hinges spread evenly over it, and sines and cosines of each period."""
    trend = (seconds - low) / max(1.0, high - low)
    out = [trend, *[np.maximum(trend - k / (hinges + 1), 0.0) for k in range(1, hinges + 1)]]
    for period, order in terms:
        for k in range(1, order + 1):
            angle = 2 * math.pi * k / period * (seconds / DAY)
            out += [np.sin(angle), np.cos(angle)]
    return np.column_stack(out)


def ridge(n: int, m: np.ndarray, penalty: float) -> list[float]:
    """Intercept and coefficients from the products of (1, regressors, target): regressors count with unit deviation, the
    intercept isn't penalised, and a regressor that doesn't vary has the coefficient 0."""
    mean = m[0, 1:-1] / n
    cross = m[1:-1, 1:-1] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cross), 0.0))
    use = np.flatnonzero(scale > 1e-9)
    own = cross[np.ix_(use, use)] / np.outer(scale[use], scale[use])
    right = (m[1:-1, -1] / n - mean * m[0, -1] / n)[use] / scale[use]
    beta = np.zeros(len(mean))
    beta[use] = np.linalg.solve(own + penalty * np.eye(len(use)), right) / scale[use]
    return [float(m[0, -1] / n - beta @ mean), *beta.tolist()]


def seasonal_regression(df: DataFrame, keys: list[str], ts: str, target: str, train: Column, yearly: int = 6, weekly: int = 3, daily: int = 0, hinges: int = 8, penalty: float = 0.01, chunk: Column | None = None) -> DataFrame:
    """`df` with `prediction`: trend with hinges and Fourier terms of year, week and day, a ridge regression for each series.

    The trend runs over each series' own training time.  Times and targets that are NULL don't train; rows without a
    time, and series without training rows, have a NULL prediction.
    """
    terms = [(365.25, yearly), (7.0, weekly), (1.0, daily)]
    seconds = F.col(ts).cast("timestamp").cast("double")
    held = df.select(*keys, (span_of(df, ts) if chunk is None else chunk.cast("long")).alias("_chunk"), seconds.alias("_s"), F.col(target).cast("double").alias("_y")).where(train & seconds.isNotNull() & F.col(target).isNotNull())
    held = written(held, "training")
    ends = written(held.groupBy(*keys).agg(F.min("_s").alias("_low"), F.max("_s").alias("_high")), "ends")
    chunks = held.groupBy(*keys, "_chunk").agg(F.collect_list("_s").alias("_before"), F.collect_list("_y").alias("_v")).join(ends, keys)

    def design(values: np.ndarray, n: int, low: float, high: float) -> np.ndarray:
        return np.column_stack([np.ones(n), additive_design(values[:n], low, high, hinges, terms), values[n:]])

    beta = solved(grams(chunks, keys, design, ["_low", "_high"]), keys, [T.StructField("_beta", NUMBERS)], lambda n, m: [(ridge(n, m, penalty),)])
    fits = written(ends.join(beta, keys), "regressions")
    named = df.withColumn("_s", seconds).join(fits, keys, "left")
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("prediction", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, np.nan)
            betas, low, high, s = (batch.column(c) for c in ("_beta", "_low", "_high", "_s"))
            usable = np.flatnonzero(~(np.array(betas.is_null()) | np.array(s.is_null())))
            groups: dict[tuple, list[int]] = {}
            for i in usable.tolist():
                groups.setdefault((low[i].as_py(), high[i].as_py(), *(batch.column(k)[i].as_py() for k in keys)), []).append(i)
            for (a, b, *_), rows in groups.items():
                own = np.array(betas[rows[0]].as_py())
                x = additive_design(s.take(pa.array(rows)).to_numpy(), a, b, hinges, terms)
                out[rows] = own[0] + x @ own[1:]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, from_pandas=True)], names=schema.names)

    return named.mapInArrow(predict, schema)
