"""GARCH(1,1) with variance targeting, refitted at any dates, and the volatility that it filters.

A variance is linear in the long-run variance and in decayed sums of r*r, r and 1.  These sums depend on beta only, so
one scan gives the variances of every alpha, mean and refit date: a series is scanned once for each beta in question,
however many refits there are.  A series lies in chunks, one row with arrays each; a chunk's decayed sums are combined
to the sums before each chunk (see `scan`), and chunks add up their likelihoods.  Candidates are a common grid first,
then rows around each fit's own best point.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written
from .scan import affine, prefix, span_of

GRID = [(a, b) for a in (0.02, 0.05, 0.1, 0.15, 0.2) for b in (0.5, 0.7, 0.8, 0.9, 0.95) if a + b < 1]
#: Factors for alpha, and for what persistence lacks to 1, around the best point so far.
ROUNDS = [((0.5, 0.75, 1.0, 1.25, 1.5), (0.05, 0.3, 1.0, 1.5, 2.0)), ((0.8, 0.9, 1.0, 1.1, 1.2), (0.5, 0.75, 1.0, 1.25, 1.6))]
MOST_PERSISTENT = 0.999
_LAST = dt.date(9999, 12, 31)
_SUMS = 3  # decayed sums of r*r, r and 1


def chunks_of(returns: DataFrame, keys: list[str], ts: str, r: str, chunk: Column | None = None) -> DataFrame:
    """(keys, _chunk, _t, _r), written: a row for each chunk of the known returns, in order of time."""
    known = returns.where(F.col(r).isNotNull()).select(*keys, (span_of(returns, ts) if chunk is None else chunk).alias("_chunk"), F.struct(F.col(ts).alias("t"), F.col(r).cast("double").alias("r")).alias("_p"))
    pairs = known.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    return written(pairs.select(*keys, "_chunk", F.col("_p.t").alias("_t"), F.col("_p.r").alias("_r")), "return-chunks")


def moments(returns: DataFrame, keys: list[str], ts: str, r: str, cuts: list[dt.date]) -> DataFrame:
    """(keys, cut, n, mean, v): moments of the returns before each cut, by one grouped pass."""
    known = returns.where(F.col(r).isNotNull())
    cells = []
    for i, c in enumerate(cuts):
        x = F.when(F.col(ts).cast("date") < F.lit(c), F.col(r).cast("double"))
        cells += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    wide = known.groupBy(*keys).agg(*cells)
    rows = F.array(*[F.struct(F.lit(c).cast("date").alias("cut"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("v")) for i, c in enumerate(cuts)])
    return wide.select(*keys, F.inline(rows)).where("n > 0")


def decayed(r: np.ndarray, betas: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of r*r, r and 1 before each row and after the last one (betas x 3 x rows + 1), from `start` (betas x 3)."""
    x = np.stack([r * r, r, np.ones(len(r))])
    a = np.broadcast_to(betas[:, None, None], (len(betas), _SUMS, len(r)))
    after = affine(a, np.broadcast_to(x, a.shape), start)
    return np.concatenate([start[..., None], after], axis=-1)


def variances(sums: np.ndarray, alpha: np.ndarray, beta: np.ndarray, mean: float, v: float) -> np.ndarray:
    """Variances (candidates x rows) from decayed sums (candidates x 3 x rows); the first of a series is v."""
    u, w, one = sums[:, 0], sums[:, 1], sums[:, 2]
    a, b = alpha[:, None], beta[:, None]
    return (1 - a - b) * v * one + a * (u - 2 * mean * w + mean * mean * one) + (1 - (1 - b) * one) * v


def _carried(chunks: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with their series' fits (`_fits`), its betas and the decayed sums and number of rows before each."""
    series = fits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cut", "mean", "v", "alphas", "betas"))).alias("_fits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("betas")))).alias("_betas"))
    held = chunks.join(series, keys)
    blank = F.array().cast("array<double>")
    if chunks.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0] in (None, 1):  # nothing to carry
        return held.withColumn("_state", blank)
    width = T.ArrayType(T.DoubleType())
    shown = [chunks.schema[k] for k in [*keys, "_chunk"]]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, betas in zip(batch.column("_r").to_pylist(), batch.column("_betas").to_pylist(), strict=True):
                r, betas = np.array(r), np.array(betas)
                out.append([float(len(r)), *(betas ** len(r)), *decayed(r, betas, np.zeros((len(betas), _SUMS)))[..., -1].ravel()])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in shown), pa.array(out, pa.list_(pa.float64()))], names=[*(f.name for f in shown), "_sum"])

    sums = held.select(*keys, "_chunk", "_r", "_betas").mapInArrow(summarise, T.StructType([*shown, T.StructField("_sum", width)]))

    def step(state: Column, x: Column) -> Column:
        own = x["_sum"]
        n = ((F.size(own) - 1) / (1 + _SUMS)).cast("int")
        old = lambda i: F.coalesce(F.get(state, i), F.lit(0.0))
        later = F.transform(F.sequence(F.lit(0), n * _SUMS - 1), lambda i: F.get(own, 1 + F.floor(i / _SUMS).cast("int")) * old(i + 1) + F.get(own, 1 + n + i))
        return F.concat(F.array(old(F.lit(0)) + F.get(own, F.lit(0))), later)

    return held.join(prefix(sums, keys, "_chunk", blank, step, "_state"), [*keys, "_chunk"])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(row, times, returns, betas' places, decayed sums, rows before, fits) of each chunk."""
    for i, (t, r, betas, state, fits) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_t", "_r", "_betas", "_state", "_fits")), strict=True)):
        r, betas = np.array(r), np.array(betas)
        start = np.array(state[1:] if state else np.zeros(len(betas) * _SUMS)).reshape(len(betas), _SUMS)
        days = np.array([x.date() if isinstance(x, dt.datetime) else x for x in t], dtype="datetime64[D]")
        yield i, t, days, r, betas, decayed(r, betas, start)[..., :-1], int(state[0]) if state else 0, fits


def _scored(chunks: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cut, alpha, beta, ll, s2, residual) of each candidate of the fits."""
    kinds = [chunks.schema[k] for k in keys]
    number = T.ArrayType(T.DoubleType())
    fields = T.StructType([*kinds, T.StructField("cut", T.DateType()), T.StructField("alphas", number), T.StructField("betas", number), T.StructField("lls", number), T.StructField("s2s", number), T.StructField("residual", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, rows = [], []
            for i, _, days, r, betas, sums, _, held in _rows(batch):
                for f in held:
                    n = int((days < np.datetime64(f["cut"])).sum())
                    if not n:
                        continue
                    alpha, beta = np.array(f["alphas"]), np.array(f["betas"])
                    s2 = variances(sums[np.searchsorted(betas, beta)][..., :n], alpha, beta, f["mean"], f["v"])
                    e = r[:n] - f["mean"]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        ll = (-0.5 * (np.log(s2) + e * e / s2)).sum(axis=1)
                    places.append(i)
                    rows.append((f["cut"], f["alphas"], f["betas"], ll.tolist(), s2[:, -1].tolist(), float(e[-1])))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            made = [pa.array(c, k) for c, k in zip(columns, (pa.date32(), *[pa.list_(pa.float64())] * 4, pa.float64()), strict=True)]
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), batch.column("_chunk").take(at), *made], names=[*keys, "_chunk", "cut", "alphas", "betas", "lls", "s2s", "residual"])

    found = _carried(chunks, fits, keys).mapInArrow(run, T.StructType([*kinds, chunks.schema["_chunk"], *fields.fields[len(keys) :]]))
    each = found.select(*keys, "_chunk", "cut", "residual", F.inline(F.arrays_zip(F.col("alphas").alias("alpha"), F.col("betas").alias("beta"), F.col("lls").alias("ll"), F.col("s2s").alias("s2"))))
    return each.groupBy(*keys, "cut", "alpha", "beta").agg(F.sum("ll").alias("ll"), F.max_by("s2", "_chunk").alias("s2"), F.max_by("residual", "_chunk").alias("residual"))


def _best(scored: DataFrame, keys: list[str]) -> DataFrame:
    order = F.struct(-F.round("ll", 6), F.col("alpha"), F.col("beta"), F.col("ll"), F.col("s2"), F.col("residual"))
    return scored.where(~F.isnan("ll")).groupBy(*keys, "cut").agg(F.min(order).alias("_b")).select(*keys, "cut", "_b.alpha", "_b.beta", "_b.ll", "_b.s2", "_b.residual")


def around(best: DataFrame, keys: list[str], factors: tuple[tuple[float, ...], tuple[float, ...]]) -> DataFrame:
    """(keys, cut, alphas, betas): candidates around each fit's best point, itself among them."""
    points = F.array(*[F.struct((F.col("alpha") * f).alias("a"), (F.least(1 - (1 - (F.col("alpha") + F.col("beta"))) * g, F.lit(MOST_PERSISTENT)) - F.col("alpha") * f).alias("b")) for f in factors[0] for g in factors[1]])
    held = best.select(*keys, "cut", F.filter(points, lambda p: p["b"] >= 0).alias("_p"))
    return held.select(*keys, "cut", F.col("_p.a").alias("alphas"), F.col("_p.b").alias("betas"))


def fit(returns: DataFrame, keys: list[str], ts: str, r: str, cuts: list[dt.date] | None = None, grid: list[tuple[float, float]] | None = None, rounds: list | None = None, chunk: Column | None = None) -> DataFrame:
    """The GARCH(1,1) of largest likelihood for each series, and for each cut from the returns before it.

    (keys, [cut], alpha, beta, persistence, n, log_likelihood, last_sigma, long_run_sigma, last_residual, mean);
    Bollerslev (1986).  Null returns don't count; a series without returns before a cut has no row.  Each round of
    refinement keeps the best point so far among its candidates, so the likelihood never falls.
    """
    grid, rounds = GRID if grid is None else grid, ROUNDS if rounds is None else rounds
    chunks = chunks_of(returns, keys, ts, r, chunk)
    known = written(moments(returns, keys, ts, r, cuts or [_LAST]), "moments")
    lists = {"alphas": F.array(*[F.lit(a) for a, _ in grid]), "betas": F.array(*[F.lit(b) for _, b in grid])}
    best = written(_best(_scored(chunks, known.withColumns(lists), keys), keys), "garch")
    for factors in rounds:
        best = written(_best(_scored(chunks, known.join(around(best, keys, factors), [*keys, "cut"]), keys), keys), "garch")
    out = best.join(known, [*keys, "cut"]).select(
        *keys, "cut", "alpha", "beta", (F.col("alpha") + F.col("beta")).alias("persistence"), "n", F.col("ll").alias("log_likelihood"), F.sqrt("s2").alias("last_sigma"), F.sqrt("v").alias("long_run_sigma"), F.col("residual").alias("last_residual"), "mean"
    )
    return out if cuts else out.drop("cut")


def filtered(returns: DataFrame, fits: DataFrame, keys: list[str], ts: str, r: str, chunk: Column | None = None) -> DataFrame:
    """(keys, [cut], ts, place, e, sigma, seen): each known return's residual and volatility under each fit of its series.

    `seen` tells the returns before the cut, which the fit knows, from later ones; without cuts all are seen.  Places
    count from 0.  A volatility uses returns before its row only.
    """
    chunks = chunks_of(returns, keys, ts, r, chunk)
    dated = fits if "cut" in fits.columns else fits.withColumn("cut", F.lit(_LAST).cast("date"))
    one = dated.select(*keys, "cut", "mean", (F.col("long_run_sigma") * F.col("long_run_sigma")).alias("v"), F.array("alpha").alias("alphas"), F.array("beta").alias("betas"))
    kinds = [chunks.schema[k] for k in keys]
    fields = [T.StructField("cut", T.DateType()), returns.schema[ts], T.StructField("place", T.LongType()), T.StructField("e", T.DoubleType()), T.StructField("sigma", T.DoubleType()), T.StructField("seen", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = batch.schema.field("_t").type.value_type
            for i, t, days, r, betas, sums, before, held in _rows(batch):
                n = len(r)
                for f in held:
                    alpha, beta = np.array(f["alphas"]), np.array(f["betas"])
                    s2 = variances(sums[np.searchsorted(betas, beta)], alpha, beta, f["mean"], f["v"])[0]
                    own = [batch.column(k).take(pa.array(np.full(n, i))) for k in keys]
                    made = [pa.array([f["cut"]] * n, pa.date32()), pa.array(t, times), pa.array(before + np.arange(n)), pa.array(r - f["mean"]), pa.array(np.sqrt(s2)), pa.array(days < np.datetime64(f["cut"]))]
                    yield pa.RecordBatch.from_arrays([*own, *made], names=[*keys, *(x.name for x in fields)])

    out = _carried(chunks, one, keys).mapInArrow(run, T.StructType([*kinds, *fields]))
    return out if "cut" in fits.columns else out.drop("cut")


def residual_pool(returns: DataFrame, fits: DataFrame, keys: list[str], ts: str, r: str, chunk: Column | None = None) -> DataFrame:
    """(keys, [cut], place, size, z, e): every standardised residual and centred return that a fit knows."""
    by = [*keys, *(["cut"] if "cut" in fits.columns else [])]
    held = filtered(returns, fits, keys, ts, r, chunk).where("seen")
    return held.join(fits.select(*by, F.col("n").cast("long").alias("size")), by).select(*by, "place", "size", (F.col("e") / F.col("sigma")).alias("z"), "e")
