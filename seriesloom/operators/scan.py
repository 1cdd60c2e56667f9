"""Scans over each series in chunks: summaries, their prefix, and a replay of each chunk from what came before.

Keys are not NULL.  A scan needs an associative step: a chunk's effect on the state before it fits into a short summary.  Rows are dealt
to chunks by time, summaries (a row for each chunk) are combined series by series without the rows, and each chunk is
replayed from its own state.  So no task sorts or holds a series, and no window runs over one.

`fold_chunks` runs numeric scans (affine maps, exponential averages) on Arrow batches; `prefix` combines summaries of
any type in built-in functions (last known values, counts, row numbers).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written

#: Days in a chunk: dated series have a row a day at most, others may have many.
DATED_DAYS, TIMED_DAYS = 8_192, 32
SHORT = 16_384


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each element of an array, from `start`.

    Blocks of about the square root of the array's size are folded one by one, so an append copies a block at
    most and the work stays near linear.
    """
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / block).cast("int") - 1), lambda i: F.slice(values, i * block + 1, block))
    last = lambda states: F.element_at(states, -1)
    inner = lambda state, own: F.aggregate(own, F.array(state), lambda out, x: F.array_append(out, step(last(out), x)))
    states = F.aggregate(blocks, F.array(F.array(start)), lambda out, own: F.array_append(out, F.slice(inner(last(last(out)), own), F.lit(2), F.size(own))))
    return F.slice(F.flatten(states), F.lit(2), F.size(values))


def span_of(df: DataFrame, ts: str) -> Column:
    days = DATED_DAYS if isinstance(df.schema[ts].dataType, T.DateType) else TIMED_DAYS
    return F.floor(F.unix_date(F.col(ts).cast("date")) / days).cast("long")


def prefix(summaries: DataFrame, keys: list[str], chunk: str, start: Column, step: Callable[[Column, Column], Column], name: str = "_carry") -> DataFrame:
    """(keys, chunk, state before it) from one row for each chunk; `step` takes the state and a chunk's row."""
    row = F.struct(chunk, *[c for c in summaries.columns if c not in (*keys, chunk)])
    series = summaries.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_all"))
    before = F.concat(F.array(start), running(F.col("_all"), start, step))
    pairs = F.zip_with("_all", F.slice(before, F.lit(1), F.size("_all")), lambda x, s: F.struct(x[chunk].alias(chunk), s.alias(name)))
    return series.select(*keys, F.inline(pairs))


# -- built-in scans --------------------------------------------------------------------------------
def last_known(df: DataFrame, columns: dict[str, str], keys: list[str], ts: str, chunk: Column | None = None, strict: bool = False) -> DataFrame:
    """`df` with a column for each (name, source): the source's last value that isn't NULL up to each row.

    `strict` takes the rows before the row itself only.
    """
    placed = df.withColumn("_chunk", span_of(df, ts) if chunk is None else chunk)
    sources = sorted(set(columns.values()))
    sums = placed.groupBy(*keys, "_chunk").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_last_{i}") for i, c in enumerate(sources)])
    types = {c: df.schema[c].dataType for c in sources}
    start = F.struct(*[F.lit(None).cast(types[c]).alias(f"_last_{i}") for i, c in enumerate(sources)])
    step = lambda s, x: F.struct(*[F.coalesce(x[f"_last_{i}"], s[f"_last_{i}"]).alias(f"_last_{i}") for i in range(len(sources))])
    carried = prefix(sums, keys, "_chunk", start, step)
    w = Window.partitionBy(*keys, "_chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    local = placed.withColumns({f"_own_{name}": F.last(c, ignorenulls=True).over(w) for name, c in columns.items()}).join(carried, [*keys, "_chunk"])
    found = {name: F.coalesce(f"_own_{name}", F.col(f"_carry._last_{sources.index(c)}")) for name, c in columns.items()}
    kept = [c for c in df.columns if c not in columns]
    return local.select(*kept, *[v.alias(n) for n, v in found.items()])


def lagged(df: DataFrame, columns: dict[str, str], keys: list[str], ts: str, chunk: Column | None = None) -> DataFrame:
    """`df` with a column for each (name, source): the source in the row before, NULL in a series' first row."""
    boxed = df.withColumns({f"_box_{n}": F.struct(F.col(c).alias("v")) for n, c in columns.items()})
    found = last_known(boxed, {f"_at_{n}": f"_box_{n}" for n in columns}, keys, ts, chunk, strict=True)
    return found.select(*df.columns, *[F.col(f"_at_{n}.v").alias(n) for n in columns])


def row_numbers(df: DataFrame, keys: list[str], ts: str, chunk: Column | None = None, name: str = "rn", size: str | None = "n") -> DataFrame:
    """`df` with each row's place in its series from 0, and the series' length."""
    placed = df.withColumn("_chunk", span_of(df, ts) if chunk is None else chunk)
    counts = placed.groupBy(*keys, "_chunk").agg(F.count("*").alias("_m"))
    carried = prefix(counts, keys, "_chunk", F.lit(0).cast("long"), lambda s, x: s + x["_m"])
    if size:
        carried = carried.join(counts.groupBy(*keys).agg(F.sum("_m").alias(size)), keys)
    own = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(ts)) - 1
    numbered = placed.withColumn("_own", own).join(carried, [*keys, "_chunk"]).withColumn(name, (F.col("_carry") + F.col("_own")).cast("long"))
    return numbered.select(*df.columns, name, *([size] if size else []))


# -- numeric scans ---------------------------------------------------------------------------------
def affine(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """States of e = a e' + b along the last axis, from `start`.

    Up to SHORT they are stepped one by one; beyond, rows of about the square root of the length are stepped side by
    side, then chained.
    """
    n = a.shape[-1]
    if not n:
        return np.zeros(a.shape)
    if n <= SHORT and a.ndim == 1:
        return np.fromiter(accumulate(zip(a.tolist(), b.tolist(), strict=True), lambda e, m: m[0] * e + m[1], initial=float(start)), float, n + 1)[1:]
    if n <= SHORT:
        out, e = np.empty(a.shape), np.asarray(start, dtype=float)
        for t in range(n):
            e = out[..., t] = a[..., t] * e + b[..., t]
        return out
    width = math.isqrt(n - 1) + 1
    rows = -(-n // width)
    shape = (*a.shape[:-1], rows, width)
    pad = [(0, 0)] * (a.ndim - 1) + [(0, rows * width - n)]
    a, b = np.pad(a, pad, constant_values=1.0).reshape(shape), np.pad(b, pad).reshape(shape)
    made, factor = np.empty(shape), np.empty(shape)
    e, p = np.zeros(shape[:-1]), np.ones(shape[:-1])
    for j in range(width):
        e = a[..., j] * e + b[..., j]
        p = p * a[..., j]
        made[..., j], factor[..., j] = e, p
    carry = np.empty(shape[:-1])
    state = np.broadcast_to(np.asarray(start, dtype=float), shape[:-2]).copy()
    for i in range(rows):
        carry[..., i] = state
        state = factor[..., i, -1] * state + made[..., i, -1]
    return (made + factor * carry[..., None]).reshape(*shape[:-2], -1)[..., :n]


def _numbers(table: pa.Table, names: list[str]) -> np.ndarray:
    """Columns as rows of a matrix of doubles, NULL as NaN."""
    return np.stack([pc.cast(table.column(c), pa.float64()).to_numpy() for c in names]) if names else np.zeros((0, table.num_rows))


def fold_chunks(
    df: DataFrame, keys: list[str], ts: str, inputs: dict[str, Column], outputs: list[str], chunk: Column | None,
    summary: Callable[[np.ndarray], np.ndarray], start: np.ndarray, step: Callable[[np.ndarray, np.ndarray], np.ndarray], replay: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> DataFrame:
    """`df` with the columns `outputs` of a scan over `inputs`, by chunks.

    `summary` maps a chunk's inputs (a row each, in order of time) to numbers, `step` a state and a summary to the next
    state, `replay` inputs and the state before them to the outputs, a row each, NaN for NULL.  `chunk` must grow with
    the time.  Times are unique within a series.
    """
    names = [f"_x{i}" for i in range(len(inputs))]
    placed = written(df.withColumns({"_chunk": span_of(df, ts) if chunk is None else chunk.cast("long")} | {n: c.cast("double") for n, c in zip(names, inputs.values(), strict=True)}), "scan")
    held = T.StructType([placed.schema[k] for k in [*keys, "_chunk"]])

    def ordered(table: pa.Table) -> pa.Table:
        return table.take(pc.sort_indices(table.column(ts)))

    def head(table: pa.Table) -> list:
        return [table.column(k).combine_chunks().slice(0, 1) for k in [*keys, "_chunk"]]

    def summarise(table: pa.Table) -> pa.Table:
        table = ordered(table)
        return pa.table([*head(table), pa.array([summary(_numbers(table, names)).tolist()], pa.list_(pa.float64()))], names=[*keys, "_chunk", "_sum"])

    def combine(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("_chunk")))
        states, now = [], start
        for s in table.column("_sum").to_pylist():
            states.append(now.tolist())
            now = step(now, np.array(s))
        return table.drop_columns(["_sum"]).append_column("_state", pa.array(states, pa.list_(pa.float64())))

    own = df.columns
    wanted = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in outputs]])

    def replayed(table: pa.Table, state: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select(own)
        table = ordered(table)
        made = replay(_numbers(table, names), np.array(state.column("_state")[0].as_py()))
        out = table.select(own)
        for n, row in zip(outputs, made, strict=True):
            out = out.append_column(n, pa.array(row, pa.float64(), from_pandas=True))
        return out

    number = T.ArrayType(T.DoubleType())
    sums = placed.select(*keys, "_chunk", ts, *names).groupBy(*keys, "_chunk").applyInArrow(summarise, T.StructType([*held.fields, T.StructField("_sum", number)]))
    states = sums.groupBy(*keys).applyInArrow(combine, T.StructType([*held.fields, T.StructField("_state", number)]))
    return placed.groupBy(*keys, "_chunk").cogroup(states.groupBy(*keys, "_chunk")).applyInArrow(replayed, wanted)


def affine_scan(df: DataFrame, keys: list[str], ts: str, maps: dict[str, tuple[Column, Column]], chunk: Column | None = None) -> DataFrame:
    """`df` with a column for each (a, b) in `maps`: e = a e' + b over a series; before its first row, e is 0."""
    n = len(maps)
    inputs = {f"a{i}": a for i, (a, _) in enumerate(maps.values())} | {f"b{i}": b for i, (_, b) in enumerate(maps.values())}

    def summary(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x[:n].prod(axis=1), affine(x[:n], x[n:], np.zeros(n))[:, -1]])

    return fold_chunks(df, keys, ts, inputs, list(maps), chunk, summary, np.zeros(n), lambda s, m: m[:n] * s + m[n:], lambda x, s: affine(x[:n], x[n:], s))


class _Average:
    """An exponential average over known values; a gap decays what came before it."""

    width = 7  # rows, known ones, unknown ones before and after these, first value, and the map of the others

    def __init__(self, alpha: float, least: int):
        self.alpha, self.least = alpha, max(1, least)

    def maps(self, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = (1.0 - self.alpha) ** np.diff(at)
        return kept / (kept + self.alpha), self.alpha * v[at[1:]] / (kept + self.alpha)

    def summary(self, v: np.ndarray) -> list[float]:
        at = np.flatnonzero(~np.isnan(v))
        if not len(at):
            return [len(v), 0, 0, 0, 0, 1, 0]
        a, b = self.maps(v, at)
        return [len(v), len(at), at[0], len(v) - 1 - at[-1], v[at[0]], a.prod(), affine(a, b, 0.0)[-1] if len(a) else 0.0]

    def first(self, state: np.ndarray, lead: float, value: float) -> float:
        average, since, seen = state
        if not seen:
            return value
        kept = (1.0 - self.alpha) ** (since + lead + 1)
        return (kept * average + self.alpha * value) / (kept + self.alpha)

    def step(self, state: np.ndarray, s: np.ndarray) -> list[float]:
        average, since, seen = state
        rows, known, lead, trail, value, a, b = s
        if not known:
            return [average, since + rows, seen]
        return [a * self.first(state, lead, value) + b, trail, seen + known]

    def replay(self, v: np.ndarray, state: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(~np.isnan(v))
        begun = np.cumsum(~np.isnan(v))
        path = np.array([state[0]])
        if len(at):
            first = self.first(state, at[0], v[at[0]])
            path = np.concatenate([path, [first], affine(*self.maps(v, at), first)])
        return np.where(state[2] + begun >= self.least, path[begun], np.nan)


def ema(df: DataFrame, keys: list[str], ts: str, specs: dict[str, tuple[str, float, int]], chunk: Column | None = None) -> DataFrame:
    """Exponential averages: name -> (value column, alpha, least number of values before a result).

    The recursion starts at a series' first value.  A missing value keeps the average; the next value then
    weighs against the past decayed over the gap.  Results are NULL until enough values are seen.
    """
    sources = sorted({v for v, _, _ in specs.values()})
    made = [(sources.index(v), _Average(alpha, least)) for v, alpha, least in specs.values()]
    parts = lambda s, width: s.reshape(-1, width)

    def summary(x: np.ndarray) -> np.ndarray:
        return np.array([m.summary(x[i]) for i, m in made], dtype=float).ravel()

    def step(state: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.array([m.step(a, b) for (_, m), a, b in zip(made, parts(state, 3), parts(s, _Average.width), strict=True)], dtype=float).ravel()

    def replay(x: np.ndarray, state: np.ndarray) -> np.ndarray:
        return np.stack([m.replay(x[i], s) for (i, m), s in zip(made, parts(state, 3), strict=True)])

    kept = [c for c in df.columns if c not in specs]
    return fold_chunks(df.select(kept), keys, ts, {v: F.col(v) for v in sources}, list(specs), chunk, summary, np.zeros(3 * len(made)), step, replay)
