"""Fills with provenance flags, null policy, encodings, filters and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by(keys: list[str], ts: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)


def last_known(c: str, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def ffill(df: DataFrame, columns: list[str], keys: list[str], ts: str, bucket: Column | None = None) -> DataFrame:
    """Each NULL takes the last value before it.

    A task holds one bucket of a series: the last value of each bucket is carried over to the next ones.  `bucket`
    must grow with the time; it is a span of days by default.
    """
    from .scan import last_known as carried

    return carried(df, {c: c for c in columns}, keys, ts, bucket).select(df.columns)


def bfill_leading(df: DataFrame, columns: list[str], keys: list[str], ts: str, suffix: str = "_is_backfilled") -> DataFrame:
    """Leading NULLs take the first value after them, with a flag column each: filled cells use the future.

    Leading rows lie before the time of a series' first value, which is one grouped minimum.
    """
    known = {c: F.when(F.col(c).isNotNull(), F.col(ts)) for c in columns}
    firsts = df.groupBy(*keys).agg(*[x for i, c in enumerate(columns) for x in (F.min(known[c]).alias(f"_from_{i}"), F.min_by(c, known[c]).alias(f"_first_{i}"))])
    held = df.join(firsts, keys) if keys else df.crossJoin(firsts)  # one row
    held = held.withColumns({f"{c}{suffix}": F.coalesce(F.col(ts) < F.col(f"_from_{i}"), F.lit(False)) for i, c in enumerate(columns)})
    held = held.withColumns({c: F.when(F.col(f"{c}{suffix}"), F.col(f"_first_{i}")).otherwise(F.col(c)) for i, c in enumerate(columns)})
    return held.select(*df.columns, *[f"{c}{suffix}" for c in columns if f"{c}{suffix}" not in df.columns])


def known_rows(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag isn't set."""
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def fill_constant(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.fillna(values)


def complete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without NULL in the columns (all columns if none are named)."""
    return df.dropna(subset=columns) if columns else df.dropna()


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    """Those wanted columns that the table has, in the wanted order."""
    held = set(df.columns)
    return [c for c in wanted if c in held]


def numeric_features(df: DataFrame, leave_out: list[str]) -> DataFrame:
    """Without the named columns and without those that aren't numbers."""
    return df.select([f.name for f in df.schema if f.name not in leave_out and isinstance(f.dataType, T.NumericType)])


def between(df: DataFrame, ts: str, start, end) -> DataFrame:
    return df.where(F.col(ts).between(F.lit(start), F.lit(end)))


def split_at(df: DataFrame, ts: str, cut) -> tuple[DataFrame, DataFrame]:
    """Rows up to the cut, and after it."""
    at = F.lit(cut).cast(df.schema[ts].dataType)
    return df.where(F.col(ts) <= at), df.where(F.col(ts) > at)


def masked_label(rules: list[tuple[Column, int]]) -> Column:
    """The value of the first rule that holds, else NULL."""
    out = F.when(rules[0][0], rules[0][1])
    for rule, value in rules[1:]:
        out = out.when(rule, value)
    return out
