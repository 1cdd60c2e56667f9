"""Resampling, regular spines, calendar and event-cycle features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import ffill

MEAN_CYCLE_DAYS = 1458  # fixed value: mean distance of the reference events


def first_known(c: str, ts: str) -> Column:
    """First non-NULL value of a group in time order, whatever order rows come in."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts)))


def hour_bin(ts: str) -> Column:
    return F.date_trunc("hour", ts)


def week_ending_monday(ts: str) -> Column:
    """The Monday that ends the week a timestamp lies in; a Monday ends its own week."""
    return F.next_day(F.date_sub(F.to_date(ts), 1), "Mon")


def month_end(ts: str) -> Column:
    return F.last_day(ts)


def resample_first(df: DataFrame, keys: list[str], ts: str, columns: list[str], bin: Column, name: str = "bin") -> DataFrame:
    """First non-NULL value of each column in each bin."""
    return df.groupBy(*keys, bin.alias(name)).agg(*[first_known(c, ts).alias(c) for c in columns])


def ohlcv(df: DataFrame, keys: list[str], order: str, price: str, bin: Column, name: str = "date") -> DataFrame:
    """Open, high, low, close and row count of a price in each bin."""
    return df.groupBy(*keys, bin.alias(name)).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("volume")
    )


def roll_up(bars: DataFrame, keys: list[str], ts: str, bin: Column, name: str) -> DataFrame:
    """OHLCV bars to coarser ones: first, max, min, last, sum."""
    return bars.groupBy(*keys, bin.alias(name)).agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume")
    )


def spine(df: DataFrame, keys: list[str], ts: str, step: str = "interval 1 day") -> DataFrame:
    """Every step between each series' first and last time."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    return ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(step))).alias(ts))


def on_spine(df: DataFrame, keys: list[str], ts: str, step: str = "interval 1 day") -> DataFrame:
    """`df` with its missing times as rows of NULLs. One row for each time is expected."""
    return spine(df, keys, ts, step).join(df, [*keys, ts], "left")


def regular_bars(bars: DataFrame, keys: list[str], ts: str = "date") -> DataFrame:
    """Daily bars without gaps: prices carried forward, volume 0 on days without trade."""
    full = ffill(on_spine(bars, keys, ts), ["open", "high", "low", "close"], keys, ts)
    return full.fillna({"volume": 0})


def expand_daily(low: DataFrame, days: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """A low-frequency table on a daily spine, values carried forward."""
    return ffill(days.join(low, [*keys, ts], "left"), columns, keys, ts)


def calendar_features(df: DataFrame, ts: str, hourly: bool = False) -> DataFrame:
    """Monday is 0; the hourly form has hour, year, day of month and ISO week as well."""
    parts = {"dayofweek": F.weekday(ts), "month": F.month(ts), "quarter": F.quarter(ts), "dayofyear": F.dayofyear(ts)}
    if hourly:
        parts |= {"hour": F.hour(ts), "year": F.year(ts), "dayofmonth": F.dayofmonth(ts), "weekofyear": F.weekofyear(ts)}
    return df.withColumns(parts)


def project_events(events: DataFrame, date: str, cycle_days: int = MEAN_CYCLE_DAYS) -> DataFrame:
    """Known events and one projected from the last, flagged."""
    last = events.agg(F.date_add(F.max(date), cycle_days).alias(date)).where(F.col(date).isNotNull())
    return events.select(date, F.lit(False).alias("is_projected")).union(last.select(date, F.lit(True)))


def event_cycle(df: DataFrame, keys: list[str], ts: str, events: DataFrame, date: str, cycle_days: int = MEAN_CYCLE_DAYS) -> DataFrame:
    """Days since the last and until the next event, phase of the cycle and its sine and cosine.

    Events are few (a calendar of dates), so their gaps are one small table, joined to each day by its range's
    days: an equi-join, not a range join.
    """
    w = Window.orderBy(date)  # over the event calendar only
    gaps = project_events(events.select(date).distinct(), date, cycle_days).withColumn("_next", F.lead(date).over(w)).withColumn("next_is_projected", F.lead("is_projected").over(w))
    gaps = gaps.where("_next is not null").select(F.col(date).alias("_last"), "_next", "next_is_projected")
    days = gaps.withColumn(ts, F.explode(F.sequence("_last", F.date_sub("_next", 1), F.expr("interval 1 day"))))
    out = df.join(days, ts, "left")
    since, until = F.datediff(ts, "_last"), F.datediff("_next", ts)
    phase = since / (since + until)
    turn = 2 * F.pi() * phase
    return out.withColumns({"days_since_last": since, "days_until_next": until, "cycle_phase": phase, "phase_sin": F.sin(turn), "phase_cos": F.cos(turn)}).drop("_last", "_next")
