"""Bars and text totals over streams: the same aggregations as in batch, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_bars(events: DataFrame, keys: list[str], ts: str, price: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and count of each window; a bar is final once the watermark has passed its end.

    Rows that come later than `late` behind the newest one are left out, as with any append-mode window.
    """
    bars = events.withWatermark(ts, late).groupBy(*keys, F.window(ts, width).alias("w"))
    out = bars.agg(F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.count("*").alias("volume"))
    return out.select(*keys, F.col("w.start").alias("bin"), "open", "high", "low", "close", "volume")


def live_sentiment(articles: DataFrame, published: str, score: str, positive_over: float = 0.7, late: str = "1 day") -> DataFrame:
    """Daily totals of article scores; articles without a publication time never enter a day."""
    s = F.col(score)
    days = articles.where(F.col(published).isNotNull()).withWatermark(published, late).groupBy(F.window(published, "1 day").alias("w"))
    return days.agg(
        F.sum(F.when(s > positive_over, s).otherwise(0.0)).alias("positive_total"), F.sum(F.when(s < 0, -s).otherwise(0.0)).alias("negative_total"), F.count("*").alias("volume")
    ).select(F.to_date("w.start").alias("date"), "positive_total", "negative_total", "volume")
