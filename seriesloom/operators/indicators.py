"""Technical indicators as columns over daily bars (open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import annualised, gain, loss, safe_divide
from .clean import by
from .scan import ema, lagged
from .windows import lag, log_return, rolling


def returns_and_range(df: DataFrame, keys: list[str], ts: str, windows: tuple[int, ...] = (3, 7, 14, 30, 60, 90)) -> DataFrame:
    """Log returns, volatility of daily returns, drawdown and place in the channel for each window."""
    w = by(keys, ts)
    df = df.withColumn("log_return", log_return("close", 1, w))
    high = {n: rolling("close", n, w, "max") for n in windows}
    low = {n: rolling("close", n, w, "min") for n in windows}
    out = {f"log_return_{n}d": log_return("close", n, w) for n in windows}
    out |= {f"volatility_{n}d": rolling("log_return", n, w, "std") for n in windows}
    out |= {f"drawdown_{n}d": safe_divide("close", high[n]) - 1 for n in windows}
    out |= {f"channel_pos_{n}d": safe_divide(F.col("close") - low[n], high[n] - low[n]) for n in windows}
    return df.withColumns(out)


def ema_features(df: DataFrame, keys: list[str], ts: str, spans: tuple[int, ...] = (5, 8, 13, 21, 50, 100, 200)) -> DataFrame:
    """Averages of the close, distance of the close from each, and each one's slope."""
    df = ema(df, keys, ts, {f"ema_{n}": ("close", 2 / (n + 1), n) for n in spans})
    df = lagged(df, {f"_ema_{n}": f"ema_{n}" for n in spans}, keys, ts)
    slopes = {f"ema_slope_{n}": safe_divide(f"ema_{n}", f"_ema_{n}") - 1 for n in spans}
    return df.withColumns({f"ema_distance_{n}": safe_divide("close", f"ema_{n}") - 1 for n in spans} | slopes).drop(*[f"_ema_{n}" for n in spans])


def rsi(df: DataFrame, keys: list[str], ts: str, windows: tuple[int, ...] = (7, 14, 21, 28)) -> DataFrame:
    """Relative strength by Wilder's smoothing; NULL where there was no loss."""
    df = lagged(df, {"_before": "close"}, keys, ts).withColumn("_d", F.col("close") - F.col("_before")).drop("_before")
    df = df.withColumns({"_g": gain("_d"), "_l": loss("_d")})
    specs = {f"_{c}_{n}": (f"_{c}", 1 / n, n) for n in windows for c in ("g", "l")}
    df = ema(df, keys, ts, specs)
    df = df.withColumns({f"rsi_{n}": 100 - 100 / (1 + safe_divide(f"_g_{n}", f"_l_{n}")) for n in windows})
    return df.withColumns({f"rsi_distance50_{n}": F.col(f"rsi_{n}") - 50 for n in windows}).drop("_d", "_g", "_l", *specs)


def macd(df: DataFrame, keys: list[str], ts: str, settings: tuple[tuple[int, int, int], ...] = ((12, 26, 9), (5, 35, 5))) -> DataFrame:
    """Difference of two averages, its signal line, their difference, and that over the close for each setting."""
    spans = sorted({n for f, s, _ in settings for n in (f, s)})
    df = ema(df, keys, ts, {f"_e{n}": ("close", 2 / (n + 1), 1) for n in spans})
    names = {x: "_".join(map(str, x)) for x in settings}
    df = df.withColumns({f"macd_{names[f, s, g]}": F.col(f"_e{f}") - F.col(f"_e{s}") for f, s, g in settings})
    df = ema(df, keys, ts, {f"macd_signal_{names[f, s, g]}": (f"macd_{names[f, s, g]}", 2 / (g + 1), 1) for f, s, g in settings})
    for x in settings:
        n = names[x]
        df = df.withColumn(f"macd_gap_{n}", F.col(f"macd_{n}") - F.col(f"macd_signal_{n}")).withColumn(f"macd_hist_{n}", safe_divide(f"macd_gap_{n}", "close"))
    return df.drop(*[f"_e{n}" for n in spans])


def bollinger(df: DataFrame, keys: list[str], ts: str, windows: tuple[int, ...] = (14, 20, 30)) -> DataFrame:
    """Middle, upper and lower band at two deviations, place in the band and its width."""
    w = by(keys, ts)
    for n in windows:
        df = df.withColumns({f"bb_mid_{n}": rolling("close", n, w, "mean"), "_s": rolling("close", n, w, "std")})
        df = df.withColumns({f"bb_upper_{n}": F.col(f"bb_mid_{n}") + 2 * F.col("_s"), f"bb_lower_{n}": F.col(f"bb_mid_{n}") - 2 * F.col("_s")}).drop("_s")
        span = F.col(f"bb_upper_{n}") - F.col(f"bb_lower_{n}")
        df = df.withColumns({f"bb_percent_b_{n}": safe_divide(F.col("close") - F.col(f"bb_lower_{n}"), span), f"bb_width_{n}": safe_divide(span, f"bb_mid_{n}")})
    return df


def true_range(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The largest of the day's range and its distances from the last close; the first day has its range alone."""
    last = F.col("_before")
    df = lagged(df, {"_before": "close"}, keys, ts)
    return df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))).drop("_before")


def atr(df: DataFrame, keys: list[str], ts: str, windows: tuple[int, ...] = (7, 14, 21)) -> DataFrame:
    df = ema(true_range(df, keys, ts), keys, ts, {f"atr_{n}": ("true_range", 1 / n, n) for n in windows})
    return df.withColumns({f"atr_norm_{n}": safe_divide(f"atr_{n}", "close") for n in windows})


def candles(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return df.withColumns(
        {
            "candle_range_pct": safe_divide(F.col("high") - F.col("low"), "close"),
            "candle_body_pct": safe_divide(F.col("close") - F.col("open"), "open"),
            "candle_close_location": safe_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
            "candle_gap_pct": safe_divide("open", lag("close", 1, by(keys, ts))) - 1,
        }
    )


def realised_volatility(df: DataFrame, keys: list[str], ts: str, short: int = 14, long: int = 30) -> DataFrame:
    """Rolling deviation of daily returns: plain, weekly (times root 7) and annualised in percent."""
    w = by(keys, ts)
    df = df.withColumn("log_return", log_return("close", 1, w))
    return df.withColumns(
        {
            f"realized_vol_{short}": annualised(rolling("log_return", short, w, "std")),
            f"realized_vol_{long}": annualised(rolling("log_return", long, w, "std")),
            "weekly_vol": rolling("log_return", 7, w, "std") * F.sqrt(F.lit(7.0)),
        }
    )
