"""Scalar expressions: NULL stands for a missing number, and nothing raises on zero or on a negative logarithm."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def positive(c: str | Column) -> Column:
    """The value if above zero, else NULL."""
    return F.when(col(c) > 0, col(c))


def log(c: str | Column) -> Column:
    """Natural logarithm, NULL at zero and below."""
    return F.ln(positive(c))


def gain(c: str | Column) -> Column:
    return F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(0.0)))


def loss(c: str | Column) -> Column:
    return F.when(col(c).isNotNull(), F.greatest(0.0 - col(c), F.lit(0.0)))


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def ordinal(c: str | Column, levels: list[str]) -> Column:
    """Place of a label in `levels`; unknown labels are NULL."""
    pairs = [F.lit(x) for i, level in enumerate(levels) for x in (level, i)]
    return F.try_element_at(F.create_map(*pairs), col(c))


def flag(c: str | Column) -> Column:
    return col(c).cast("boolean").cast("int")


def cyclic(phase: str | Column) -> tuple[Column, Column]:
    """Sine and cosine of a phase from 0 to 1."""
    turn = 2 * F.pi() * col(phase)
    return F.sin(turn), F.cos(turn)


def softmax(logits: str | Column) -> Column:
    """Softmax of an array, shifted by its largest element."""
    top = F.array_max(col(logits))
    powers = F.transform(col(logits), lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def sign_label(c: str | Column) -> Column:
    """negative, neutral or positive; NULL stays NULL."""
    x = col(c)
    return F.when(x < 0, "negative").when(x > 0, "positive").when(x == 0, "neutral")


def mentions(text: str | Column, words: list[str]) -> Column:
    """Whether any of the words occurs as a whole word, in either case."""
    return col(text).rlike(r"(?i)\b(" + "|".join(words) + r")\b")


def map_get(m: str | Column, key, default=0) -> Column:
    return F.coalesce(F.try_element_at(col(m), F.lit(key)), F.lit(default))


def percent_of(c: str | Column, base: str | Column) -> Column:
    return 100 * safe_divide(c, base)


def mean_of(columns: list[str]) -> Column:
    """Row-wise mean over columns; NULL if one is."""
    return reduce(lambda a, b: a + b, map(F.col, columns)) / len(columns)


def max_of(columns: list[str | Column]) -> Column:
    """Row-wise maximum; NULLs are left out."""
    return F.greatest(*map(col, columns))


def epoch_to_timestamp(c: str | Column) -> Column:
    """UTC timestamp of epoch seconds."""
    return F.timestamp_seconds(col(c))


def annualised(c: str | Column, periods: int = 365) -> Column:
    return col(c) * F.sqrt(F.lit(float(periods))) * 100


def log_return_label(c: str | Column, limit: str | Column) -> Column:
    """1 above the limit, 0 below its negative, else NULL."""
    return F.when(col(c) > col(limit), 1).when(col(c) < -col(limit), 0)
