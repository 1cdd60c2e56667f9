"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow trees are fitted to a bounded sample of labelled rows; every path of theirs is a rule, a conjunction
of bounds on statistics.  A lasso logistic regression over the rules keeps few of them, and what is left is
one Spark column expression, which scores any table without the models.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, free_name, least_hashed, ship, slices

STATISTICS = [
    "log_words", "word_length", "distinct_share", "top_word_share", "repeat_share", "repeat_line_share", "words_per_line", "capital_share",
    "capital_word_share", "digit_share", "symbol_rate", "exclamation_rate", "bar_rate", "stop_rate", "comma_rate", "other_mark_rate",
    "high_byte_share", "byte_entropy", "ended_line_share",
]
_CAPITALS, _DIGITS = np.zeros(256, bool), np.zeros(256, bool)
_CAPITALS[65:91], _DIGITS[48:58] = True, True
_SYMBOLS, _OTHER = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&<>~^=_\\{}[]@")] = True
_OTHER[list(b":;?\"'()-/")] = True


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS for one whole text; null counts as empty, whose values are all 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    visible = count.sum() - count[[9, 10, 11, 12, 13, 32]].sum()
    coded = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    _, of_word = np.unique(coded, return_counts=True)
    repeated = 0
    if n > 5:
        grams = coded[:-4].copy()
        for k in range(1, 5):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + coded[k : n - 4 + k]
        _, back, of_gram = np.unique(grams, return_inverse=True, return_counts=True)
        covered = np.zeros(n + 1, dtype=np.int64)
        twice = np.flatnonzero(of_gram[back] > 1)
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 5, -1)
        repeated = int((np.cumsum(covered) > 0).sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = count[count > 0] / len(data)
    return [
        math.log1p(n), float(visible) / n, len(of_word) / n, int(of_word.max()) / n, repeated / n, 1 - len(set(lines)) / len(lines), n / len(lines),
        float(count[_CAPITALS].sum()) / visible, sum(w[:3].isupper() for w in words) / n, float(count[_DIGITS].sum()) / visible, float(count[_SYMBOLS].sum()) / n,
        float(count[33]) / n, float(count[124]) / n, float(count[46]) / n, float(count[44]) / n, float(count[_OTHER].sum()) / n,
        float(count[128:].sum()) / visible, float(-(share * np.log2(share)).sum()), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics_column(texts: pa.Array) -> pa.Array:
    out: list[list[float]] = []
    for part in slices(pa.record_batch([texts], names=["text"]), "text"):
        out += map(statistics, part.column("text").to_pylist())
    return pa.array(out, pa.list_(pa.float64()))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is an upper bound, bound), sorted


def rules_of(description: str) -> list[Rule]:
    """All paths from a root to a node in the printed form of Spark's trees, each once."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, bool, float]] = []
    for line in description.splitlines():
        if line.strip().startswith("Tree "):
            path = []
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[3] < depth] + [(int(m[2]), m[3] == "<=", float(m[4]), depth)]
        tight: dict[tuple[int, bool], float] = {}
        for feature, upper, bound, _ in path:
            held = tight.get((feature, upper))
            tight[feature, upper] = bound if held is None else (min if upper else max)(held, bound)
        found[tuple(sorted((f, u, b) for (f, u), b in tight.items()))] = None
    return list(found)


def compile_rule(rule: Rule, columns: list[str]) -> Column:
    held = F.lit(True)
    for feature, upper, bound in rule:
        held = held & ((F.col(columns[feature]) <= bound) if upper else (F.col(columns[feature]) > bound))
    return held


@dataclass
class RuleModel:
    """Intercept and weighted rules; `score` is a column expression over columns named by STATISTICS' order."""

    intercept: float
    weights: list[tuple[Rule, float]]

    def score(self, columns: list[str]) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.weights:
            total = total + F.when(compile_rule(rule, columns), float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def __str__(self) -> str:
        text = lambda rule: " and ".join(f"{STATISTICS[f]} {'<=' if u else '>'} {b:.4g}" for f, u, b in rule)
        return "\n".join([f"{self.intercept:+.3f}", *(f"{w:+.3f} if {text(r)}" for r, w in self.weights)])


def held_out(id: str = "doc_id") -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Fits the ensemble to at most `sample_rows` labelled rows, those with the least hash of their id.

    `labels` has doc_id and quality (0 or 1; other values and nulls are left out); held-out ids are never
    used.  With one class only, or fewer than 20 rows, the model is the smoothed share of ones.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    ship(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("double").alias("label"))
    sample = least_hashed(known, ["doc_id", "label"], sample_rows)
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # at most sample_rows ids
    rows = cut(joined.select("label", statistics_column("text").alias("held")).repartition(4), "training")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).collect()[0]
    if n < 20 or ones in (0, n):
        return RuleModel(math.log((ones + 1) / (n - ones + 1)), [])
    train = rows.select("label", array_to_vector("held").alias("features"), "held").persist()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="onethird", maxBins=64, seed=seed).fit(train)
    rules = rules_of(forest.toDebugString)
    if not rules:
        return RuleModel(math.log((ones + 1) / (n - ones + 1)), [])
    columns = [f"s{i}" for i in range(len(STATISTICS))]
    wide = train.select("label", *[F.get("held", i).alias(c) for i, c in enumerate(columns)])
    coded = wide.select("label", array_to_vector(F.array(*[compile_rule(r, columns).cast("double") for r in rules])).alias("features")).persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100).fit(coded)
    train.unpersist()
    coded.unpersist()
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w != 0]
    return RuleModel(float(lasso.intercept), kept)


def with_score(docs: DataFrame, model: RuleModel, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with each whole text's score from 0 to 1; null texts are scored as empty ones.

    Repeated rows are scored each.  If `docs` has a column of the new name, that one keeps it.
    """
    ship(docs.sparkSession)
    held = free_name(docs, "statistics")
    columns = [free_name(docs, f"statistic_{i}") for i in range(len(STATISTICS))]
    wide = docs.withColumn(held, statistics_column(F.col(text).cast("string")))
    wide = wide.withColumns({c: F.get(held, i) for i, c in enumerate(columns)})
    return wide.withColumn(free_name(docs, name), model.score(columns)).drop(held, *columns)


def quality_report(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted for each row; held_out of a null id is false."""
    model = fit(docs, labels, sample_rows)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """The rows of `docs` whose score is at least 0.5, with their columns as they are, in a written table: so the
    texts pass through the workers in small batches."""
    model = fit(docs, labels, sample_rows)
    name = free_name(docs, "score")
    return cut(with_score(docs, model).where(F.col(name) >= 0.5).select(docs.columns), "accepted")
