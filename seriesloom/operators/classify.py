"""Direction classifiers: weighted base learners tuned on purged folds, averaged and stacked.

Spark ML fits each model over all training rows; folds and candidates are few and are fitted together from one
written table.  Predictions of all models are rows of one long table (row keys, model, score).
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .fits import together
from .metrics import auc


def with_class_weights(df: DataFrame, label: str, within: Column) -> DataFrame:
    """`weight`: n over (classes times the class's rows), counted where `within` holds."""
    counts = df.where(within & F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    total = Window.partitionBy()
    sized = counts.select(label, (F.sum("_n").over(total) / (F.count("*").over(total) * F.col("_n"))).alias("weight"))  # a row for each class
    return df.join(F.broadcast(sized), label, "left")


def positive_rate(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    p = F.avg(F.col(label).cast("double"))
    return df.groupBy(*keys).agg(p.alias("positive_rate"), F.try_divide(1 - p, p).alias("positive_weight"))


#: Settings that are tried for each base learner.  Spark's trees have no leaf penalty, so the two penalties of
#: each boosting grid are two least leaf sizes.
FULL_GRID = {
    "gbt": {"rounds": (200, 400), "depth": (3, 4, 5), "rate": (0.03, 0.05, 0.08), "leaf": (5, 20)},
    "gbt_shallow": {"rounds": (200, 400), "depth": (3, 4, 5), "rate": (0.03, 0.05, 0.08), "leaf": (5, 20)},
    "forest": {"trees": (300, 500), "depth": (4, 6, 8), "leaf": (10, 30)},
    "logistic": {"strength": (0.01, 0.1, 1.0), "mix": (0.2, 0.5, 0.8)},
}
SMALL_GRID = {
    "gbt": {"rounds": (10,), "depth": (3,), "rate": (0.1,), "leaf": (5,)},
    "gbt_shallow": {"rounds": (10,), "depth": (2,), "rate": (0.1,), "leaf": (5,)},
    "forest": {"trees": (20,), "depth": (3, 5), "leaf": (10,)},
    "logistic": {"strength": (0.1, 1.0), "mix": (0.5,)},
}


def learners(grid: dict[str, dict[str, tuple]] | None = None, rows: int = 1000) -> dict[str, list]:
    """Candidates of each base learner: every combination of the grid, FULL_GRID by default.

    A logistic strength C counts the summed loss of `rows` training rows, Spark's penalty the mean loss.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    common = {"labelCol": "y", "weightCol": "weight"}
    make = {
        "gbt": lambda rounds, depth, rate, leaf: GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=leaf, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42, **common),
        "gbt_shallow": lambda rounds, depth, rate, leaf: GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=leaf, subsamplingRate=0.7, featureSubsetStrategy="0.5", seed=43, **common),
        "forest": lambda trees, depth, leaf: RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=42, **common),
        "logistic": lambda strength, mix: LogisticRegression(elasticNetParam=mix, regParam=1.0 / (strength * rows), maxIter=100, **common),
    }
    every = lambda settings: [dict(zip(settings, values, strict=True)) for values in product(*settings.values())]
    return {name: [make[name](**values) for values in every(settings)] for name, settings in (grid or FULL_GRID).items()}


def _score(model, df: DataFrame, keep: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("score"))


def with_raw(df: DataFrame, columns: list[str]) -> DataFrame:
    """`raw`: the columns as a vector."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("raw", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def rescaled(df: DataFrame, within: Column) -> DataFrame:
    """`features`: `raw` less its mean over its deviation, both over the rows where `within` holds."""
    from pyspark.ml.feature import StandardScaler

    df = df.drop("features")
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(df.where(within)).transform(df)


def scaled(df: DataFrame, columns: list[str], within: Column) -> DataFrame:
    """`raw` and `features`: the columns, and the columns scaled over the rows where `within` holds."""
    return rescaled(with_raw(df, columns), within)


def minmax(df: DataFrame, columns: list[str], within: Column) -> DataFrame:
    """Columns scaled to 0..1 by their extremes where `within` holds, with the extremes kept to invert it."""
    ends = df.where(within).agg(*[f(c).alias(f"_{c}_{n}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    out = df.crossJoin(F.broadcast(ends))  # one row
    return out.withColumns({f"{c}_scaled": F.try_divide(F.col(c) - F.col(f"_{c}_low"), F.col(f"_{c}_high") - F.col(f"_{c}_low")) for c in columns})


def minmax_inverse(df: DataFrame, scaled_column: str, column: str) -> Column:
    low, high = F.col(f"_{column}_low"), F.col(f"_{column}_high")
    return F.col(scaled_column) * (high - low) + low


def tune(folds: DataFrame, candidates: list, keys: list[str]) -> int:
    """Place of the candidate with the best mean AUC over purged folds; the first on ties.

    Where `folds` has `raw`, each fold is scaled by its own training rows: no row of a later fold tells on it.
    """
    if len(candidates) == 1:
        return 0
    numbers = sorted(r["fold"] for r in folds.select("fold").distinct().collect())

    def coded(fold) -> DataFrame:
        own = folds.where(F.col("fold") == fold)
        return written(rescaled(own, F.col("role") == "train") if "raw" in folds.columns else own, "fold")

    def score(own: DataFrame, candidate) -> float:
        fitted = candidate.fit(own.where("role = 'train'"))
        found = auc(_score(fitted, own.where("role = 'validation'"), [*keys, "y"]), [], "y", "score").collect()[0]["auc"]
        return 0.5 if found is None else found

    parts = together(folds.sparkSession, [partial(coded, n) for n in numbers])
    found = together(folds.sparkSession, [partial(score, own, c) for c in candidates for own in parts])
    scores = [sum(found[i * len(parts) : (i + 1) * len(parts)]) for i in range(len(candidates))]
    return scores.index(max(scores))


def base_predictions(df: DataFrame, folds: DataFrame, keys: list[str], grid: dict | None = None) -> tuple[DataFrame, dict]:
    """Scores of the tuned learners on validation and test rows, and the fitted models.  Learners are tuned together."""
    train, rest = df.where("split = 'train'"), df.where("split in ('validation', 'test')")
    sets = learners(grid, train.count())
    made = together(df.sparkSession, [lambda c=c: c[tune(folds, c, keys)].fit(train) for c in sets.values()])
    fitted = dict(zip(sets, made, strict=True))
    out = [_score(model, rest, [*keys, "split", "y"]).withColumn("model", F.lit(name)) for name, model in fitted.items()]
    return written(reduce(DataFrame.unionByName, out), "base"), fitted


def wide_scores(scores: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """One row for each key with a column for each model's score, and their average."""
    wide = scores.groupBy(*keys, "split", "y").pivot("model", models).agg(F.first("score"))
    return wide.withColumn("average", reduce(lambda a, b: a + b, map(F.col, models)) / len(models))


def meta_learners(inputs: int, trees: int = 200, rounds: int = 100) -> dict:
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier

    return {
        "meta_logistic": LogisticRegression(labelCol="y", regParam=0.01, maxIter=40),
        "meta_forest": RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=3, seed=42),
        "meta_gbt": GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=2, stepSize=0.05, seed=42),
        "meta_network": MultilayerPerceptronClassifier(labelCol="y", layers=[inputs, 8, 4, 2], maxIter=60, seed=42),
    }


def stack_predictions(wide: DataFrame, keys: list[str], models: list[str], folds: DataFrame, trees: int = 200, rounds: int = 100) -> DataFrame:
    """Out-of-fold scores of the meta-learners on validation rows, then their test scores after a fit to all of
    validation. Folds whose training rows hold one class are passed over."""
    from pyspark.ml.functions import array_to_vector

    vector = lambda d: d.withColumn("features", array_to_vector(F.array(*models)))
    held, wide = written(vector(folds), "meta"), vector(wide)
    classes = held.where("role = 'train'").groupBy("fold").agg(F.countDistinct("y").alias("c")).where("c > 1")
    numbers = sorted(r["fold"] for r in classes.select("fold").collect())

    def score(learner, train: DataFrame, rest: DataFrame, split: str, name: str) -> DataFrame:
        return _score(learner.fit(train), rest, [*keys, "y"]).select("*", F.lit(split).alias("split"), F.lit(name).alias("model"))

    jobs = []
    for name, learner in meta_learners(len(models), trees, rounds).items():
        for fold in numbers:
            own = held.where(F.col("fold") == fold)
            jobs.append(partial(score, learner, own.where("role = 'train'"), own.where("role = 'validation'"), "oof", name))
        jobs.append(partial(score, learner, wide.where("split = 'validation'"), wide.where("split = 'test'"), "test", name))
    return reduce(DataFrame.unionByName, together(wide.sparkSession, jobs))


def importances(fitted: dict, columns: list[str], spark) -> DataFrame:
    """(model, feature, importance) of trees and coefficients of linear models."""
    rows = []
    for name, model in fitted.items():
        values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else model.coefficients.toArray()
        rows += [(name, c, float(v)) for c, v in zip(columns, values, strict=True)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")
