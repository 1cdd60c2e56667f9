"""Model fits from driver threads: order, failures, and the same choice as one fit after another."""

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import classify
from seriesloom.operators.fits import together


def test_results_keep_their_order_and_errors_are_raised(spark):
    assert together(spark, []) == []
    assert together(spark, [lambda n=n: spark.range(n).count() for n in (5, 0, 3)], 2) == [5, 0, 3]
    with pytest.raises(ZeroDivisionError):
        together(spark, [lambda: 1, lambda: 1 // 0])


def test_local_properties_reach_the_fits(spark):
    sc = spark.sparkContext
    sc.setLocalProperty("spark.scheduler.pool", "fits")
    try:
        assert together(spark, [lambda: sc.getLocalProperty("spark.scheduler.pool")] * 3) == ["fits"] * 3
    finally:
        sc.setLocalProperty("spark.scheduler.pool", None)


def test_the_candidate_that_ranks_best_is_chosen(spark):
    """Depth 1 can't tell exclusive-or labels, depth 3 can; equal candidates give the first."""
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = [(i, i % 3, "validation" if i % 4 == 0 else "train", float((i % 7 > 3) != (i % 5 > 2)), float(i % 7), float(i % 5)) for i in range(420)]
    df = classify.with_raw(spark.createDataFrame(rows, "id int, fold int, role string, y double, a double, b double"), ["a", "b"]).coalesce(1)
    tree = lambda depth: DecisionTreeClassifier(labelCol="y", maxDepth=depth)
    assert classify.tune(df, [tree(1), tree(3), tree(3)], ["id"]) == 1
    assert classify.tune(df.where(F.lit(False)), [tree(1), tree(3)], ["id"]) == 0
