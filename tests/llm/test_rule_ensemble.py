"""Rule ensemble: rules parse, expressions equal the rules, held-out accuracy, odd rows."""

import random

import pytest

from seriesloom.llm.rule_ensemble import STATISTICS, RuleModel, accept, fit, quality_report, rules_of, statistics, with_score

TREES = """RandomForestClassificationModel: uid=x, numTrees=1, numClasses=2, numFeatures=3
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 2 > -1.5E-2)
      Predict: 0.0
     Else (feature 2 <= -1.5E-2)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""


def corpus(n=600):
    rnd = random.Random(8)
    words = "alpha beta gamma delta of the and is ombre vert".split()
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 80))) + "."
        good = rnd.random() < 0.7
        if not good:
            text = rnd.choice([text.replace(" ", "### "), text.upper().replace(" ", "!! "), text.replace(" ", " | ")])
        docs.append((i, text, "x"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_rules_are_the_paths():
    assert rules_of(TREES) == [((0, True, 0.5),), ((0, True, 0.5), (2, False, -0.015)), ((0, True, 0.5), (2, True, -0.015)), ((0, False, 0.5),)]


def test_statistics_by_hand():
    s = dict(zip(STATISTICS, statistics("Aa bb! Aa bb!\nAa bb! ##\n"), strict=True))
    assert s["word_length"] == pytest.approx(17 / 7) and s["distinct_share"] == pytest.approx(3 / 7)
    assert s["symbol_rate"] == pytest.approx(2 / 7) and s["exclamation_rate"] == pytest.approx(3 / 7)
    assert statistics(None) == statistics(" \n") == [0.0] * len(STATISTICS)
    assert dict(zip(STATISTICS, statistics("a b c d e a b c d e"), strict=True))["repeat_share"] == 1.0


def test_expression_equals_the_rules(spark):
    model = RuleModel(-0.5, [(((0, True, 1.0), (1, False, 2.0)), 1.5), (((2, False, 0.4),), -2.0)])
    rows = spark.createDataFrame([(0.5, 3.0, 0.5), (1.0, 2.0, 0.4), (2.0, 3.0, 1.0)], "a double, b double, c double")
    import math

    want = []
    for r in rows.collect():
        total = -0.5 + 1.5 * (r.a <= 1.0 and r.b > 2.0) - 2.0 * (r.c > 0.4)
        want.append(1 / (1 + math.exp(-total)))
    assert [r.s for r in rows.select(model.score(["a", "b", "c"]).alias("s")).collect()] == pytest.approx(want)


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (None, None, "y"), (9999, "", "z"), (0, docs[0][1], "x")], "doc_id long, text string, score string")
    l = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")  # noqa: E741
    got = quality_report(d, l).collect()
    assert len(got) == len(docs) + 3 and all(0 <= r.score <= 1 for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = accept(d, l)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted for r in got)


def test_one_class_and_empty_tables(spark):
    docs, labels = corpus(40)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fit(d, none).weights == [] and {round(r.score, 6) for r in quality_report(d, none).collect()} == {0.5}
    assert quality_report(d.limit(0), none).count() == 0
    assert "_score" in with_score(d.withColumnRenamed("lang", "score"), RuleModel(0.0, [])).columns
