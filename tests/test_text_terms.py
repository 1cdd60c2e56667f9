"""Terms of texts: counted where they are read, and weighed without shuffling the frequent ones."""

from pyspark.sql import functions as F

from seriesloom.operators import text


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_terms_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "The cat, the CAT"), (2, None), (3, "\u212aelvin _a1"), (4, ""), (None, "x")], "id long, text string")
    found = text.term_counts(df, ["id"], "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == sorted([(1, "cat", 2), (1, "the", 2), (1, "the cat", 2), (1, "cat the", 1), (3, "elvin", 1), (3, "_a1", 1), (3, "elvin _a1", 1), (None, "x", 1)], key=repr)
    assert rows(text.term_counts(df.where("id = 1"), ["id"], "text", pairs=False)) == [(1, "cat", 2), (1, "the", 2)]


def test_rows_of_one_key_count_as_one_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a"), (1, "b a"), (None, "c"), (None, "c")], "id long, text string")
    assert rows(text.term_counts(df, ["id"], "text")) == sorted([(1, "a", 2), (1, "b", 2), (1, "a b", 1), (1, "b a", 1), (2, "a", 1), (None, "c", 2)], key=repr)


def test_blocks_do_not_change_counts(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} " * (i % 4)) for i in range(200)], "id long, text string").coalesce(2)
    whole = rows(text.term_counts(df, ["id"], "text"))
    monkeypatch.setattr(text, "BLOCK_BYTES", 40)
    assert rows(text.term_counts(df, ["id"], "text")) == whole and len(whole) > 300


def test_only_rare_terms_are_shuffled(spark):
    df = spark.createDataFrame([(i, f"all w{i % 3} v{i % 40} once{i}") for i in range(120)], "doc_id long, text string")
    counts = text.term_counts(df, ["doc_id"], "text")
    terms = text.vocabulary(counts)
    every = rows(text.tfidf(counts, terms, 120).withColumn("weight", F.round("weight", 9)))
    for most in (0, 1, 5, 40):
        found = text.tfidf(counts, terms, 120, most)
        assert rows(found.withColumn("weight", F.round("weight", 9))) == every
    plan = text.tfidf(counts, terms, 120, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and "LeftAnti" in plan
    assert {r[0] for r in every} >= {"all", "w1", "v39"} and not any("once" in r[0] for r in every)


def test_vectors_equal_the_weights_by_term(spark):
    df = spark.createDataFrame([(i, f"all w{i % 3} w{i % 3} V{i % 4}" if i else "") for i in range(20)], "doc_id long, text string")
    counts = text.term_counts(df, ["doc_id"], "text")
    terms = text.vocabulary(counts, 2, 9)
    found = text.tfidf_vectors(df, "text", terms, 20)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, int(i)): round(float(v), 9) for r in found.collect() for i, v in zip(r.features.indices, r.features.values, strict=True)}
    assert got == {(r.doc_id, r.id): round(r.weight, 9) for r in text.tfidf(counts, terms, 20).collect()} and len(got) > 60
    assert {r.features.size for r in found.collect()} == {9} and found.count() == 20
