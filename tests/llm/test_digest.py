"""Digests: entropy by hand, likeness, and edited copies against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import digest as d


def test_concentration_and_minima_by_hand():
    rnd = random.Random(1)
    for window in (8, 32):
        for n in (window, window + 1, 100, 700):
            data = bytes(rnd.choice(b"abcde  xyz") for _ in range(n))
            want = [sum(int(d._TERM[c]) for c in Counter(data[i : i + window]).values()) for i in range(n - window + 1)]
            assert d.concentration(np.frombuffer(data, np.uint8), window).tolist() == want
            values = np.array([rnd.randrange(9) for _ in range(n)])
            assert d.sliding_least(values, window).tolist() == [min(values[i : i + window]) for i in range(max(1, n - window + 1))]


def test_likeness():
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000))
    other = " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000))
    a, b = d.Fingerprint.of(text), d.Fingerprint.of(other)
    assert d.likeness(a, a) == 1 and d.likeness(a, b) < 0.05 and len(a.counts) > 3
    near = d.likeness(a, d.Fingerprint.of(d.edited(text, other)))
    assert 0.4 < near < 1
    again = d.Fingerprint.parse(str(a))
    assert (again.bits == a.bits).all() and (again.counts == a.counts).all()
    empty = d.Fingerprint.of("")
    assert str(empty) == "" and d.likeness(empty, d.Fingerprint.parse("")) == 1 and d.likeness(empty, a) == 0


@pytest.mark.parametrize("bucket_rows", [1, 7, 512])
def test_edited_copies_against_brute_force(spark, bucket_rows):
    rnd = random.Random(3)
    ids = rnd.sample(range(-50, 100_000), 120) + [10**12, -(10**12)]
    rows = [(i, "".join(rnd.choice("abc é日x ") for _ in range(rnd.randrange(0, 400))), "c") for i in ids] + [(5_000_000, None, "c"), (5_000_001, "", "c"), (None, "no id at all", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(4)
    ordered = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        k = len(t) // 3
        copy = t[: len(t) - k] + following[:k]
        prints = [d.Fingerprint.of(x) for x in (t, copy, following)]
        want[i] = (len(t), hashlib.sha256(copy.encode()).hexdigest(), str(prints[0]), str(prints[1]), d.likeness(prints[0], prints[1]), d.likeness(prints[0], prints[2]))
    got = {r.doc_id: tuple(r)[1:] for r in d.edited_report(docs, bucket_rows).collect()}
    assert got == want


@pytest.mark.parametrize("kind", ["clustered", "null", "repeated"])
def test_no_bucket_is_large(spark, kind):
    id = {"clustered": "case when id < 5900 then id else id * 1000000000 end", "null": "if(id % 3 = 0, null, id)", "repeated": "if(id % 3 = 0, 7, id)"}[kind]
    docs = spark.range(6000).select(F.expr(id).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    placed, buckets = d.with_next(docs, 100)
    sizes = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert max(sizes) <= 101 and len(sizes) == buckets and sum(sizes) == 6000 + buckets
    assert placed.where("guest").groupBy("bucket").count().where("count > 1").count() == 0


def test_repeated_ids_follow_each_other(spark):
    rows = [(i % 5, f"text number {i % 7} of them") for i in range(60)] + [(None, "x y z")] * 3
    got = d.edited_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    by_id = {i: sorted(h for j, h in ((r.doc_id, r.fingerprint) for r in got) if j == i) for i in {r.doc_id for r in got}}
    assert by_id[3] == sorted(str(d.Fingerprint.of(t)) for i, t in rows if i == 3)


def test_repeats_single_row_and_empty_table(spark):
    one = spark.createDataFrame([(4, "only one text here")], "doc_id long, text string")
    assert d.edited_report(one).collect()[0].near_next == 1
    assert d.edited_report(spark.createDataFrame([(4, "a"), (4, "a"), (3, "b")], "doc_id long, text string")).count() == 3
    assert d.edited_report(one.limit(0)).count() == 0
    assert d.edited_report(spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")).count() == 2


def test_column_functions(spark):
    df = spark.createDataFrame([("some text that is long enough", "other"), (None, "")], "a string, b string")
    got = df.select(d.similarity(d.fingerprint("a"), d.fingerprint("a")).alias("s"), d.similarity(d.fingerprint("a"), d.fingerprint("b")).alias("o")).collect()
    assert [r.s for r in got] == [1, 1] and got[0].o < 0.5


def test_periodic_texts_have_features_of_their_own():
    rnd = random.Random(4)
    other = " ".join("".join(rnd.choice("bcdefgij") for _ in range(6)) for _ in range(300))
    texts = ["a" * 2000, "ha" * 1000, "lorem " * 300, "spam ham " * 300, "0123456789" * 200, "-" * 300]
    prints = [d.Fingerprint.of(t) for t in texts]
    assert all(str(p) for p in prints)
    for i, p in enumerate(prints):
        assert d.likeness(p, p) == 1 and d.likeness(p, d.Fingerprint.of("")) == 0
        assert all(d.likeness(p, q) < 0.2 for q in prints[:i])
        assert set(d.features(texts[i])) & set(d.features(d.edited(texts[i], other)))


def test_near_copies_on_both_sides_of_the_length_limits():
    rnd = random.Random(5)
    text = " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(100))
    for n, m in ((303, 213), (256, 255), (300, 250), (520, 500), (512, 511), (560, 250)):
        a, b = d.Fingerprint.of(text[:n]), d.Fingerprint.of(text[:m])
        assert d.likeness(a, b) == d.likeness(d.Fingerprint.parse(str(a)), d.Fingerprint.parse(str(b))) > 0.3
        assert d.likeness(a, d.Fingerprint.of(text[::-1][:m])) < 0.1
    for n in range(200, 301):
        assert d.likeness(d.Fingerprint.of(text[:n]), d.Fingerprint.of(text[: n - 1])) > 0.8


def test_insertions_change_little_at_any_length():
    """A few characters inside a text, at every length around the former limits and far from them."""
    rnd = random.Random(6)
    text = " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(900))
    for n in [*range(230, 541), 90, 1000, 4000]:
        at = rnd.randrange(n)
        assert d.likeness(d.Fingerprint.of(text[:n]), d.Fingerprint.of(text[:at] + "zq xw " + text[at:n])) > 0.6, n


def test_clashing_columns(spark):
    rows = [(2, "some text of the first row", "a", 1, True), (1, "and the text that follows", "b", 2, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, bucket int, guest boolean")
    got = {r.doc_id: r.near_next for r in d.edited_report(docs).collect()}
    assert set(got) == {1, 2} and all(x < 0.2 for x in got.values())
