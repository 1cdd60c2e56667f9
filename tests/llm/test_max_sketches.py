import math
import re
from collections import Counter

import numpy as np
import pytest

from seriesloom.llm import max_sketches as op

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_all = sum(1 for _, c in held if c)
    length = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 75 + ((75 * c.total() * n_all) // length) if length else 0
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if bare else i, -s) for rank, (s, bare, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "日本"]
    return [(int(i), " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(n)]


@pytest.mark.parametrize(("width", "most_items"), [(1024, 100), (4, 3), (1, 1)])
def test_equals_brute_force_with_few_coordinates(spark, width, most_items):
    """Nulls, ties of repeated rows, blanks, a long text, repeated items and clashing columns, in several blocks."""
    rng = np.random.default_rng(3)
    docs = [*corpus(rng, 120), (None, "w1 w2 w3"), (5, None), (6, ""), (7, " .,"), (8, "w1 W2 w3 É"), (9, "w1 w2 w3 É"), (9, "w1 w2 w3 É"), (10, "w5 " * 30_000)]
    items = [(1, "W1 w2, w3 w3 É"), (2, None), (3, ""), (4, "absent"), (5, "w5 w5"), (1, "W1 w2, w3 w3 É"), (6, "naïve 日本 w59"), (7, "É é")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(4)
    q = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_id int")
    got = op.search(d, q, width=width, most_items=most_items)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_bounds_are_upper_and_rows_are_skipped():
    best = op.Best(2)
    bounds, scores = np.array([50.0, 9.0, 40.0, 30.0, 8.0]), np.array([45, 9, 40, 1, 8])
    assert op.score_rows(best, bounds, lambda at: scores[at], [1, 2, 3, 4, 5], 0, round_rows=1) == 2
    assert [r[2] for r in best.rows] == [1, 3]


def test_equal_score_with_smaller_id_still_enters():
    best = op.Best(1)
    op.score_rows(best, np.array([7.0]), lambda at: np.array([7]), [9], 0)
    op.score_rows(best, np.array([7.0]), lambda at: np.array([7]), [4], 1)
    assert best.rows[0][2] == 4


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert op.search(docs, asked).count() == 0 and op.search(some, items).count() == 0
    assert [tuple(r)[:3] for r in op.search(some, asked).collect()] == [(1, 1, 1)]
