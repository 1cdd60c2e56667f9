"""SimHash components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from seriesloom.llm.components import components
from seriesloom.llm.simhash import compare, fingerprints, near_duplicates, representatives, unite


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=4):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def corpus(n=260):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("Alpha beta Gamma delta eps zeta eta theta iota kap".split()) for _ in range(rnd.randrange(0, 90))) for _ in range(40)]
    texts = [None, "", " \t", "one", "ONE", "a b c", "É ß x y z", "w " * 5000]
    while len(texts) < n:
        words = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    return texts


def test_fingerprints():
    texts = corpus()
    assert fingerprints(texts).tolist() == [slow_print(t) for t in texts]
    assert len(fingerprints([])) == 0


@pytest.mark.parametrize("tile_rows", [32_768, 60, 4])
def test_components_against_brute_force(spark, tile_rows):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want_prints = {i: slow_print(t) for i, t in enumerate(texts)}
    want = slow_components(want_prints)
    got = {r.doc_id: r for r in near_duplicates(docs, tile_rows=tile_rows).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want_prints
    assert {i: r.component_id for i, r in got.items()} == want
    assert sorted(r.doc_id for r in representatives(docs, tile_rows=tile_rows).collect()) == sorted(set(want.values()))


def test_tiles_lose_no_link():
    rnd = np.random.default_rng(3)
    centres = rnd.integers(0, 1 << 63, 30, dtype=np.uint64)
    x = np.unique(np.concatenate([c ^ (np.uint64(1) << rnd.integers(0, 64, 12, dtype=np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 12, dtype=np.uint64)) for c in centres]))
    for left, right in ((x, None), (x[::2], x[1::2])):
        a, b = compare(left, right, 4)
        assert (np.bitwise_count(a ^ b) >= 1).all()
        place = {int(v): i for i, v in enumerate(x)}
        mine = unite(np.arange(len(x)), np.array([place[int(v)] for v in a]), np.array([place[int(v)] for v in b]))
        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 4)
        if right is not None:
            cross = (i % 2) != (j % 2)
            i, j = i[cross], j[cross]
        assert (mine == unite(np.arange(len(x)), i, j)).all()


def test_null_ids_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d e", 1), (None, "a b c d e", 2), (None, "solo text here now", 3), (7, "a b c d f g h", 4), (7, "a b c d f g h", 4), (9, "a b c d f g h", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, turn int")
    got = near_duplicates(docs).collect()
    assert sorted(r.component_id for r in got if r.doc_id is not None) == [7, 7, 7]
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.text) for r in kept.collect()) == [(False, "a b c d f g h"), (True, "a b c d e"), (True, "solo text here now")]


def test_every_component_keeps_one_row_where_ids_repeat(spark):
    rnd = random.Random(8)
    texts = corpus(90)
    rows = [(rnd.choice([None, *range(25)]), t, k) for k, t in enumerate(texts)]
    prints = {k: slow_print(t) for _, t, k in rows}
    group = slow_components(prints)
    want = {}
    for i, _, k in rows:
        want.setdefault(group[k], []).append((i is None, i))
    kept = representatives(spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)).collect()
    got = {group[r.row]: (r.doc_id is None, r.doc_id) for r in kept}
    assert len(kept) == len(got) and got == {g: min(x, key=lambda y: (y[0], y[1] or 0)) for g, x in want.items()}
    three = spark.createDataFrame([(1, "A a a a a"), (5, "A a a a a"), (5, "B b other words here")], "doc_id long, text string")
    assert sorted(tuple(r) for r in representatives(three).collect()) == [(1, "A a a a a"), (5, "B b other words here")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0 and representatives(docs).count() == 0


def test_components_of_paths(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(30)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
