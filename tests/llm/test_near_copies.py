"""Near copies against brute force over all pairs of wide fingerprints, and against exact similarities."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from seriesloom.llm.near_copies import RADIUS, compare, fingerprint, representatives, shingles, similar
from seriesloom.llm.simhash import unite

MASK = (1 << 64) - 1


def corpus():
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in "ba ko ti mu re".split() for b in "lan dor sun mek pil vra".split()]
    texts = []
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randrange(60, 300))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randrange(0, len(base) // 25)):
                copy[rnd.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    return texts + [None, "", " \t", "short text", "Short TEXT", "a b c d e", "a b c d e f"]


def slow_set(text):
    words = (text or "").lower().split(" ") if (text or "").strip() else []
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_print(grams):
    def mixed(h, lane):
        z = (h + (lane + 1) * 0x9E3779B97F4A7C15) & MASK
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        return z ^ (z >> 31)

    out = 0
    for lane in range(4):
        hashes = [mixed(xxhash.xxh64_intdigest(g.encode(), 42), lane) for g in grams]
        out |= sum(1 << (64 * lane + b) for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out


def slow_roots(texts):
    """The least place in each text's component, and the linked pairs."""
    sets = [slow_set(t) for t in texts]
    prints = [slow_print(s) for s in sets]
    near = lambda i, j: sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    assert all((prints[i] ^ prints[j]).bit_count() <= RADIUS for i in range(len(texts)) for j in range(i) if near(i, j))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near(i, j)]
    parent = list(range(len(texts)))
    for _ in texts:
        for i, j in pairs:
            parent[i] = parent[j] = min(parent[i], parent[j])
    return parent, pairs, sets


def borderline():
    """Pairs of texts, each pair of its own words, whose similarity lies between 0.78 and 0.85."""
    rnd, texts = random.Random(9), []
    for k in range(90):
        base = [f"q{k}x{i}" for i in range(210)]
        copy = list(base)
        for i in rnd.sample(range(10, 200, 7), 4 + k % 2):
            copy[i] = "edit"
        texts += [" ".join(base), " ".join(copy)]
    return texts


@pytest.mark.parametrize(("tile_rows", "tile_bytes", "make"), [(16_384, 2_000_000, corpus), (7, 5_000, corpus), (16_384, 2_000_000, borderline), (50, 4_000, borderline)])
def test_stage_against_brute_force(spark, tile_rows, tile_bytes, make):
    """Exactly the exact rule's representatives, also where components spread over tiles."""
    texts = make()
    parent, pairs, sets = slow_roots(texts)
    if make is borderline:
        found = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(texts), 2)]
        assert 20 < sum(0.78 <= j < 0.8 for j in found) < 80 and 20 < sum(0.8 <= j < 0.86 for j in found) < 80
    docs = spark.createDataFrame([(*r, "x") for r in enumerate(texts)], "doc_id long, text string, g string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "") if tile_rows > 100 else representatives(docs, tile_rows=tile_rows, tile_bytes=tile_bytes)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(parent))


def test_components_of_sets_equal_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(60):
        pool = [rng.choice(60, rng.integers(0, 30), replace=False) for _ in range(rng.integers(1, 6))]
        sets = [np.unique(np.concatenate([rng.permutation(p)[: max(0, len(p) - rng.integers(0, 4))], rng.choice(90, rng.integers(0, 3))]).astype(np.uint64)) for p in (pool[rng.integers(len(pool))] for _ in range(rng.integers(0, 30)))]
        close = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        want = unite(np.arange(len(sets)), *(np.array(x, dtype=np.int64) for x in zip(*close, strict=True))) if close else np.arange(len(sets))
        assert (similar(sets) == want).all()


def test_tiles_lose_no_link():
    rnd = np.random.default_rng(3)
    centres = rnd.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    flips = lambda n: np.packbits(rnd.random((n, 256)) < 0.1, axis=1).view(np.uint64)
    x = np.concatenate([c[None] ^ flips(25) for c in centres])
    size = rnd.integers(80, 110, len(x))
    near = (np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2) <= RADIUS) & (5 * np.minimum(size[:, None], size[None]) >= 4 * np.maximum(size[:, None], size[None]))
    for half in (None, 333):
        a, b = compare((x, size), None) if half is None else compare((x[:half], size[:half]), (x[half:], size[half:]))
        i, j = np.nonzero(near if half is None else near & ((np.arange(len(x)) < half)[:, None] != (np.arange(len(x)) < half)[None]))
        assert (unite(np.arange(len(x)), a, b) == unite(np.arange(len(x)), i, j)).all()


def test_long_and_blank_texts():
    rnd = random.Random(1)
    text = " ".join(str(rnd.randrange(10**6)) for _ in range(40_000))
    assert fingerprint(shingles(text)).tolist() == [slow_print(slow_set(text)) >> (64 * k) & MASK for k in range(4)]
    assert fingerprint(shingles(None)).tolist() == [0, 0, 0, 0] and len(shingles("A b")) == 1


def test_ids_that_repeat_or_lack(spark):
    rows = [(1, "one text of some words here", 1), (1, "another text with quite other words", 2), (None, "one text of some words here", 3), (None, "nobody has this text at all", 4), (None, "nobody has this text at all", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    kept = representatives(docs)
    assert kept.columns == docs.columns
    want = [(0, "nobody has this text at all"), (1, "another text with quite other words"), (1, "one text of some words here")]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == want
    assert sorted((r.doc_id or 0, r.text) for r in representatives(docs, broadcast_rows=0).collect()) == want
    assert representatives(docs.limit(0)).count() == 0
