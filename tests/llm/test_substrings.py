import hashlib
import re

import numpy as np
import pytest

from seriesloom.llm import substrings as op
from seriesloom.llm.fm_index import FmIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    big = 1 << 63
    held = [(big if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, ws in held:
        for a in range(len(ws) - window + 1):
            w = tuple(ws[a : a + window])
            first[w] = min(first.get(w, big), i)
    out = []
    for (i, ws), (shown, _) in zip(held, rows, strict=True):
        gone = set()
        for a in range(len(ws) - window + 1):
            if first[tuple(ws[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = [w for a, w in enumerate(ws) if a not in gone]
        out.append((shown, len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60, words=12):
    """Texts that share passages in new surroundings, near copies, exact copies, periodic texts and odd rows."""
    rng = np.random.default_rng(seed)
    word = [f"w{i}" for i in range(words)] + ["É", "日本", "a\x00b", "　"]
    passage = " ".join(rng.choice(word, 30))
    rows = []
    for i in range(n):
        own = " ".join(rng.choice(word, rng.integers(0, 40)))
        kind = i % 5
        if kind == 0:
            own = f"{own} {passage}\t\n {' '.join(rng.choice(word, 9))}"
        elif kind == 1 and rows:
            own = re.sub(r"w3", "x", rows[int(rng.integers(len(rows)))][1] or "")
        elif kind == 2 and rows:
            own = rows[int(rng.integers(len(rows)))][1]
        rows.append((i, own))
    rows += [(None, passage), (None, passage), (3, passage), (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "ab " * 3000), (n + 4, "ab " * 500), (7, rows[7][1]), (n + 5, "W0 " + passage.upper())]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize(("seed", "window", "hot", "shard_bytes"), [(1, 6, 4096, 6_000_000), (2, 6, 3, 500), (3, 2, 1, 200), (4, 13, 0, 1_000), (5, 1, 5, 6_000_000), (6, 50, 1, 300)])
def test_equals_brute_force(spark, seed, window, hot, shard_bytes):
    """Also with routes trimmed from few pieces on, and with very many shards."""
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, k string, n_words int").repartition(5)
    got = op.dedup_report(docs, window=window, hot=hot, shard_bytes=shard_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, window)


def test_texts_without_repeats_keep_other_columns(spark):
    base = " ".join(f"t{i}" for i in range(60))
    rows = [(1, f"only {base}", "a"), (2, f"{base}  tail   here", "b"), (3, f"only {base}", "c"), (4, " odd  spaces ", "d"), (5, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {r.doc_id: (r.text, r.kept) for r in op.without_repeats(docs).collect()}
    assert got == {1: (f"only {base}", "a"), 2: ("tail here", "b"), 3: ("", "c"), 4: (" odd  spaces ", "d"), 5: (None, "e")}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.dedup_report(docs).count() == 0 and op.without_repeats(docs).count() == 0


def test_equal_windows_share_a_route():
    rng = np.random.default_rng(0)
    words = [b"%d" % i for i in rng.integers(0, 3, 400)]
    for window in (1, 4, 7, 50):
        route, _ = op.routes(words, window)
        exact = op.window_hashes(words, window)
        by = {}
        for a in range(len(words) - window + 1):
            found = by.setdefault(tuple(words[a : a + window]), (route[a], exact[a]))
            assert found == (route[a], exact[a])
        assert len({x for _, x in by.values()}) == len(by)


def test_a_common_passage_in_new_surroundings_leaves_few_pieces(spark):
    """400 texts around one passage: windows that occur once are trimmed, so equal pieces are left."""
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [(i, " ".join(map(str, rng.integers(0, 10**9, 60))) + f" {passage} " + " ".join(map(str, rng.integers(0, 10**9, 60)))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = docs.selectExpr("unhex(md5(text)) AS k", "doc_id AS doc", "cast(text as binary) AS text")
    routes = sorted({int(x) for x in op.routes(passage.encode().split(), 50)[0]})
    held = rows.withColumn("routes", op.F.lit(routes))
    found = op.pieces(held, 50, hot=100)
    assert found.select("p").distinct().count() <= len(routes)
    assert found.count() >= 400
    assert sum(r.n_removed > 0 for r in op.dedup_report(docs, hot=100).collect()) == 399


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for _ in range(60):
        longest = int(rng.integers(1, 9))
        held = [rng.integers(1, 5, rng.integers(0, 14)) for _ in range(rng.integers(1, 9))]
        owners = rng.integers(0, 50, len(held))
        index = FmIndex(np.concatenate(held).astype(np.int64), np.array([len(s) for s in held]), owners, longest)
        asked = [rng.integers(0, 7, rng.integers(0, 16)) for _ in range(6)]
        found = index.stream(np.concatenate(asked).astype(np.int64), np.array([len(q) for q in asked]))
        at = 0
        for q in asked:
            for i in range(len(q)):
                best, owner = 0, -1
                for n in range(1, min(longest, len(q) - i) + 1):
                    hits = [owners[j] for j, s in enumerate(held) for p in range(len(s) - n + 1) if (s[p : p + n] == q[i : i + n]).all()]
                    if hits:
                        best, owner = n, min(hits) if n == longest else -1
                assert (found.length[at], found.owner[at]) == (best, owner)
                at += 1
