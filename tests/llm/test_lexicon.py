"""The lexicon: minimal, exact, and the round trip against the library."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from seriesloom.llm.bpe import WordBpe
from seriesloom.llm.lexicon import Lexicon, compile_lexicon, decode, encode, minimal, round_trip
from seriesloom.llm.shared import tokenizer_path


def test_automaton_is_minimal_and_maps_every_word(tmp_path):
    rnd = random.Random(1)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 7))) for _ in range(400)}
    ids = {w: np.array([i, len(w)][: 1 + i % 2], dtype="<u4").tobytes() for i, w in enumerate(sorted(words))}
    (tmp_path / "x").write_bytes(compile_lexicon(ids))
    lexicon = Lexicon(str(tmp_path / "x"))
    other = ["", "abc" * 9, "zz", "ab\0", "日"]
    asked = [*words, *other]
    found, lists = lexicon.find(pa.array(asked))
    assert {asked[i]: lists.ids[a:b].tobytes() for i, a, b in zip(found, lists.ends, lists.ends[1:])} == ids
    root, languages, stack = minimal(sorted(w.encode() for w in ["tap", "taps", "top", "tops"])), set(), []
    stack.append(root)
    while stack:
        state = stack.pop()
        languages.add(id(state))
        stack.extend(state.edges.values())
    assert len(languages) == 5
    (tmp_path / "none").write_bytes(compile_lexicon({}))
    assert len(Lexicon(str(tmp_path / "none")).find(pa.array(["a"]))[0]) == 0


def test_round_trip_equals_library(spark):
    rows = [(1, "The cat, the cat!! sat"), (2, None), (3, ""), (3, ""), (None, "<|endoftext|>é ΑΣ 日本"), (5, "so long " * 20000), (6, "w" * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    library = WordBpe(tokenizer_path()).library
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(docs).collect()) == sorted(want)


def test_clashing_columns_are_replaced(spark):
    docs = spark.createDataFrame([(1, "the cat", "x", "y"), (2, None, "x", "y")], "doc_id long, text string, ids string, decoded string")
    got = decode(encode(docs)).orderBy("doc_id").collect()
    assert [(r.decoded, r.text) for r in got] == [("the</w> cat</w>", "the cat"), ("", None)] and set(got[0].asDict()) == {"doc_id", "text", "ids", "decoded"}


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
