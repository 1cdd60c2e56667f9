"""The encoder against the library, on ordinary and odd texts."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from seriesloom.llm.bpe import Memo, Ragged, WordBpe, words_of
from seriesloom.llm.shared import tokenizer_path

ODD = [
    None, "", "   ", "a" * 5000, "ab" * 300 + " x", "Ünï ǅ İstanbul ΑΣ ας Σ", "é café ́x", "日本語テスト 한국어",
    "x\x1cy \x85z\xa0w  q", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "don't we're I'll o'd 's 'S's", "１２３ ½ ² ⅷ ٣",
    "\xad soft\xadhy ﻿bom ​zw", "😀😀 emoji", "ﬁ ŉ ǆ ſ K Å Ω", "tab\tnl\n\x00\x01 nul", "!!!???...---***$$$%%%" * 20, "’ “x” – — …",
]


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(tokenizer_path(), cache_words=50)


def test_encoder_equals_library(bpe):
    rnd = random.Random(1)
    texts = list(ODD)
    for _ in range(1500):
        texts.append("".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0, 0x250), rnd.randrange(0x250, 0xD7FF), rnd.randrange(97, 110)])) for _ in range(rnd.randrange(1, 40))))
    want = bpe.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for at in range(0, len(texts), 100):
        got = bpe.encode_batch(pa.array(texts[at : at + 100], pa.string()))
        for i, (text, w) in enumerate(zip(texts[at : at + 100], want[at : at + 100], strict=True)):
            assert w.ids == got.ids[got.ends[i] : got.ends[i + 1]].tolist(), text
        assert bpe.decode_batch(got).to_pylist() == [bpe.library.decode(w.ids, skip_special_tokens=False) for w in want[at : at + 100]]


def test_memo_is_bounded():
    memo = Memo(10)
    lists = lambda words: Ragged.of(np.array([int(w) for w in words.to_pylist()], dtype="<u4"), np.ones(len(words), dtype=np.int64))
    for i in range(100):
        assert memo.complete(pa.array([str(i), "7"] if i != 7 else ["7"]), lists).ids.tolist() == ([i, 7] if i != 7 else [7])
        assert len(memo.words) <= 10
    assert (memo.find(pa.array(["99", "7", "8"])) >= 0).tolist() == [True, True, False]
    assert memo.complete(pa.array([str(i) for i in range(50)]), lists).ids.tolist() == list(range(50)) and len(memo.words) <= 10


def test_other_vocabularies_are_refused(tmp_path):
    with open(tokenizer_path(), encoding="utf-8") as f:
        data = json.load(f)
    for part, value in (("normalizer", None), ("decoder", {"type": "BPEDecoder", "suffix": "</w>"}), ("pre_tokenizer", {"type": "Whitespace"})):
        (tmp_path / "x.json").write_text(json.dumps(data | {part: value}))
        with pytest.raises(ValueError, match="normalizer"):
            WordBpe(str(tmp_path / "x.json"))


def test_words_of_a_batch():
    words, codes, ends = words_of(pa.array(["  a b ", None, "", "\u3000", "x\x1cy\xa0z a", "a"]))
    held = [words.to_pylist()[c] for c in codes]
    assert [[w for w in held[a:b] if w] for a, b in zip(ends, ends[1:])] == [["a", "b"], [], [], [], ["x\x1cy", "z", "a"], ["a"]]
