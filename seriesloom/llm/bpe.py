"""Exact byte-pair encoding for vocabularies with word ends, in batches.

The vocabulary's pre-tokenizer never crosses white space, so a text is the concatenation of its
space-delimited words' ids.  A batch of texts is split into words by Arrow, each distinct word of the batch is
looked up or encoded once, and the texts' ids are gathered from their words' by numpy.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What this module assumes of a vocabulary file besides its model.
_ASSUMED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
_ASSUMED_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
# The library's pre-tokenizer pattern restricted to code points below U+0180 and general
# punctuation, where NFC changes nothing and lower case stays in the range. Words with other code points go through the library's own
# normalizer and pre-tokenizer.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile("[\x00-\u017f\u2010-\u2027]*")
_PIECES_AND_LINES = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\n{_LETTERS}{_NUMBERS}]+")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
# Unicode's white space beyond ASCII.
_WIDE_SPACE = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_NO_RANK = np.int64(1 << 40)
_WIDE = 48


class Ragged(NamedTuple):
    """Lists of ids, one after the other, and their number up to each list's end, from 0."""

    ids: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, sizes: np.ndarray) -> Ragged:
        return cls(ids, np.concatenate([[0], np.cumsum(sizes)]))

    def sizes(self) -> np.ndarray:
        return np.diff(self.ends)

    def take(self, places: np.ndarray) -> Ragged:
        """The lists at `places`, in their order."""
        sizes = self.sizes()[places]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.ends[places] - ends[:-1], sizes)
        at += np.arange(len(at))
        return Ragged(self.ids[at], ends)

    def joined(self, ends: np.ndarray) -> Ragged:
        """Neighbouring lists joined to longer ones that end after `ends` lists."""
        return Ragged(self.ids, self.ends[ends])

    def then(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.ids, other.ids]), np.concatenate([self.ends, other.ends[1:] + self.ends[-1]]))


NO_LISTS = Ragged(np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64))
NO_WORDS = pa.array([], pa.string())


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct space-delimited words of a batch of texts, each word of the texts as its place among these,
    and the number of words up to each text's end, from 0. Null counts as empty; an empty word may be among them."""
    held = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), _WIDE_SPACE, " ")
    split = pc.ascii_split_whitespace(held)
    coded = split.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)


def lines_of(words: pa.Array) -> str:
    """Words joined by line feeds."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' UTF-8 bytes, and where each word starts and the last ends."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), ends


class Memo:
    """Ids of words seen before. Holds at most `limit` words, whatever the corpus holds: when there are more,
    the half that was asked for last stays."""

    def __init__(self, limit: int):
        self.limit, self.words, self.lists = limit, NO_WORDS, NO_LISTS
        self.used, self.now = np.zeros(0, dtype=np.int64), 0

    def find(self, words: pa.Array) -> np.ndarray:
        """Each word's place in `lists`, -1 where it is unknown."""
        self.now += 1
        places = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)
        self.used[places[places >= 0]] = self.now
        return places

    def add(self, words: pa.Array, lists: Ragged) -> None:
        """Adds words that `find` didn't know."""
        if len(self.words) + len(words) > self.limit:
            kept = np.argsort(-self.used, kind="stable")[: self.limit // 2]
            self.words, self.lists, self.used = self.words.take(pa.array(kept)), self.lists.take(kept), self.used[kept]
        if len(words) <= self.limit // 2:
            self.words = pa.concat_arrays([self.words, words])
            self.lists = self.lists.then(lists)
            self.used = np.concatenate([self.used, np.full(len(words), self.now)])

    def complete(self, words: pa.Array, missing: Callable[[pa.Array], Ragged]) -> Ragged:
        """The ids of each word; those of unknown words come from `missing` and are remembered."""
        places = self.find(words)
        unknown = np.flatnonzero(places < 0)
        if not len(unknown):
            return self.lists.take(places)
        asked = words.take(pa.array(unknown))
        fresh, known = missing(asked), len(self.lists.ends) - 1
        places[unknown] = known + np.arange(len(unknown))
        out = self.lists.then(fresh).take(places)
        self.add(asked, fresh)
        return out


class WordBpe:
    """Encoder and decoder for one vocabulary file.

    `cache_words` bounds the memo of encoded words, and half of it that of their pieces.
    """

    def __init__(self, path: str, cache_words: int = 300_000):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        if {k: data.get(k) for k in _ASSUMED} != _ASSUMED or {k: model.get(k) for k in _ASSUMED_MODEL} != _ASSUMED_MODEL or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE vocabulary with word ends and the normalizer, pre-tokenizer and decoder of word_bpe_49k.json is needed")
        self.path = path
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = np.full(size, "", dtype=object)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.pad = size
        end = model["end_of_word_suffix"]
        chars = _byte_chars()
        self._byte_of = {c: b for b, c in enumerate(chars)}
        self._inner = np.array([self.vocab[c] for c in chars], dtype=np.int64)
        self._final = np.array([self.vocab[c + end] for c in chars], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], dtype=np.int64)
        keys = left * (size + 1) + right
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        self._first_ranks = np.full(512 * 512, _NO_RANK, dtype=np.int64)
        early = (left < 512) & (right < 512)
        self._first_ranks[left[early] * 512 + right[early]] = np.flatnonzero(early)
        self.cache, self.piece_cache = Memo(cache_words), Memo(cache_words // 2)

    @cached_property
    def library(self):
        """The library's tokenizer, for words beyond the plain range; opened when the first one comes."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def _rank_of(self) -> dict[int, int]:
        """Rank of each pair, for very long words."""
        return dict(zip(self._keys.tolist(), self._ranks.tolist(), strict=True))

    # -- words ---------------------------------------------------------------------------------
    def pieces(self, word: str) -> list[str | int]:
        """Pre-tokens of one space-delimited word; special tokens as their id."""
        if self._special is not None and "<|" in word and self._special.search(word):
            out: list[str | int] = []
            for part in self._special.split(word):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out.extend(self.pieces(part))
            return out
        if word.isascii() or _PLAIN.fullmatch(word):
            return _PIECES.findall(word.lower())
        plain = self.library.normalizer.normalize_str(word)
        return [bytes(self._byte_of[c] for c in p).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def encode_words(self, words: pa.Array) -> Ragged:
        """Ids of each word, without a look at the memo of words."""
        joined = lines_of(words)
        if "<|" not in joined and (joined.isascii() or _PLAIN.fullmatch(joined)):
            return self._encode_plain(joined, len(words))
        held = words.to_pylist()
        plain = [i for i, w in enumerate(held) if "<|" not in w and (w.isascii() or _PLAIN.fullmatch(w))]
        out = self._encode_plain("\n".join([held[i] for i in plain]), len(plain))
        odd = sorted(set(range(len(held))).difference(plain))
        parts = [self.pieces(held[i]) for i in odd]
        texts = [p for x in parts for p in x if isinstance(p, str)]
        ids, at, rows = self._encode_pieces(pa.array(texts, pa.string())), 0, []
        for x in parts:
            row = []
            for p in x:
                if isinstance(p, str):
                    row.append(ids.ids[ids.ends[at] : ids.ends[at + 1]])
                    at += 1
                else:
                    row.append(np.array([p], dtype="<u4"))
            rows.append(np.concatenate(row) if row else NO_LISTS.ids)
        out = out.then(Ragged.of(np.concatenate([NO_LISTS.ids, *rows]), np.array([len(r) for r in rows], dtype=np.int64)))
        return out.take(np.argsort(np.array(plain + odd, dtype=np.int64)))

    def _encode_plain(self, joined: str, count: int) -> Ragged:
        """Ids of `count` words that come joined by line feeds."""
        if not count:
            return NO_LISTS
        pieces = pa.array(_PIECES_AND_LINES.findall(joined.lower()), pa.string())
        lines = np.flatnonzero(pc.equal(pieces, "\n").to_numpy(zero_copy_only=False))
        return self._encode_pieces(pieces).joined(np.concatenate([[0], lines, [len(pieces)]]))

    def _encode_pieces(self, pieces: pa.Array) -> Ragged:
        """Ids of each pre-token; line feeds have none."""
        coded = pieces.dictionary_encode()
        return self.piece_cache.complete(coded.dictionary, self.merge).take(coded.indices.to_numpy())

    def merge(self, pieces: pa.Array) -> Ragged:
        """Ids of each pre-token by the vocabulary's merges, lowest rank first, leftmost first; line feeds have none."""
        data, ends = bytes_of(pieces)
        starts, lengths = ends[:-1], np.diff(ends)
        lengths = np.where((lengths == 1) & (data[np.minimum(starts, max(len(data) - 1, 0))] == 10), 0, lengths) if len(data) else lengths
        order = np.argsort(lengths, kind="stable")
        short = order[(lengths[order] > 0) & (lengths[order] <= _WIDE)]
        rows, sizes, ids = [order[lengths[order] == 0]], [], []
        sizes.append(np.zeros(len(rows[0]), dtype=np.int64))
        for at in range(0, len(short), 20_000):
            self._merge_table(data, starts, lengths, short[at : at + 20_000], rows, sizes, ids)
        for i in order[lengths[order] > _WIDE]:
            ids.append(self._merge_long(data[starts[i] : starts[i] + lengths[i]]))
            rows.append(np.array([i]))
            sizes.append(np.array([len(ids[-1])]))
        done = Ragged.of(np.concatenate([NO_LISTS.ids, *ids]), np.concatenate(sizes))
        return done.take(np.argsort(np.concatenate(rows)))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.pad + 1) + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NO_RANK)

    def _merge_table(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, out_rows: list, out_sizes: list, out_ids: list) -> None:
        def emit(symbols: np.ndarray, done: np.ndarray) -> None:
            held = symbols != self.pad
            out_rows.append(done)
            out_sizes.append(held.sum(axis=1))
            out_ids.append(symbols[held].astype("<u4"))

        size = lengths[rows]
        width = int(size.max())
        flat = data[np.repeat(starts[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        held = np.arange(width) < size[:, None]
        symbols = np.full((len(rows), width + 1), self.pad, dtype=np.int64)
        symbols[:, :width][held] = self._inner[flat]
        last = np.cumsum(size) - 1
        symbols[np.arange(len(rows)), size - 1] = self._final[flat[last]]
        left, right = symbols[:, :-1], symbols[:, 1:]
        ranks = np.where(right < self.pad, self._first_ranks[np.minimum(left * 512 + right, 512 * 512 - 1)], _NO_RANK)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            going = best < _NO_RANK
            if not going.all():
                emit(symbols[~going], rows[~going])
                rows, symbols, ranks, at, best = rows[going], symbols[going], ranks[going], at[going], best[going]
                if not len(rows):
                    return
            every = np.arange(len(rows))
            symbols[every, at] = self._made[best]
            column = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, column + (column > at[:, None]), axis=1)
            if symbols.shape[1] == 1:
                emit(symbols, rows)
                return
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column > at[:, None]), axis=1)
            here = np.minimum(at, symbols.shape[1] - 2)
            ranks[every, here] = self._rank(symbols[every, here], symbols[every, here + 1])
            before = np.maximum(at - 1, 0)
            ranks[every, before] = self._rank(symbols[every, before], symbols[every, before + 1])

    def _merge_long(self, piece: np.ndarray) -> np.ndarray:
        """The same merges by a heap over a linked list: n log n for very long words."""
        symbols = self._inner[piece].tolist()
        symbols[-1] = int(self._final[piece[-1]])
        n, base, made = len(symbols), self.pad + 1, self._made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self._rank_of.get
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank_of(symbols[i] * base + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = int(made[rank]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(symbols[i] * base + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := rank_of(symbols[h] * base + symbols[i])) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return np.array([s for s in symbols if s >= 0], dtype="<u4")

    # -- texts ---------------------------------------------------------------------------------
    def encode_batch(self, texts: pa.Array, missing: Callable[[pa.Array], Ragged] | None = None) -> Ragged:
        """The ids of each text. Words that the memo lacks are encoded by `missing`, or else merged."""
        words, codes, ends = words_of(texts)
        return self.cache.complete(words, missing or self.encode_words).take(codes).joined(ends)

    @cached_property
    def _token_column(self) -> pa.Array:
        return pa.array(self.tokens.tolist(), pa.string())

    def decode_batch(self, coded: Ragged) -> pa.Array:
        """The library's decode with special tokens kept: without a decoder in the file, tokens joined by spaces."""
        tokens = self._token_column.take(pa.array(coded.ids.astype(np.int32)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(coded.ends.astype(np.int32)), tokens), " ")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 0
    for b in range(256):
        if b in printable:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


_encoders: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """One encoder for each worker process and vocabulary; its memo lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    return _encoders[path]
