"""Encoding and decoding by a minimal acyclic transducer over frequent words.

Frequent words are compiled into a minimal acyclic automaton (shared prefixes and suffixes).  Each transition
carries how many words its smaller siblings accept, so the sum along a word's path is the word's number,
which points at its ids.  The automaton is one file: written to the shared folder, sent to the executors as a
Spark file and memory-mapped by their workers, who share its pages.  Words it doesn't accept are merged
exactly.  A worker asks the automaton, or merges, once for each word; a bounded memo holds the answers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import NO_LISTS, Ragged, bytes_of, encoder
from .frequent import frequent_words
from .shared import cut, new_path, ship, slices, tokenizer_path


class _State:
    __slots__ = ("final", "edges", "number", "words")

    def __init__(self) -> None:
        self.final, self.edges, self.number, self.words = False, {}, -1, -1

    def signature(self) -> tuple:
        return self.final, tuple((b, id(s)) for b, s in self.edges.items())


def minimal(words: Iterable[bytes]) -> _State:
    """The minimal automaton of sorted, distinct words, built word by word."""
    root, seen, path = _State(), {}, []
    last = b""

    def close(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            parent.edges[byte] = seen.setdefault(child.signature(), child)

    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        state = path[-1][2] if path else root
        for byte in word[common:]:
            fresh = _State()
            state.edges[byte] = fresh
            path.append((state, byte, fresh))
            state = fresh
        state.final = True
        last = word
    close(0)
    return root


def compile_lexicon(ids_of: dict[str, bytes]) -> bytes:
    """The automaton and the words' ids as one block: a JSON line with the arrays' places, then the arrays."""
    by_bytes = {w.encode("utf-8", "surrogatepass"): ids for w, ids in ids_of.items()}
    ordered = sorted(by_bytes)
    root = minimal(ordered)
    order: list[_State] = []
    stack = [(root, False)]
    while stack:  # children before parents
        state, done = stack.pop()
        if state.number >= 0:
            continue
        if done:
            state.words = state.final + sum(s.words for s in state.edges.values())
            state.number = len(order)
            order.append(state)
        else:
            stack.append((state, True))
            stack.extend((s, False) for s in state.edges.values() if s.number < 0)
    edges = []
    for state in order:
        skipped = int(state.final)
        for byte, target in sorted(state.edges.items()):
            edges.append((state.number * 256 + byte, target.number, skipped))
            skipped += target.words
    edges.sort()
    columns = np.array(edges, dtype=np.int64).reshape(-1, 3)
    lengths = np.array([len(by_bytes[w]) // 4 for w in ordered], dtype=np.int64)
    arrays = {
        "keys": columns[:, 0].astype("<i8"),
        "targets": columns[:, 1].astype("<i4"),
        "skips": columns[:, 2].astype("<i4"),
        "finals": np.array([s.final for s in order], dtype="u1"),
        "places": np.concatenate([[0], np.cumsum(lengths)]).astype("<i4"),
        "ids": np.frombuffer(b"".join(by_bytes[w] for w in ordered), dtype="<u4"),
    }
    places, at = {}, 0
    for name, array in arrays.items():
        places[name] = (at, len(array), array.dtype.str)
        at += -(-array.nbytes // 8) * 8
    head = json.dumps({"arrays": places, "root": root.number, "longest": max(map(len, ordered), default=0)}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype=np.uint8, mode="r")
        with open(path, "rb") as f:
            head = f.readline()
        stated = json.loads(head)
        self.root, self.longest = stated["root"], stated["longest"]
        for name, (at, count, kind) in stated["arrays"].items():
            start = len(head) + at
            setattr(self, name, data[start : start + count * np.dtype(kind).itemsize].view(kind))

    def find(self, words: pa.Array) -> tuple[np.ndarray, Ragged]:
        """Places of those words that the automaton accepts, and their ids; all words walk at once, a byte each step."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64), NO_LISTS
        flat, ends = bytes_of(words)
        at, size = ends[:-1], np.diff(ends)
        rows = np.flatnonzero((size > 0) & (size <= self.longest))
        state, number = np.full(len(rows), self.root, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        ended_rows, ended_numbers = [], []
        step = 0
        while len(rows):
            key = state * 256 + flat[at[rows] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = self.keys[edge] == key
            rows, edge = rows[goes], edge[goes]
            state, number = self.targets[edge].astype(np.int64), number[goes] + self.skips[edge]
            step += 1
            over = size[rows] == step
            accepted = over & (self.finals[state] == 1)
            ended_rows.append(rows[accepted])
            ended_numbers.append(number[accepted])
            rows, state, number = rows[~over], state[~over], number[~over]
        if not ended_rows:
            return np.zeros(0, dtype=np.int64), NO_LISTS
        return np.concatenate(ended_rows), Ragged(self.ids, self.places).take(np.concatenate(ended_numbers))

    def complete(self, words: pa.Array, missing: Callable[[pa.Array], Ragged]) -> Ragged:
        """Ids of each word: those that the automaton doesn't accept come from `missing`."""
        found, known = self.find(words)
        left = np.setdiff1d(np.arange(len(words)), found)
        both = known.then(missing(words.take(pa.array(left))))
        return both.take(np.argsort(np.concatenate([found, left])))


_lexicons: dict[str, Lexicon] = {}


def publish(docs: DataFrame, text: str, path: str, words: int) -> str:
    """Compiles the corpus's frequent words and sends the file to all executors; returns its name."""
    spark = docs.sparkSession
    frequent = list(frequent_words(docs, text, words))
    coded = encoder(path).encode_words(pa.array(frequent, pa.string()))
    block = compile_lexicon({w: coded.ids[a:b].tobytes() for w, a, b in zip(frequent, coded.ends, coded.ends[1:])})
    place = new_path(spark, "lexicon")
    filesystem, base = pafs.FileSystem.from_uri(place)
    filesystem.create_dir(base.rpartition("/")[0], recursive=True)
    with filesystem.open_output_stream(base) as out:
        out.write(block)
    spark.sparkContext.addFile(place)
    return base.rpartition("/")[2]


def encode(docs: DataFrame, text: str = "text", path: str | None = None, words: int = 32_768, name: str = "ids") -> DataFrame:
    """`docs` with each whole text's ids: bytes, little-endian unsigned 32-bit.

    Null or empty texts have no ids.  A column of `docs` that has the new name is replaced.
    """
    ship(docs.sparkSession)
    path = path or tokenizer_path()
    file = publish(docs, text, path, words)

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        if file not in _lexicons:
            _lexicons.clear()
            _lexicons[file] = Lexicon(SparkFiles.get(file))
        lexicon, bpe, out = _lexicons[file], encoder(path), NO_LISTS
        for part in slices(pa.record_batch([texts], names=["text"]), "text"):
            out = out.then(bpe.encode_batch(part.column("text"), lambda words: lexicon.complete(words, bpe.encode_words)))
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((out.ends * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out.ids, dtype="<u4"))])

    return docs.withColumn(name, run(F.col(text).cast("string")))


def decode(coded: DataFrame, ids: str = "ids", path: str | None = None, name: str = "decoded") -> DataFrame:
    """`coded` with the text of its ids, special tokens kept; null ids give an empty text."""
    ship(coded.sparkSession)
    path = path or tokenizer_path()

    @F.arrow_udf("string")
    def run(held: pa.Array) -> pa.Array:
        data, ends = bytes_of(pc.fill_null(held, b""))
        coded = Ragged(data[ends[0] : ends[-1]].view("<u4"), (ends - ends[0]) >> 2)
        return encoder(path).decode_batch(coded)

    return coded.withColumn(name, run(F.col(ids)))


def round_trip(docs: DataFrame) -> DataFrame:
    """The query's columns: digests of ids and of decoded texts, taken from the operators' outputs."""
    coded = encode(docs.select("doc_id", "text")).drop("text")
    both = decode(coded)
    digests = both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
    return cut(digests, "round-trip")
