"""Best-fit decreasing packing of token sequences.

Texts are encoded whole, closed by an end id and cut into pieces of at most `capacity` ids.  Pieces are dealt
into groups of about `group_rows` by a hash of their keys, so that each group has the same mix of sizes, and
each group is packed on its own: largest first, into the open sequence that it fills best.  The tightest
sequence is found by descending a segment tree over remaining capacities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .shared import cut, discard, ship, slices, tokenizer_path


class TightestFit:
    """Open bins by remaining capacity: a segment tree whose leaves are capacities and hold stacks of bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, number: int) -> None:
        self.bins[left].append(number)
        node = left + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes a bin with the least remaining capacity of at least `size`: (capacity, bin)."""
        count, node = self.count, size + self.leaves
        if not count[node]:
            while True:  # up to the first subtree on the right that holds a bin, then down its left side
                if node == 1:
                    return None
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        left = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return left, self.bins[left].pop()


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of each item; sizes are positive and come in decreasing order."""
    tree, opened = TightestFit(capacity), 0
    bins, offsets = [], []
    for size in sizes:
        found = tree.take(size)
        if found is None:
            found = capacity, opened
            opened += 1
        left, number = found
        bins.append(number)
        offsets.append(capacity - left)
        if left > size:
            tree.add(left - size, number)
    return bins, offsets


PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = 4096, end: int = 1, ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each text's ids and the end id, cut into pieces of `capacity`.

    `ids` are bytes, little-endian unsigned 32-bit; without them only their checksum leaves the worker.  Null or
    empty texts give one piece with the end id alone.  Rows that repeat an id have their pieces each; a null id
    stays null.  Other columns are not read; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    path = path or tokenizer_path()
    narrow = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = pa.schema(PIECES if ids else PIECES[:-1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                coded = bpe.encode_batch(part.column("text"))
                sizes = coded.sizes() + 1
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                length = np.minimum(capacity, sizes[doc] - piece * capacity)
                closed = np.insert(coded.ids, coded.ends[1:], end).astype("<u4", copy=False)
                at = np.cumsum(length) - length
                held = [memoryview(closed[a : a + n]).cast("B") for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(doc)), piece.astype(np.int32), piece * capacity, length, list(map(zlib.crc32, held))]
                columns += [list(map(bytes, held))] if ids else []
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return narrow.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else ""))


def pack(items: DataFrame, size: str = "length", capacity: int = 4096, group_rows: int = 32_768) -> DataFrame:
    """`items` with sequence_id and offset: each item lies in one sequence, gapless from 0.

    Sizes are 1 to `capacity`.  `items` must be a written table: it is counted, then its rows are dealt into groups
    by their number, so that rows alike in any column don't meet.  Repeated rows are packed each.  An empty table
    gives an empty result.
    """
    groups = max(1, -(-items.count() // group_rows))
    dealt = items.withColumn("packing_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column(size).to_numpy()
        order = np.argsort(-lengths, kind="stable")
        table = table.take(pa.array(order))
        bins, offsets = best_fit(lengths[order].tolist(), capacity)
        first = table.column("packing_group")[0].as_py() << 32
        return table.append_column("sequence_id", pa.array(np.array(bins, dtype=np.int64) + first)).append_column("offset", pa.array(offsets, pa.int64()))

    return dealt.groupBy("packing_group").applyInArrow(run, schema).drop("packing_group")


def pack_documents(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """The query's columns: pieces with a digest of their ids, packed; ids stay in the task that made them."""
    items = cut(pieces(docs, capacity=capacity, ids=False), "pieces")
    packed = cut(pack(items, capacity=capacity), "packed")
    discard(items)
    return packed
