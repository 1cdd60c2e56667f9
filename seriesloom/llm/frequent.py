"""Frequent words of a corpus by mergeable summaries: no word is ever a shuffle key.

Each task counts its words in a bounded table; when the table is full, its median count is taken from every
entry and what falls to zero goes (the Misra-Gries rule, many entries at a time).  A task hands on one row
with its `k` largest entries; rows meet in groups of `FAN_IN`, level by level, until one row is left.
All rows of the table are counted.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import lines_of, words_of
from .shared import slices

FAN_IN = 16


def shrink(counts: Counter, keep: int) -> None:
    if len(counts) <= keep:
        return
    values = np.fromiter(counts.values(), np.int64, len(counts))
    less = int(np.partition(values, len(values) - keep)[len(values) - keep])
    for w in [w for w, n in counts.items() if n <= less]:
        del counts[w]
    for w in counts:
        counts[w] -= less


def pack(counts: Counter, k: int) -> bytes:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    data = "\n".join([w for w, _ in top]).encode("utf-8", "surrogatepass")
    return zlib.compress(np.array([len(top), *[n for _, n in top]], dtype="<i8").tobytes() + data, 1)


def unpack(blob: bytes) -> dict[str, int]:
    data = zlib.decompress(blob)
    n = int(np.frombuffer(data[:8], dtype="<i8")[0])
    if not n:
        return {}
    words = data[8 + 8 * n :].decode("utf-8", "surrogatepass").split("\n")
    return dict(zip(words, np.frombuffer(data[8 : 8 + 8 * n], dtype="<i8").tolist(), strict=True))


def frequent_words(docs: DataFrame, text: str, k: int = 32_768, table: int = 262_144) -> dict[str, int]:
    """At most `k` space-delimited words with (under-estimated) counts; nulls have no words, ties go by word.

    `k` bounds what reaches the driver, `table` a task's memory.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                words, codes, _ = words_of(part.column("text"))
                counts.update(dict(zip(lines_of(words).split("\n"), np.bincount(codes, minlength=len(words)).tolist(), strict=True)) if len(words) else {})
                counts.pop("", None)
                if len(counts) > table:
                    shrink(counts, table // 2)
        context = TaskContext.get()
        yield pa.RecordBatch.from_pydict({"at": [context.partitionId() if context else 0], "summary": [pack(counts, k)]}, schema=pa.schema([("at", pa.int64()), ("summary", pa.binary())]))

    def merge(group: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for blob in group.column("summary").to_pylist():
            counts.update(unpack(blob))
            if len(counts) > table:
                shrink(counts, table // 2)
        return pa.table({"at": [group.column("at")[0].as_py() // FAN_IN], "summary": [pack(counts, k)]}, schema=pa.schema([("at", pa.int64()), ("summary", pa.binary())]))

    texts = docs.select(F.col(text).cast("string").alias("text"))
    left = texts.rdd.getNumPartitions()
    rows = texts.mapInArrow(count, "at long, summary binary")
    while left > 1:
        rows = rows.groupBy(F.floor(F.col("at") / FAN_IN)).applyInArrow(merge, "at long, summary binary")
        left = -(-left // FAN_IN)
    found = rows.collect()
    counts: Counter = Counter()
    for row in found:
        counts.update(unpack(row["summary"]))
    return dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k])
