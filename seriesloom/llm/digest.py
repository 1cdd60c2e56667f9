"""Document fingerprints from improbable features.

Every window of `WINDOW` bytes has an entropy (exact, over its own bytes).  Windows are ranked by entropy: a window
whose bytes are spread over more values is less probable.  In each neighbourhood of as many windows the rarest,
leftmost first, gets a point; windows with enough points are the features.  Features go into a chain of Bloom filters,
and two fingerprints are compared by their filters' bit overlap, normalised between what chance gives and the most
that is possible.  All lengths are treated alike.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ship, slices

WINDOW, POINTS = 12, 2
BITS = 2048
SUBHASHES = 5
PER_FILTER = 160
CUT = 0.3
_MOST = 32  # bytes of a window
_f = np.arange(_MOST + 1, dtype=np.float64)
_f[1:] *= np.log2(_f[1:])
_TERM = np.rint(_f * 65_536).astype(np.int64)  # c log2 c in fixed point: sums are exact
_GAIN = np.diff(_TERM)


def concentration(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Sum of c log2 c over each window's byte counts: the window's entropy falls as it grows."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (n + window) + order
    before, after = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for m in range(1, min(window, n)):
        close = key[m:] - key[:-m] < window
        if not close.any():
            break
        before[m:] += close
        after[:-m] += close
    entering, leaving = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    entering[order], leaving[order] = _GAIN[before], _GAIN[after]
    total = np.cumsum(entering)
    total[window:] -= np.cumsum(leaving)[: n - window]
    return total[window - 1 :]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of `width`."""
    n = len(values)
    if n <= width:
        return values.min(keepdims=True)
    padded = np.full(-(-n // width) * width, np.iinfo(np.int64).max)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def _recurring(data: bytes, rank: np.ndarray, points: np.ndarray, least: int, window: int) -> np.ndarray:
    """Places under `least` points whose windows recur within a window's length and reach it together.

    Where a text repeats a short unit its windows tie, so the points of one content lie on many places.
    """
    low = np.flatnonzero((points > 0) & (points < least))
    same = (np.diff(low) < window) & (np.diff(rank[low]) == 0)
    low = low[np.append(same, False) | np.append(False, same)] if len(low) else low
    chains: dict[bytes, list[int]] = {}
    out: list[int] = []
    reached = lambda c: len(c) > 1 and points[c].sum() >= least
    for p in low.tolist():
        content = data[p : p + window]
        chain = chains.get(content)
        if chain and p - chain[-1] < window:
            chain.append(p)
            continue
        if chain and reached(chain):
            out.append(chain[0])
        chains[content] = [p]
    return np.array(out + [c[0] for c in chains.values() if reached(c)], dtype=np.int64)


def features(text: str, window: int = WINDOW, least: int = POINTS) -> list[int]:
    """Hashes of the selected windows in text order, each once. A text within one window is one feature.

    If no place has enough points those with the most are taken: a text that isn't empty has a feature.
    """
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= window:
        return [xxhash.xxh3_64_intdigest(data)] if data else []
    rank = concentration(np.frombuffer(data, dtype=np.uint8), window)
    best = sliding_least((rank << 32) | np.arange(len(rank)), window) & 0xFFFFFFFF
    points = np.bincount(best)
    least = min(least, len(best))
    places = np.union1d(np.flatnonzero(points >= least), _recurring(data, rank, points, least, window))
    if not len(places):
        places = np.flatnonzero(points == points.max())
    digest = xxhash.xxh3_64_intdigest
    return list(dict.fromkeys([digest(data[p : p + window]) for p in places.tolist()]))


class Fingerprint:
    """A chain of Bloom filters (packed bits, a row each) with their numbers of features."""

    def __init__(self, bits: np.ndarray, counts: np.ndarray):
        self.bits, self.counts = bits, counts
        self.set = np.bitwise_count(bits).sum(axis=1).astype(np.float64)

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        return cls._filled(features(text or ""))

    @classmethod
    def _filled(cls, found: list[int]) -> Fingerprint:
        hashes = np.array(found, dtype=np.uint64)
        number = -(-len(hashes) // PER_FILTER)
        table = np.zeros((number, BITS), dtype=np.uint8)
        row = np.arange(len(hashes)) // PER_FILTER
        for k in range(SUBHASHES):
            table[row, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        return cls(np.packbits(table, axis=1), np.bincount(row, minlength=number))

    def __str__(self) -> str:
        """Filters as features:bits, in order."""
        return ",".join(f"{n}:{base64.b64encode(b.tobytes()).decode()}" for n, b in zip(self.counts, self.bits, strict=True))

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        parts = [p.split(":") for p in text.split(",")] if text else []
        bits = np.frombuffer(b"".join(base64.b64decode(b) for _, b in parts), dtype=np.uint8).reshape(-1, BITS // 8)
        return cls(bits, np.array([int(n) for n, _ in parts], dtype=np.int64))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1: each filter of the shorter chain against its best match, weighted by features.

    Two empty chains are alike (1); an empty and another one are not (0).  Chains of one length are compared
    both ways.
    """
    if not len(a.counts) or not len(b.counts):
        return float(len(a.counts) == len(b.counts))
    shared = np.bitwise_count(a.bits[:, None] & b.bits[None]).sum(axis=2).astype(np.float64)
    chance = a.set[:, None] * b.set[None] / BITS
    most = np.minimum(a.set[:, None], b.set[None])
    least = chance + CUT * (most - chance)
    score = np.clip((shared - least) / np.maximum(most - least, 1e-9), 0.0, 1.0)
    ways = [(score.max(axis=1), a.counts)] if len(a.counts) <= len(b.counts) else []
    ways += [(score.max(axis=0), b.counts)] if len(b.counts) <= len(a.counts) else []
    return float(np.mean([np.average(s, weights=w) for s, w in ways]))


@F.arrow_udf(T.StringType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """The fingerprint of each whole text; null counts as empty, whose fingerprint is the empty string."""
    return pa.array([str(Fingerprint.of(t)) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([likeness(Fingerprint.parse(x or ""), Fingerprint.parse(y or "")) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)])


# -- edited copies -------------------------------------------------------------------------------
ORDER = ["bare", "down", "h"]  # null ids last, ids downwards (complement: no overflow), repeated ids by their text's hash


def _ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, and the columns of ORDER); null texts are empty."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return held.withColumns({"bare": F.col("doc_id").isNull(), "down": F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long"), "h": F.xxhash64("text")})


def _packed(bare: np.ndarray, down: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The three columns of ORDER as byte strings that sort like them."""
    out = np.zeros(len(bare), dtype=[("bare", "u1"), ("down", ">u8"), ("h", ">u8")])
    sign = np.uint64(1 << 63)
    out["bare"], out["down"], out["h"] = bare, down.view(np.uint64) ^ sign, h.view(np.uint64) ^ sign
    return out.view("S17")


def bucket_heads(ordered: DataFrame, bucket_rows: int) -> list[tuple]:
    """The ORDER columns of each bucket's first row: of every `bucket_rows`-th row of a range partition.

    Only these 17 bytes a row are sorted; about one row in `bucket_rows` reaches the driver.
    """

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange(-seen % bucket_rows, batch.num_rows, bucket_rows)))
            seen += batch.num_rows

    keys = ordered.select(*ORDER)
    heads = keys.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(every, keys.schema)
    return sorted({tuple(r) for r in heads.collect()})


def with_next(docs: DataFrame, bucket_rows: int = 2048, most_buckets: int = 200_000, broadcast_rows: int = 20_000) -> tuple[DataFrame, int]:
    """Rows of (doc_id, text) with the columns of ORDER, `bucket` and `guest`: buckets of neighbouring rows, each
    with a guest, the first row of the next bucket (of the last one: the very first row); and the number of buckets.

    A bucket has `bucket_rows` rows at most, however ids are spread, repeat or are null; only rows that have both
    id and text in common share one whatever their number.  Beyond `most_buckets` buckets grow instead, which
    bounds what the driver holds.
    """
    spark = docs.sparkSession
    ordered = _ordered(docs)
    heads = bucket_heads(ordered, max(bucket_rows, -(-docs.count() // most_buckets)))
    columns = [np.array([r[i] for r in heads], dtype=t) for i, t in enumerate((bool, np.int64, np.int64))]
    sent = spark.sparkContext.broadcast(_packed(*columns))

    @F.arrow_udf(T.LongType())
    def bucket(bare: pa.Array, down: pa.Array, h: pa.Array) -> pa.Array:
        rows = _packed(bare.to_numpy(zero_copy_only=False), down.to_numpy(), h.to_numpy())
        return pa.array(np.searchsorted(sent.value, rows, side="right") - 1)

    placed = ordered.withColumn("bucket", bucket(*ORDER))
    visits = spark.createDataFrame([(*r, (i - 1) % len(heads)) for i, r in enumerate(heads)], "bare boolean, down long, h long, visits long")
    first = ordered.join(F.broadcast(visits) if len(heads) <= broadcast_rows else visits, ORDER).dropDuplicates(["visits"])
    guests = first.select("doc_id", "text", *ORDER, F.col("visits").alias("bucket"), F.lit(True).alias("guest"))
    return placed.withColumn("guest", F.lit(False)).select(*guests.columns).union(guests), len(heads)


def edited(text: str, following: str) -> str:
    """`text` with its last third replaced by as many first characters of the following one, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


REPORT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def edited_report(docs: DataFrame, bucket_rows: int = 2048) -> DataFrame:
    """Fingerprints of each text and of its edited copy, with their likeness and that to the next text.

    Null texts count as empty.  Rows that share an id follow each other by their text's hash; null ids come last.
    A single row is its own next.  Repeated rows are returned each.  Other columns are not read; an empty table
    gives an empty result.  Rows stream through a task in order, so it holds a batch of texts at most.
    """
    import hashlib

    ship(docs.sparkSession)
    schema = pa.schema(REPORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        print_of = lru_cache(4)(Fingerprint.of)  # repeated rows follow each other
        held = None  # the row before: its bucket, id, text and fingerprint
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for place, guest, doc, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")), strict=True):
                    own = print_of(text)
                    if held is not None and held[0] == place:
                        copy = edited(held[2], text)
                        other = print_of(copy)
                        out.append((held[1], len(held[2]), hashlib.sha256(copy.encode()).hexdigest(), str(held[3]), str(other), likeness(held[3], other), likeness(held[3], own)))
                    held = None if guest else (place, doc, text, own)
                columns = zip(*out, strict=True) if out else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    placed, buckets = with_next(docs, bucket_rows)
    sorted_rows = placed.repartitionById(max(1, buckets // 4), F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", *ORDER, "text")
    return sorted_rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
