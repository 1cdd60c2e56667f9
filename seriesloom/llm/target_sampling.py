"""Importance resampling towards a target: hashed word features, gains by bucket, Gumbel scores (Xie et al., 2023).

The dictionary of frequent words is an Aho-Corasick automaton over words with a delimiter on either side; each
carries its CRC-32 and its length.  A scan of the text emits these payloads in order.  What lies between two
matches are words beyond the dictionary, whose payloads are computed on the spot, so the dictionary changes the
speed but no result.  Runs of words get their CRC by composing neighbouring payloads, without their text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frequent import frequent_words
from .plain_words import PLAIN, packed, plain_words, unpacked
from .shared import cut, discard, ship, slices

_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
_KEYS: dict[tuple[str, ...], tuple] = {}


# -- payloads --------------------------------------------------------------------------------------
@lru_cache(64)
def _doubled(power: int) -> np.ndarray:
    """Tables (4 x 256) that carry a CRC past 2^power zero bytes: linear over bits, so one table for each byte."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if power:
        image = advance(_doubled(power - 1), advance(_doubled(power - 1), bits))
    else:
        step = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], dtype=np.uint32)
        image = (bits >> np.uint32(8)) ^ step[bits & np.uint32(255)]
    tables = np.zeros((4, 256), dtype=np.uint32)
    for b in range(32):
        tables[b // 8] ^= np.where(np.arange(256) >> (b % 8) & 1, image[b], np.uint32(0)).astype(np.uint32)
    return tables


def advance(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def compose(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of left + right from both CRCs and the right parts' lengths in bytes."""
    out = left.astype(np.uint32)
    for power in range(int(sizes.max()).bit_length() if len(sizes) else 0):
        on = np.flatnonzero(sizes >> power & 1)
        out[on] = advance(_doubled(power), out[on])
    return out ^ right.astype(np.uint32)


def automaton(words: tuple[str, ...]) -> tuple[ahocorasick.Automaton, np.ndarray, np.ndarray]:
    """Automaton, CRCs and byte lengths of the words; words are bytes read as latin-1, so places are bytes."""
    if words not in _KEYS:
        _KEYS.clear()
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(words):
            found.add_word(f" {w} ", i)
        if words:
            found.make_automaton()
        held = [w.encode("latin-1") for w in words]
        _KEYS[words] = found, np.array([zlib.crc32(w) for w in held], dtype=np.uint32), np.array([len(w) for w in held], dtype=np.int64)
    return _KEYS[words]


def payloads(texts: list[bytes | None], words: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 and byte length of each word of the texts, in order, and the number of words of each text."""
    found, crcs, lengths = automaton(words)
    parts = [b" ".join(t.translate(PLAIN).split()) if t else b"" for t in texts]
    counts = np.fromiter((p.count(b" ") + 1 if p else 0 for p in parts), np.int64, len(parts))
    whole = b" " + b"  ".join(parts) + b" "
    seen = np.fromiter(chain.from_iterable(found.iter(whole.decode("latin-1"))), np.int64).reshape(-1, 2) if words else np.zeros((0, 2), np.int64)
    ends, which = seen[:, 0], seen[:, 1]
    starts = ends - lengths[which] - 1 if len(which) else ends
    crc, size, place = crcs[which], lengths[which], starts
    left, right = np.r_[0, ends], np.r_[starts, len(whole) - 1]
    rest: list[tuple[int, int, int]] = []
    for a, b in zip(*(x[np.flatnonzero(right > left)].tolist() for x in (left, right)), strict=True):
        missed = whole[a:b].split()
        if missed:
            at = [a, *accumulate((len(w) + 1 for w in missed), initial=a)][1:-1]
            rest += [(zlib.crc32(w), len(w), p) for w, p in zip(missed, at, strict=True)]
    if rest:
        more = np.array(rest, dtype=np.int64)
        order = np.argsort(np.r_[place, more[:, 2]], kind="stable")
        crc, size = np.r_[crc, more[:, 0].astype(np.uint32)][order], np.r_[size, more[:, 1]][order]
    return crc, size, counts


def buckets_of(texts: list[bytes | None], words: tuple[str, ...], runs: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's feature buckets (runs of 1 to `runs` words), and its number of words."""
    crc, size, counts = payloads(texts, words)
    owner = np.repeat(np.arange(len(texts)), counts)
    space = np.uint32(zlib.crc32(b" "))
    spaced = compose(np.full(len(crc), space), crc, size) if runs > 1 else crc
    values, owners, now, at = [crc % np.uint32(buckets)], [owner], crc, np.arange(len(crc))
    for n in range(2, runs + 1):
        more = at + n - 1 < len(crc)
        now, at = now[more], at[more]
        inside = owner[at] == owner[at + n - 1]
        now, at = now[inside], at[inside]
        now = compose(now, spaced[at + n - 1], size[at + n - 1] + 1)
        values.append(now % np.uint32(buckets))
        owners.append(owner[at])
    every, whose = np.concatenate(values), np.concatenate(owners)
    every = every[np.argsort(whose, kind="stable")]
    return np.split(every, np.cumsum(np.bincount(whose, minlength=len(texts)))[:-1]) if texts else [], counts


# -- operator --------------------------------------------------------------------------------------
def dictionary(docs: DataFrame, text: str, size: int) -> tuple[str, ...]:
    """At most `size` frequent words of all texts, as latin-1 strings of their bytes."""
    plain = F.translate(F.regexp_replace(F.col(text).cast("string"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), _UPPER, _LOWER)
    found = frequent_words(docs.select(plain.alias("text")), "text", size)
    return tuple(sorted({b.decode("latin-1") for w in found for b in plain_words(w.encode("utf-8", "surrogatepass"))}))


def features(docs: DataFrame, id: str, text: str, words: tuple[str, ...], runs: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, buckets as little-endian 32-bit numbers) for each row, written."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                found, counts = buckets_of(part.column("text").to_pylist(), words, runs, buckets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array([len(x) for x in found], pa.int64()), packed(found, kind)], schema=schema)

    held = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return cut(held.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary"), "features")


def bucket_counts(found: DataFrame, buckets: int) -> dict[int, int]:
    """Features in each bucket over all rows; tasks hand on their own counts, at most `buckets` rows each."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column("buckets"), kind)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in counts.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln) of the target's smoothed share over the source's, for each bucket."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (s_all + buckets) / ((source.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)], dtype=np.int64)


def noise(id: Column, seed: str) -> Column:
    """floor(1000 * Gumbel), by sha256 over seed and id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """`scored` with `rank`, for the floor(percent N / 100) best of the N rows with enough words; others have null.

    Rows are dealt to ordered ranges and numbered within each; ranges' sizes give the offsets.  Rows equal in
    score and id are told apart by a running number, so no range is a single key's.
    """
    numbered = scored.withColumn("_row", F.monotonically_increasing_id())
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("_row")]
    can = numbered.where(F.col("n_words") >= least_words)
    parts = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = cut(can.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(r) for r in sorted_rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each range
    total = sum(n for _, n in sizes)
    offsets = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    before = F.element_at(F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]), part) if offsets else F.lit(0)
    rank = (before + place + 1).cast("long")
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawn = sorted_rows.select(*names, F.when(rank <= percent * total // 100, rank).alias("rank"))
    return drawn.unionByName(scored.where(F.coalesce(F.col("n_words") < least_words, F.lit(True))).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", runs: int = 1, buckets: int = 10_000, seed: str = "2024", percent: int = 10, least_words: int = 20, words: int = 32_768) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row; rank is null for rows that aren't drawn.

    Null and empty texts have no words, a weight of 0 and are never drawn.  Repeated rows count each and get ranks
    of their own.  Of equal scores the smaller id goes first, a null id last.  With an empty target all counts of
    the target are 0; an empty table gives an empty result.  Other columns are not read.  `words` bounds the
    dictionary that is sent to the workers, `buckets` what the driver collects.
    """
    ship(docs.sparkSession)
    known = dictionary(docs, text, words)
    held = features(docs, id, text, known, runs, buckets)
    aims = features(target.withColumn("_none", F.lit(None).cast("long")).select("_none", target_text), "_none", target_text, known, runs, buckets)
    gain = gains(bucket_counts(held, buckets), bucket_counts(aims, buckets), buckets)
    discard(aims)
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = unpacked(batch.column("buckets"), kind)
            sums = np.r_[0, np.cumsum(gain[flat])]
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(sums[ends] - sums[ends - sizes])], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = held.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    discard(held)
    return draw(scored, percent, least_words)


def sampled_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def oracle_sql() -> str:
    """The query's rows in DuckDB; CRC-32 by its table, over the distinct words' bytes."""
    return r"""WITH tb AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
tw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sw AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM w) GROUP BY 1), bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM tw) GROUP BY 1),
hx AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM sw UNION SELECT word FROM bw)),
bk AS (SELECT word, xor(list_reduce([4294967295] || list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)), lambda c, b: xor(c >> 8, tb.t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket FROM hx, tb),
s AS (SELECT bucket, sum(n) AS s FROM sw JOIN bk USING (word) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM bw JOIN bk USING (word) GROUP BY 1),
al AS (SELECT (SELECT coalesce(sum(n), 0) FROM sw) AS sa, (SELECT coalesce(sum(n), 0) FROM bw) AS ta),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (sa + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (ta + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), al),
f AS (SELECT doc_id, unnest(ws) AS word FROM w),
wt AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN bk USING (word) JOIN g USING (bucket) GROUP BY 1),
sc AS (SELECT w.doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN wt USING (doc_id)),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT sc.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM sc LEFT JOIN rk USING (doc_id)"""
