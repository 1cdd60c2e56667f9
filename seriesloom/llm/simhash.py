"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints lie in tiles by their population count.  Two fingerprints at a Hamming distance of r have
population counts at most r apart, so only such tile pairs meet.  Where a tile would grow beyond `tile_rows`
fingerprints, tiles are those of the counts of both halves, or of all four quarters, under the same bound on the
sum of differences; beyond that a salt splits them.  Within a tile pair the bound on the quarters skips further
blocks; what is left is compared by exclusive-or and bit counts.  A tile pair returns a spanning forest of its
links, never all pairs, and components are found over these.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import cut, discard, ship, slices

BLOCK = 1 << 21
FLUSH = 1 << 19


def fingerprints(texts: list[str | None], words: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text over `words`-word shingles, repeats included; A-Z in lower case."""
    out = np.zeros(len(texts), dtype="<u8")
    hashes: list[int] = []
    sizes: list[int] = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        held = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if len(held) <= words:
            if held:
                hashes.append(digest(b" ".join(held), seed))
            sizes.append(min(1, len(held)))
            continue
        joined = b" ".join(held)
        ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
        starts = [0, *ends[:-words].tolist()]
        hashes += [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
        sizes.append(len(held) - words + 1)
    count = np.array(sizes, dtype=np.int64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    table = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    starts = np.cumsum(count) - count
    per_text = np.empty((len(full), 64), dtype=np.int64)
    for k, i in enumerate(full):
        rows = table[starts[i] : starts[i] + count[i]]
        per_text[k] = sum(np.unpackbits(rows[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for at in range(0, len(rows), 65_536))
    out[full] = np.packbits(2 * per_text > count[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


@F.arrow_udf(T.LongType())
def fingerprint_column(texts: pa.Array) -> pa.Array:
    parts = [fingerprints(p.column("text").to_pylist()) for p in slices(pa.record_batch([texts], names=["text"]), "text")]
    return pa.array(np.concatenate([np.zeros(0, "<u8"), *parts]).view("<i8"))


def unite(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after the edges left-right; a label is the least place in its component."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, shorter := label[label]):
            label = shorter


def compare(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or within one: places in left followed by right."""
    every = left if right is None else np.concatenate([left, right])
    other, shift = (left, 0) if right is None else (right, len(left))
    label = np.arange(len(every))
    quarters = lambda x: np.bitwise_count(np.ascontiguousarray(x).view("<u2").reshape(-1, 4)).astype(np.int64)

    def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = quarters(x)
        key = q @ np.array([1, 17, 289, 4913])
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0]) if len(x) else np.zeros(0, np.int64)
        return order, np.r_[starts, len(x)], q[order[starts]]

    order_a, bounds_a, cells_a = cells(left)
    order_b, bounds_b, cells_b = cells(other)
    sizes_b = np.diff(bounds_b)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for k, cell in enumerate(cells_a):
        near = np.abs(cells_b - cell).sum(axis=1) <= radius
        if right is None:
            near[:k] = False
        if not near.any():
            continue
        places = order_b[np.repeat(near, sizes_b)]
        own = order_a[bounds_a[k] : bounds_a[k + 1]]
        values = other[places]
        step = max(1, BLOCK // len(own))
        for at in range(0, len(places), step):
            i, j = np.nonzero(np.bitwise_count(left[own][:, None] ^ values[None, at : at + step]) <= radius)
            i, j = own[i], places[at + j] + shift
            linked = label[i] != label[j]
            if linked.any():
                held.append((i[linked], j[linked]))
                waiting += int(linked.sum())
            if waiting > FLUSH:
                label = unite(label, *map(np.concatenate, zip(*held, strict=True)))
                held, waiting = [], 0
    if held:
        label = unite(label, *map(np.concatenate, zip(*held, strict=True)))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return every[moved], every[label[moved]]


def _offsets(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of `parts` counts whose sizes sum to at most `radius`."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(parts):
        out = [(*o, d) for o in out for d in range(-radius, radius + 1) if sum(map(abs, o)) + abs(d) <= radius]
    return out


def _cell(parts: int) -> Column:
    """The population counts of `parts` equal parts of `f`, as one number."""
    width, base = 64 // parts, 64 // parts + 1
    counts = [F.bit_count("f")] if parts == 1 else [F.bit_count(F.shiftrightunsigned("f", width * i).bitwiseAND(F.lit((1 << width) - 1))) for i in range(parts)]
    return sum((c * base**i for i, c in enumerate(counts)), F.lit(0)).cast("int")


def links(distinct: DataFrame, column: str, radius: int = 4, tile_rows: int = 32_768) -> DataFrame:
    """Links (a, b) that join all fingerprints of one component; `column` holds each fingerprint once."""
    codes = distinct.select(F.col(column).alias("f"))
    for parts in (1, 2, 4):  # 65, 1 089 or 83 521 tiles at most
        sizes = codes.groupBy(_cell(parts).alias("c")).agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).collect()[0][0] or 0) <= tile_rows:
            break
    base = 64 // parts + 1
    salts = cut(sizes.select("c", F.ceil(F.col("n") / tile_rows).cast("int").alias("salts")), "tiles")
    placed = codes.withColumn("c", _cell(parts)).join(F.broadcast(salts), "c")
    placed = placed.select("f", "c", F.pmod(F.xxhash64("f"), "salts").cast("int").alias("s"))
    digits = [F.floor(F.col("c") / base**i).cast("int") % base for i in range(parts)]
    near = F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(o)]) for o in _offsets(parts, radius)])
    met = placed.withColumns({f"x{i}": x for i, x in enumerate(digits)}).withColumn("o", F.explode(near))
    moved = [F.col(f"x{i}") + F.col(f"o.d{i}") for i in range(parts)]
    within = [m.between(0, base - 1) for m in moved]
    met = met.where(reduce(lambda x, y: x & y, within)).select("f", "c", "s", sum((m * base**i for i, m in enumerate(moved)), F.lit(0)).cast("int").alias("q"))
    met = met.join(F.broadcast(salts.toDF("q", "other")), "q").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    first = (F.col("c") < F.col("q")) | ((F.col("c") == F.col("q")) & (F.col("s") <= F.col("t")))
    pair = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    met = met.select("f", first.alias("first"), pair("c", "q").alias("c1"), pair("s", "t").alias("s1"), pair("q", "c").alias("c2"), pair("t", "s").alias("s2"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        f = group.column("f").to_numpy().view(np.uint64)
        first = group.column("first").to_numpy()
        c1, s1, c2, s2 = (k.as_py() for k in key)
        a, b = compare(f, None, radius) if (c1, s1) == (c2, s2) else compare(f[first], f[~first], radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return met.groupBy("c1", "s1", "c2", "s2").applyInArrow(run, "a long, b long")


def _classes(prints: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """(f, root, component_id) for each distinct fingerprint of (doc_id, f)."""
    distinct = cut(prints.groupBy("f").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(links(distinct, "f", radius, tile_rows)).withColumnRenamed("node", "f")
    roots = distinct.join(linked, "f").groupBy("component").agg(F.min("least").alias("smallest"))
    named = distinct.join(linked.join(roots, "component"), "f", "left")
    return named.select("f", F.coalesce("component", "f").alias("root"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id"))


def _prints(docs: DataFrame, id: str, text: str) -> DataFrame:
    ship(docs.sparkSession)
    return cut(docs.select(F.col(id).alias("doc_id"), fingerprint_column(F.col(text).cast("string")).alias("f")), "fingerprints")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 4, tile_rows: int = 32_768) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row.

    Null or blank texts have fingerprint zero and are linked like others.  Repeated rows are returned each.
    A null id is no candidate for a component's smallest id; a component of null ids only has a null id.
    Extra columns of `docs` are not read.  An empty table gives an empty result.
    """
    prints = _prints(docs, id, text)
    named = _classes(prints, radius, tile_rows).select("f", "component_id")
    found = cut(prints.join(named, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"), "components")
    discard(prints)
    return found


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 4, tile_rows: int = 32_768) -> DataFrame:
    """`docs` with exactly one row of each component: one that has the smallest id, of these the one whose text
    has the least hash.

    Rows are told apart by their place in a written copy, so ids may repeat, over equal or different texts.  A
    component keeps a row without an id only if it has no other.
    """
    ship(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    own, body = F.col(names[docs.columns.index(id)]), F.col(names[docs.columns.index(text)]).cast("string")
    marked = cut(held.select("*", fingerprint_column(body).alias("f"), F.xxhash64(body).alias("h"), F.monotonically_increasing_id().alias("row")), "marked")
    named = _classes(marked.select(own.alias("doc_id"), "f"), radius, tile_rows).select("f", "root")
    first = marked.select("f", F.struct(own.isNull().alias("bare"), own.alias("id"), "h", "row").alias("place")).join(named, "f")
    kept = first.groupBy("root").agg(F.min("place").alias("place")).select("place.row")
    return marked.join(kept, "row", "left_semi").select(*names).toDF(*docs.columns)
