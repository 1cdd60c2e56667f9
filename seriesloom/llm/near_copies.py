"""Near copies: a five-word Jaccard similarity of 0.8 or more, by wide SimHash and an exact check.

Candidates: fingerprints have 256 bits over the set of five-word shingles.  The share of differing bits estimates the
angle between two sets: at a Jaccard similarity of 0.8 it is arccos(2 * 0.8 / 1.8) / pi, 38.8 bits, with a deviation
of 5.7.  `RADIUS` lies nearly three deviations above; unrelated sets differ in 128 bits, with a deviation of 8.  Sets
meet in tiles by size: a bucket is as wide as the size ratio allows, so only neighbouring buckets meet.  Within a
tile pair, fingerprints are compared by exclusive-or and bit counts; blocks whose population counts differ beyond the
radius are skipped.  A tile pair returns a spanning forest, never all pairs.

Check: only texts of a candidate component of two or more bring their shingles.  Small components share a task, large
ones lie in tiles of bounded bytes that meet pairwise.  There shingles that two sets share are counted exactly, and
only similarities of 0.8 or more unite; again a forest is returned.  So every link is true, and a link is lost only
where fingerprints differ beyond the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import cut, ship, slices
from .simhash import BLOCK, FLUSH, unite

WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5  # similarity 0.8, compared in integers
LANES, RADIUS = 4, 55
_STEPS = (np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def shingles(text: str | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Hashes of the set of `words`-word shingles in ascending order; A-Z in lower case.

    A text of fewer words is one shingle; a blank one has none.
    """
    held = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(held)
    if len(held) <= words:
        return np.array([digest(joined, seed)] if held else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
    starts = [0, *ends[:-words].tolist()]
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """LANES 64-bit words; each lane's bits are the majority over the set's mixed hashes (none: zero)."""
    if not len(own):
        return np.zeros(LANES, dtype="<u8")
    ones = np.zeros(64 * LANES, dtype=np.int64)
    for at in range(0, len(own), 16_384):
        z = own[None, at : at + 16_384] + _STEPS  # the finaliser of splitmix64, a stream for each lane
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        bits = np.unpackbits(np.ascontiguousarray(z.T).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(own), bitorder="little").view("<u8")


MARK = T.StructType([T.StructField("f", T.BinaryType()), T.StructField("g", T.BinaryType()), T.StructField("size", T.LongType())])


@F.arrow_udf(MARK)
def marks(texts: pa.Array) -> pa.Array:
    prints, sets, sizes = [], [], []
    for part in slices(pa.record_batch([texts], names=["text"]), "text"):
        for text in part.column("text").to_pylist():
            own = shingles(text)
            prints.append(fingerprint(own).tobytes())
            sets.append(xxhash.xxh3_128_digest(own.tobytes()))
            sizes.append(len(own))
    return pa.StructArray.from_arrays([pa.array(prints, pa.binary()), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64())], ["f", "g", "size"])


def compare(left: tuple, right: tuple | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or within one: places in left followed by right.

    A tile is (fingerprints as rows of 64-bit words, sizes).
    """
    within = right is None
    (fa, na), (fb, nb) = left, left if within else right
    shift = 0 if within else len(na)
    ca, cb = np.bitwise_count(fa).sum(axis=1, dtype=np.int64), np.bitwise_count(fb).sum(axis=1, dtype=np.int64)
    order_a, order_b = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    sorted_b = cb[order_b]
    label = np.arange(len(na) + (0 if within else len(nb)))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    rows = 256
    for at in range(0, len(order_a), rows):
        own = order_a[at : at + rows]
        low, high = np.searchsorted(sorted_b, ca[own[0]] - radius, "left"), np.searchsorted(sorted_b, ca[own[-1]] + radius, "right")
        low = max(low, at) if within else low  # earlier rows have met this block
        step = max(1, BLOCK // (8 * rows))
        for start in range(low, high, step):
            other = order_b[start : min(high, start + step)]
            most = sum(np.bitwise_count(fa[own, k][:, None] ^ fb[other, k][None]) for k in range(LANES - 1))  # nearly all unrelated ones go here
            i, j = np.nonzero(most <= radius)
            i, j = own[i], other[j]
            linked = label[i] != label[j + shift]
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            near = np.bitwise_count(fa[i] ^ fb[j]).sum(axis=1, dtype=np.int64) <= radius
            near &= DENOMINATOR * np.minimum(na[i], nb[j]) >= NUMERATOR * np.maximum(na[i], nb[j])
            i, j = i[near], j[near] + shift
            held.append((i, j))
            waiting += len(i)
            if waiting > FLUSH // 8:
                label = unite(label, *map(np.concatenate, zip(*held, strict=True)))
                held, waiting = [], 0
    if held:
        label = unite(label, *map(np.concatenate, zip(*held, strict=True)))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def candidates(nodes: DataFrame, tile_rows: int = 16_384) -> DataFrame:
    """Links (a, b) that join the nodes of each candidate component; `nodes` is a written table of (node, f, size)."""
    bucket = F.floor(F.ln(F.greatest("size", F.lit(1)).cast("double")) / math.log(DENOMINATOR / NUMERATOR)).cast("int")
    tiles = nodes.where("size > 0").withColumn("b", bucket)
    counts = {r["b"]: r["n"] for r in tiles.groupBy("b").agg(F.count("*").alias("n")).collect()}  # a row for each bucket, some 100
    salts = F.array(*[F.lit(-(-counts.get(b, 0) // tile_rows)) for b in range(max(counts, default=0) + 2)])
    placed = tiles.withColumn("s", F.pmod(F.xxhash64("node"), F.get(salts, F.col("b"))).cast("int"))
    met = placed.withColumn("q", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))).where((F.col("q") >= 0) & (F.get(salts, F.col("q")) > 0))
    met = met.withColumn("t", F.explode(F.sequence(F.lit(0), F.get(salts, F.col("q")) - 1)))
    first = (F.col("b") < F.col("q")) | ((F.col("b") == F.col("q")) & (F.col("s") <= F.col("t")))
    pair = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    met = met.select("node", "f", "size", first.alias("first"), pair("b", "q").alias("b1"), pair("s", "t").alias("s1"), pair("q", "b").alias("b2"), pair("t", "s").alias("s2"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, first, size = (group.column(c).to_numpy() for c in ("node", "first", "size"))
        prints = np.frombuffer(b"".join(group.column("f").to_pylist()), dtype="<u8").reshape(-1, LANES)
        b1, s1, b2, s2 = (k.as_py() for k in key)
        if (b1, s1) == (b2, s2):
            every, (a, b) = node, compare((prints, size), None)
        else:
            every, (a, b) = np.concatenate([node[first], node[~first]]), compare((prints[first], size[first]), (prints[~first], size[~first]))
        return pa.table({"a": pa.array(every[a]), "b": pa.array(every[b])})

    return met.groupBy("b1", "s1", "b2", "s2").applyInArrow(run, "a long, b long")


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Labels of the components of sets linked at the similarity: the least place of each.

    A set is compared with all others at once, by counting the sets that hold its hashes.  Pairs in one component need
    no look, so sets of the largest component wait: the others are compared with them.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    label = np.arange(len(sets))
    if len(sets) < 2:
        return label
    flat = np.concatenate(sets)
    code = np.unique(flat, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    holders = owner[np.argsort(code, kind="stable")]
    ends = np.cumsum(np.bincount(code))
    first = np.cumsum(sizes) - sizes
    done = np.zeros(len(sets), dtype=bool)

    def look(i: int) -> np.ndarray:
        """The sets in other components that are similar to set i."""
        own = code[first[i] : first[i] + sizes[i]]
        low, high = np.where(own > 0, ends[own - 1], 0), ends[own]
        width = high - low
        at = np.arange(width.sum()) + np.repeat(low - (np.cumsum(width) - width), width)
        shared = np.bincount(holders[at], minlength=len(sets))
        j = np.flatnonzero((shared > 0) & ((NUMERATOR + DENOMINATOR) * shared >= NUMERATOR * (sizes + sizes[i])))  # shared / (sum - shared)
        return j[label[j] != label[i]]

    left = np.argsort(-sizes, kind="stable")
    while len(np.unique(label[left])) > 1:  # pairs of two undone sets in different components are still open
        for n, i in enumerate(left.tolist()):
            if n % 64 == 0:
                largest = int(np.bincount(label).argmax())
            if n and label[i] == largest:
                continue
            done[i] = True
            j = look(i)
            if len(j):
                label = unite(label, np.full(len(j), i), j)
        left = left[~done[left]]
    return label


def verified(members: DataFrame, tile_bytes: int = 2_000_000) -> DataFrame:
    """Links (a, b) that join the nodes of each component of true links; `members` is (node, component, size, text)."""
    own = members.select("node", "component", (8 * F.col("size")).alias("bytes"), "text")
    weights = cut(own.groupBy("component").agg(F.sum("bytes").alias("total")), "weights")
    small = weights.where(F.col("total") <= tile_bytes).agg(F.coalesce(F.sum("total"), F.lit(0))).collect()[0][0]
    bins = max(1, -(-small // tile_bytes))
    tiles = F.ceil(F.col("total") / tile_bytes).cast("int")
    placed = own.join(weights, "component").withColumn("tiles", tiles).withColumn("t", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    alone = F.array(F.struct(F.pmod(F.xxhash64("component"), F.lit(bins)).alias("g"), F.lit(-1).alias("x"), F.lit(-1).alias("y")))
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: o != F.col("t"))  # a pair of tiles compares within each, too
    met = F.transform(others, lambda o: F.struct(F.col("component").alias("g"), F.least("t", o).alias("x"), F.greatest("t", o).alias("y")))
    each = placed.select("node", "text", F.inline(F.when(F.col("tiles") > 1, met).otherwise(alone)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = pa.array([shingles(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "g", "x", "y")), sets], names=["node", "g", "x", "y", "s"])

    def run(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        label = similar([np.frombuffer(s, dtype="<u8") for s in group.column("s").to_pylist()])
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(node[moved]), "b": pa.array(node[label[moved]])})

    return each.mapInArrow(hashed, "node long, g long, x int, y int, s binary").groupBy("g", "x", "y").applyInArrow(run, "a long, b long")


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", tile_rows: int = 16_384, tile_bytes: int = 2_000_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """`docs` with exactly one row of each component of near copies: one that has the smallest id.

    Null or blank texts are copies of each other.  Rows are told apart by their place in a written copy, so ids may
    repeat, over equal or different texts.  A component keeps a row without an id only if it has no other.  An empty
    table gives an empty one; other columns may have any names and keep their values.
    """
    ship(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    own, body = F.col(names[docs.columns.index(id)]), F.col(names[docs.columns.index(text)]).cast("string")
    marked = cut(held.select("*", marks(body).alias("mark"), F.xxhash64(body).alias("h"), F.monotonically_increasing_id().alias("row")), "marked")
    nodes = cut(marked.groupBy("mark.g").agg(F.min("row").alias("node"), F.first("mark.f").alias("f"), F.first("mark.size").alias("size")), "nodes")
    near = cut(components(candidates(nodes, tile_rows)).join(nodes.select("node", "size"), "node"), "near")
    few = near.count() <= broadcast_rows  # 24 bytes a row; beyond that the texts are shuffled
    members = marked.select(F.col("row").alias("node"), body.alias("text")).join(F.broadcast(near) if few else near, "node")
    found = components(verified(members, tile_bytes))
    roots = nodes.join(found, "node", "left").select("g", F.coalesce("component", "node").alias("root"))
    place = F.struct(own.isNull().alias("bare"), own.alias("id"), "h", "row")
    least = marked.groupBy("mark.g").agg(F.min(place).alias("place")).join(roots, "g").groupBy("root").agg(F.min("place").alias("place"))
    kept = least.select("place.row")
    gone = cut(marked.select("row").join(kept, "row", "left_anti"), "gone")
    few = gone.count() <= broadcast_rows  # 8 bytes a row; beyond that the join shuffles
    return marked.join(F.broadcast(gone) if few else gone, "row", "left_anti").select(*names).toDF(*docs.columns)
