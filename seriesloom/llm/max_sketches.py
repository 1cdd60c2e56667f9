"""Ranked lexical search with hashed max-sketches.

A document's impacts (its terms' saturated frequencies, whole numbers) fold into a sketch: terms are hashed to
coordinates, and a coordinate holds the largest impact of its terms.  A batch of queries is a matrix of term weights
by coordinate, so a product of a block of sketches with it bounds every query's score of every document from above.
Documents are then scored exactly in descending order of their bounds, until a bound falls below the tenth best
score.  Each task returns its own best rows for each query, and these meet.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .plain_words import packed, plain_words, unpacked
from .shared import cut, discard, ship, slices

SCALE, STEP = 1_000_000_000, 1_000
SHORT, LONG = 25, 75  # a document's m is 100 - LONG + (LONG n N) div L


class Queries:
    """A block of queries: its terms, and each query's terms with their numbers."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.items: list[tuple[object, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, item: object, text: bytes | None) -> None:
        counts = Counter(plain_words(text))
        terms = [self.place.setdefault(t, len(self.place)) for t in counts]
        self.items.append((item, np.array(terms, dtype=np.int64), np.array(list(counts.values()), dtype=np.int64)))
        self.size += len(terms)


def blocks(queries: DataFrame, item: str, text: str, most_items: int, most_terms: int) -> Iterator[Queries]:
    """The queries in blocks of bounded size, read one partition at a time."""
    now = Queries()
    for row in queries.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        now.add(row["i"], None if row["t"] is None else row["t"].encode("utf-8", "surrogatepass"))
        if len(now.items) >= most_items or now.size >= most_terms:
            yield now
            now = Queries()
    if now.items:
        yield now


def held_terms(docs: DataFrame, id: str, text: str, place: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) for each row: its number of terms, and the query terms that it holds, written."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = place.get
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                sizes, terms, counts = [], [], []
                for t in part.column("text").to_pylist():
                    own = plain_words(t)
                    at = np.fromiter((i for i in map(find, own) if i is not None), np.int64)
                    found, n = np.unique(at, return_counts=True)
                    sizes.append(len(own))
                    terms.append(found)
                    counts.append(n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), packed(terms, "<u4"), packed(counts, "<u4")], schema=schema)

    held = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return cut(held.mapInArrow(run, "doc_id long, n long, terms binary, counts binary"), "terms")


def term_weights(held: DataFrame, terms: int, documents: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) for each query term; tasks hand on one row for each term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column("terms"), "<u4")[0], minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(terms, dtype=np.int64)  # terms of no document never match
    for r in held.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
    return out


def sketches(owner: np.ndarray, coordinate: np.ndarray, impact: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Rows of coordinatewise maxima of the impacts."""
    out = np.zeros(rows * width)
    np.maximum.at(out, owner * width + coordinate, impact.astype(np.float64))
    return out.reshape(rows, width)


def query_matrix(block: Queries, weights: np.ndarray, coordinates: np.ndarray, width: int) -> np.ndarray:
    """Each query's weights summed by coordinate, a column for each query."""
    out = np.zeros((width, len(block.items)))
    for q, (_, terms, times) in enumerate(block.items):
        np.add.at(out[:, q], coordinates[terms], (weights[terms] * times).astype(np.float64))
    return out


class Best:
    """The best `top` rows of a query so far: highest score first, then the smallest id, nulls last."""

    def __init__(self, top: int):
        self.top, self.rows = top, []  # (-score, id is null, id, row)

    def add(self, rows: list[tuple]) -> None:
        self.rows = sorted(self.rows + rows)[: self.top]

    @property
    def least(self) -> int:
        """The least score that can still enter."""
        return max(1, -self.rows[-1][0]) if len(self.rows) == self.top else 1


def score_rows(best: Best, bounds: np.ndarray, exact, ids: list, first: int, round_rows: int = 32) -> int:
    """Scores the rows whose bound reaches the threshold, in descending order of their bounds, until it doesn't.

    Returns how many rows were scored; `exact` gives the scores of an array of places.
    """
    can = np.flatnonzero(bounds >= best.least)
    can = can[np.argsort(-bounds[can], kind="stable")]
    done = 0
    while done < len(can) and bounds[can[done]] >= best.least:
        now = can[done : done + round_rows]
        scores = exact(now)
        keep = np.flatnonzero(scores >= best.least)
        best.add([(-s, ids[i] is None, ids[i] or 0, first + i) for s, i in zip(scores[keep].tolist(), now[keep].tolist(), strict=True)])
        done += len(now)
    return done


def ranked(held: DataFrame, block: Queries, first_item: int, weights: np.ndarray, documents: int, length: int, top: int, width: int, rows: int = 1024) -> DataFrame:
    """Each task's best rows: (q, item_id, doc_id, score, row), at most `top` for each query."""
    coordinates = np.fromiter((xxhash.xxh3_64_intdigest(t) % width for t in block.place), np.int64, len(block.place))
    matrix = query_matrix(block, weights, coordinates, width)
    vocabulary = max(1, len(block.place))
    gain = [(terms, weights[terms] * times) for _, terms, times in block.items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in gain]
        seen = 0
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            n = batch.column("n").to_numpy()
            term, sizes = unpacked(batch.column("terms"), "<u4")
            times = unpacked(batch.column("counts"), "<u4")[0].astype(np.int64)
            owner, term = np.repeat(np.arange(len(n)), sizes), term.astype(np.int64)
            m = SHORT + (LONG * n * documents) // max(1, length)
            impact = (SCALE * times) // (STEP * times + 8 * m[owner])
            # sums are whole numbers; the factor covers rounding where they pass 2^53
            bounds = np.ascontiguousarray((sketches(owner, coordinates[term], impact, len(n), width) @ matrix).T) * (1 + 1e-9)
            key = owner * vocabulary + term  # ascending, as terms are within a row
            ids = batch.column("doc_id").to_pylist()

            def exact(places: np.ndarray, q: int, key: np.ndarray = key, impact: np.ndarray = impact) -> np.ndarray:
                terms, gains = gain[q]
                wanted = places[:, None] * vocabulary + terms
                at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                return np.where(key[at] == wanted, gains * impact[at], 0).sum(axis=1)

            for q in np.flatnonzero(bounds.max(axis=1, initial=0) >= np.array([b.least for b in best])).tolist():
                score_rows(best[q], bounds[q], lambda places, q=q: exact(places, q), ids, seen)
            seen += len(n)
        found = [(first_item + q, None if bare else i, -s, row) for q, b in enumerate(best) for s, bare, i, row in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 4, names=["q", "doc_id", "score", "row"])

    return held.mapInArrow(run, "q long, doc_id long, score long, row long")


def search(docs: DataFrame, queries: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", top: int = 10, width: int = 1024, most_items: int = 2_048, most_terms: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's `top` best rows of `docs` with a score above 0, or all if fewer.

    Null and blank texts hold no terms: as documents they don't count, as queries they have no rows.  Repeated
    documents are ranked each; of equal scores the smaller id goes first, a null id last.  Repeated items are
    answered each.  Empty tables give an empty result; other columns are not read.  Queries go in blocks of at most
    `most_items` items, and documents are read once for each block.
    """
    spark = docs.sparkSession
    ship(spark)
    parts, names, first = [], [], 0
    for block in blocks(queries, item, query, most_items, most_terms):
        held = held_terms(docs, id, text, block.place)
        documents, length = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
        weights = term_weights(held, len(block.place), documents)
        parts.append(cut(ranked(held, block, first, weights, documents, length, top, width), "ranked"))
        names += [(first + q, i) for q, (i, _, _) in enumerate(block.items)]
        first += len(block.items)
        discard(held)
    kind = queries.schema[item].dataType.simpleString()
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    items = cut(spark.createDataFrame(names, f"q long, item_id {kind}"), "items")  # a number and an id for each query
    return best.join(items, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_report(docs: DataFrame, queries: DataFrame) -> DataFrame:
    return search(docs, queries)


def oracle_sql() -> str:
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {terms} AS ts FROM documents), n AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
al AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n),
p AS (SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY 1), al),
q AS (SELECT item_id, t, CAST(count(*) AS BIGINT) AS qtf FROM (SELECT item_id, unnest({terms}) AS t FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, p.doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN p USING (t) JOIN n ON n.doc_id = p.doc_id, al GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""
