"""Substring dedup: words that repeat a passage of an earlier document, by an FM-index per shard.

A window is `words` consecutive words.  Each has a route: the least hash of its shingles, which equal windows share.
Only windows whose route occurs in several documents can repeat; they are cut out as pieces, runs of windows of one
route.  Equal pieces are held once, with the least id that holds them.  Shards are routes dealt by hash: a shard's
pieces become an FM-index, all of its pieces stream through it by backward search, and intervals whose matching
statistics reach the window come back with the least id among their matches.  Routes that very many pieces share
(a common phrase in ever new surroundings) first lose the windows that occur only once, by their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fm_index import FmIndex
from .shared import cut, discard, ship, slices

WINDOW, PIECE_WINDOWS, LAST = 50, 128, (1 << 63) - 1
MEMO_WORDS = 1 << 19


class Memo(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_memo = Memo()


# -- hashes ----------------------------------------------------------------------------------------
def split_words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _joined(values: np.ndarray, offsets: list[int], count: int) -> np.ndarray:
    """A hash of the values at the offsets from each of `count` places."""
    out = np.zeros(count, dtype=np.uint64)
    for o in offsets:
        out = out * np.uint64(0x9E3779B97F4A7C15) + values[o : o + count]
    return _mix(out)


def shingle_size(window: int) -> int:
    return max(1, min(8, window // 4))


def routes(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(each window's route, shingle hashes); none where there are fewer words than a window."""
    if len(words) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    k = shingle_size(window)
    grams = _joined(word_hashes(words), list(range(k)), len(words) - k + 1)
    least, width, span = grams, 1, window - k + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(words) - window + 1
    return np.minimum(least[:n], least[span - width : span - width + n]).view(np.int64), grams


def window_hashes(words: list[bytes], window: int) -> np.ndarray:
    k = shingle_size(window)
    _, grams = routes(words, window)
    return _joined(grams, [*range(0, window - k, k), window - k], len(words) - window + 1).view(np.int64)


def runs(values: np.ndarray, wanted: np.ndarray, longest: int) -> list[tuple[int, int]]:
    """(first, number) of the runs of equal neighbouring values among the wanted places, at most `longest` each."""
    if not wanted.any():
        return []
    edge = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (wanted[1:] != wanted[:-1]), True])
    return [(a, min(longest, e - a)) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if wanted[s] for a in range(s, e, longest)]


# -- steps -----------------------------------------------------------------------------------------
def _key(body: Column) -> Column:
    return F.unhex(F.md5(body.cast("binary")))


def _read(docs: DataFrame, id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id).cast("long").alias("doc_id"), _key(body).alias("k"), body.cast("binary").alias("text"))


def marked(docs: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """(doc_id, k, n_words, sha256, routes) of each row, written: k tells texts apart, routes are its distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                sizes, shas, found = [], [], []
                for t in part.column("text").to_pylist():
                    words = split_words(t)
                    sizes.append(len(words))
                    shas.append(hashlib.sha256(b" ".join(words)).digest())
                    found.append(np.unique(routes(words, window)[0]))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k"), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), lists], names=["doc_id", "k", "n_words", "sha256", "routes"])

    return cut(_read(docs, id, text).mapInArrow(run, "doc_id long, k binary, n_words long, sha256 binary, routes array<long>"), "marked")


def _pieces(batches: Iterator[pa.RecordBatch], window: int, wanted) -> Iterator[pa.RecordBatch]:
    """Pieces of the texts of (k, doc, at, text, ...): their wanted windows, in runs of one route."""
    for batch in batches:
        out: list[tuple] = []
        for i, (k, doc, at, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "doc", "at", "text")), strict=True)):
            words = split_words(text)
            route = routes(words, window)[0]
            for first, n in runs(route, wanted(batch, i, route), PIECE_WINDOWS):
                body = b" ".join(words[first : first + n + window - 1])
                out.append((int(route[first]), k, doc, at + first, hashlib.md5(body).digest(), body))
            if len(out) >= 2_000:
                yield _table(out)
                out = []
        if out:
            yield _table(out)


_PIECES = "route long, k binary, doc long, at long, p binary, text binary"
_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=["route", "k", "doc", "at", "p", "text"])


def pieces(texts: DataFrame, window: int, hot: int) -> DataFrame:
    """(route, k, doc, at, p, text), written: the pieces of (k, doc, text, routes), p telling their texts apart.

    Pieces of routes with more than `hot` pieces keep only windows whose hash occurs under several owners.
    """

    def shared_routes(batch: pa.RecordBatch, i: int, route: np.ndarray) -> np.ndarray:
        return np.isin(route, batch.column("routes")[i].values.to_numpy(zero_copy_only=False))

    def shared_places(batch: pa.RecordBatch, i: int, route: np.ndarray) -> np.ndarray:
        out = np.zeros(len(route), dtype=bool)
        out[batch.column("places")[i].values.to_numpy(zero_copy_only=False)] = True
        return out

    every = cut(texts.withColumn("at", F.lit(0).cast("long")).mapInArrow(lambda b: _pieces(b, window, shared_routes), _PIECES), "pieces")
    common = cut(every.groupBy("route").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("route"), "routes")
    if not common.head(1):
        return every
    many = every.join(common, "route", "left_semi")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [window_hashes(split_words(t), window) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in held])
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows = np.repeat(np.arange(len(held)), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(place), *(batch.column(c).take(pa.array(rows)) for c in ("k", "at", "doc"))], names=["w", "place", "k", "at", "doc"])

    seen = cut(many.select("k", "at", "doc", "text").mapInArrow(windows, "w long, place long, k binary, at long, doc long"), "windows")
    twice = seen.groupBy("w").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("w")
    places = seen.join(twice, "w").groupBy("k", "at").agg(F.collect_list("place").alias("places"))
    trimmed = many.drop("route", "p").join(places, ["k", "at"]).mapInArrow(lambda b: _pieces(b, window, shared_places), _PIECES)
    return cut(every.join(common, "route", "left_anti").unionByName(trimmed), "pieces")


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of single-spaced texts as numbers from 1, and each text's number of words."""
    split = pc.split_pattern(pc.cast(texts, pa.binary()), b" ")
    codes = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return codes, pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)


def answers(held: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """(p, first, n, owner): runs of windows of each piece, and the least id whose text holds them."""
    unique = cut(held.groupBy("p").agg(F.first("text").alias("text"), F.first("route").alias("route"), F.min("doc").alias("doc")), "unique")
    size = unique.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        flat, sizes = coded(group.column("text").combine_chunks())
        index = FmIndex(flat, sizes, group.column("doc").to_numpy(), window)
        owner = index.stream(flat, sizes).owner
        piece = np.repeat(np.arange(len(sizes)), sizes)
        edge = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1]), True])
        start, n = edge[:-1], np.diff(edge)
        start, n = start[owner[start] >= 0], n[owner[start] >= 0]
        starts = np.cumsum(sizes) - sizes
        return pa.table({"p": group.column("p").take(pa.array(piece[start])), "first": pa.array(start - starts[piece[start]]), "n": pa.array(n), "owner": pa.array(owner[start])})

    shards = max(1, -(-size // shard_bytes))
    return unique.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).groupBy("shard").applyInArrow(search, "p binary, first long, n long, owner long")


def removals(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = 4_096, shard_bytes: int = 6_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, spans), all written.

    rows: (doc_id, k, n_words, sha256) of each row.  texts: (k, doc, n_words), the least id of each distinct text, a
    null id as the largest number.  spans: (k, spans), the windows to remove from the row with that id, as places
    and numbers of neighbouring windows; rows of larger ids repeat the whole text.
    """
    ship(docs.sparkSession)
    rows = marked(docs, id, text, window)
    order = F.coalesce("doc_id", F.lit(LAST))
    texts = cut(rows.groupBy("k").agg(F.min(order).alias("doc"), F.first("n_words").alias("n_words"), F.first("routes").alias("routes")), "texts")
    route = texts.select("k", "doc", F.explode("routes").alias("route"))
    shared = route.groupBy("route").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("route")
    hits = route.join(shared, "route").groupBy("k").agg(F.min("doc").alias("doc"), F.collect_list("route").alias("routes"))
    bodies = _read(docs, id, text).groupBy("k").agg(F.first("text").alias("text"))
    held = pieces(bodies.join(hits, "k").select("k", "doc", "text", "routes"), window, hot)
    found = held.select("k", "doc", "at", "p").join(answers(held, window, shard_bytes), "p").where("owner < doc")
    spans = cut(found.groupBy("k").agg(F.collect_list(F.struct((F.col("at") + F.col("first")).alias("at"), "n")).alias("spans")), "spans")
    discard(held)
    return rows, texts, spans


def covered(n_words: int, at: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows from `at` on, `n` of them, cover."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n + window - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def kept_texts(docs: DataFrame, spans: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """(k, n_removed, kept) of the texts that lose words but don't go whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                removed, kept = [], []
                for t, own in zip(part.column("text").to_pylist(), part.column("spans"), strict=True):
                    words = split_words(t)
                    at, n = (own.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
                    gone = covered(len(words), at, n, window)
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["k", "n_removed", "kept"])

    bodies = _read(docs, id, text).groupBy("k").agg(F.first("text").alias("text"))
    return bodies.join(spans, "k").mapInArrow(run, "k binary, n_removed long, kept binary")


def dedup_report(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = 4_096, shard_bytes: int = 6_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row.

    Null texts count as empty; texts with fewer words than a window lose none.  Repeats within a document, or in
    rows of one id, stay.  A null id counts as one id larger than all.  Repeated rows get equal results; an empty
    table gives an empty one; other columns are not read.
    """
    rows, texts, spans = removals(docs, id, text, window, hot, shard_bytes)
    changed = cut(kept_texts(docs, spans, id, text, window).select("k", "n_removed", F.unhex(F.sha2("kept", 256)).alias("kept")), "kept")
    known = cut(texts.select("k", "doc").join(changed, "k", "left"), "known")  # apart, so that a text of very many rows can be split in the join
    known = rows.select("doc_id", "k", "n_words", "sha256").join(known, "k")
    repeat = (F.coalesce("doc_id", F.lit(LAST)) > F.col("doc")) & (F.col("n_words") >= window)
    none = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    digest = F.when(repeat, none).otherwise(F.coalesce("kept", "sha256"))
    removed = F.when(repeat, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return known.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), F.lower(F.hex(digest)).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = 4_096, shard_bytes: int = 6_000_000) -> DataFrame:
    """`docs` with texts that repeat a passage cut to their other words, joined by one space; other texts and columns
    stay as they are.  A text that goes whole is empty.  Rows and odd values as in `dedup_report`."""
    _, texts, spans = removals(docs, id, text, window, hot, shard_bytes)
    changed = cut(texts.join(kept_texts(docs, spans, id, text, window).select("k", "kept"), "k", "left").select("k", "doc", "n_words", "kept"), "kept")
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    own, body = F.col(names[docs.columns.index(id)]), names[docs.columns.index(text)]
    known = held.withColumn("k", _key(F.coalesce(F.col(body).cast("string"), F.lit("")))).join(changed, "k")
    repeat = (F.coalesce(own.cast("long"), F.lit(LAST)) > F.col("doc")) & (F.col("n_words") >= window)
    return known.withColumn(body, F.when(repeat, "").otherwise(F.coalesce(F.col("kept").cast("string"), F.col(body)))).select(*names).toDF(*docs.columns)


def oracle_sql(window: int = WINDOW) -> str:
    return f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i : i + {window - 1}], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM d WHERE len(ws) >= {window})),
m AS (SELECT w, min(doc_id) AS least FROM v GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT v.doc_id, list(i) AS ats FROM v JOIN m USING (w) WHERE least < v.doc_id GROUP BY 1),
g AS (SELECT doc_id, list(DISTINCT z) AS gone FROM (SELECT doc_id, unnest(range(i, i + {window})) AS z FROM (SELECT doc_id, unnest(ats) AS i FROM r)) GROUP BY 1),
k AS (SELECT d.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS removed, CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""
