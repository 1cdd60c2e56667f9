"""Token counts of whole texts by a map-side two-tier lookup.

Tier one is a broadcast table of the corpus's frequent words and their token counts (at most `frequent`
entries, so its size is bounded).  Tier two is each worker's memo of the other words' ids, filled by exact
byte-pair merges.  Words never leave their task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordBpe, encoder, words_of
from .frequent import frequent_words
from .shared import cut, free_name, ship, slices, tokenizer_path


def compact(words: list[str], counts: np.ndarray) -> tuple[bytes, bytes]:
    """A frequent-word table as two byte strings: words by line, counts as unsigned 16-bit."""
    return "\n".join(words).encode(), counts.astype("<u2").tobytes()


def expand(words: bytes, counts: bytes) -> tuple[pa.Array, np.ndarray]:
    held = np.frombuffer(counts, dtype="<u2").astype(np.int64)
    return pa.array(words.decode().split("\n") if len(held) else [], pa.string()), held


def count_texts(texts: pa.Array, frequent: tuple[pa.Array, np.ndarray], bpe: WordBpe) -> np.ndarray:
    """Token counts of a batch of texts: words of the table `frequent` first, the others through the encoder's memo."""
    words, codes, ends = words_of(texts)
    known, sizes = frequent
    places = pc.fill_null(pc.index_in(words, known), -1).to_numpy()
    counts = np.append(sizes, 0)[places]
    missed = np.flatnonzero(places < 0)
    if len(missed):
        counts[missed] = bpe.cache.complete(words.take(pa.array(missed)), bpe.encode_words).sizes()
    return np.diff(np.concatenate([[0], np.cumsum(counts[codes])])[ends])


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None, frequent: int = 32_768, name: str = "n_tokens") -> DataFrame:
    """All columns of `docs` and the token count of each whole text under `name`.

    Null or empty text: 0.  Special tokens' strings inside a text count as that token.  Repeated rows are
    counted each; an empty table stays empty.  If `docs` has a column of the new name, that one keeps it and
    the count gets underscores in front.
    """
    ship(docs.sparkSession)
    path = path or tokenizer_path()
    words = list(frequent_words(docs, text, frequent))
    counts = encoder(path).encode_words(pa.array(words, pa.string())).sizes()
    table = compact([w for w, n in zip(words, counts, strict=True) if n < 65536], counts[counts < 65536])
    sent = docs.sparkSession.sparkContext.broadcast(table)
    opened: list[tuple[pa.Array, np.ndarray]] = []

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        if not opened:
            opened.append(expand(*sent.value))
        parts = slices(pa.record_batch([texts], names=["text"]), "text")
        return pa.array(np.concatenate([np.zeros(0, np.int64), *[count_texts(p.column("text"), opened[0], encoder(path)) for p in parts]]))

    return docs.withColumn(free_name(docs, name), count(F.col(text).cast("string")))


def count_report(docs: DataFrame, limit: int = 2048) -> DataFrame:
    """doc_id, UTF-8 length, token count and whether the count is above `limit`."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return cut(token_counts(sized).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")), "token-counts")
