"""Text jobs: weak labels, cleaning with an audit, daily features without look-ahead, overrides."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import safe_divide, sign_label
from ..storage import shared_path, written
from .quality import audit


def weak_label(polarity: str) -> Column:
    return sign_label(polarity)


def normalised(text: str) -> Column:
    """Lower case, runs of white space as one space, trimmed: the key that duplicates share."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def clean_and_audit(articles: DataFrame, text: str, published: str, label: str, id: str) -> DataFrame:
    """Every article with the reason it is left out for, or `retained`."""
    reasons = [
        ("invalid_timestamp", F.col(published).isNull()),
        ("empty", F.col(text).isNull() | (F.length(normalised(text)) == 0)),
        ("missing_label", F.col(label).isNull()),
    ]
    return audit(articles, reasons, F.sha2(normalised(text), 256), [F.col(published), F.col(id)])


def label_distribution(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Count and share of each label within its group."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.join(totals, keys).withColumn("share", F.col("n") / F.col("total")).drop("total")


def daily_sentiment(articles: DataFrame, published: str, score: str, keys: list[str] | None = None, positive_over: float = 0.7) -> DataFrame:
    """Totals of each day from articles published on it: positive (scores above the limit), negative, their
    balance, volume, shares of the score sum, and balance over volume. Articles without a time are left out.
    """
    s = F.col(score)
    day = articles.where(F.col(published).isNotNull()).groupBy(*(keys or []), F.to_date(published).alias("date"))
    df = day.agg(
        F.sum(F.when(s > positive_over, s).otherwise(0.0)).alias("positive_total"), F.sum(F.when(s < 0, -s).otherwise(0.0)).alias("negative_total"), F.count("*").alias("volume")
    )
    df = df.withColumn("balance", F.col("positive_total") - F.col("negative_total"))
    total = F.col("positive_total") + F.col("negative_total")
    return df.withColumns({"pct_positive": safe_divide("positive_total", total), "pct_negative": safe_divide("negative_total", total), "balance_per_volume": safe_divide("balance", "volume")})


def split_events(articles: DataFrame, events: str, id: str) -> DataFrame:
    """One row for each event of a recap post."""
    return articles.select(id, F.posexplode(events).alias("event_no", "event"))


def apply_override(df: DataFrame, text: str, model_label: str, rules: list[tuple[str, str]]) -> DataFrame:
    """The label of the first rule whose pattern matches, else the model's; `eligible` tells which.

    `rules` is a short list of (pattern, label), compiled into one expression.
    """
    rule = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        rule = F.when(F.col(text).rlike(pattern), label).otherwise(rule)
    df = df.withColumn("rule_label", rule).withColumn("eligible", F.col("rule_label").isNotNull())
    return df.withColumn("final_label", F.coalesce("rule_label", model_label))


def override_metrics(df: DataFrame, keys: list[str], reference: str, model_label: str) -> DataFrame:
    """Rows, eligible rows, right ones, unsafe changes (a right label made wrong) and missed repairs."""
    right, before = F.col("final_label") == F.col(reference), F.col(model_label) == F.col(reference)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("eligible").alias("eligible"), F.count_if(right).alias("correct"), F.count_if(F.col("eligible") & before & ~right).alias("unsafe"), F.count_if(~F.col("eligible") & ~before).alias("missed")
    )


WORD = re.compile(rb"[A-Za-z0-9_]+")
BLOCK_BYTES = 4 << 20


def terms_of(text: bytes, pairs: bool = True) -> Counter[bytes]:
    """Words of ASCII letters, digits and underscores in lower case, and pairs of neighbours, with their counts."""
    words = WORD.findall(text.lower())  # of bytes: changes A-Z only
    return Counter([*words, *[a + b" " + b for a, b in pairwise(words)]] if pairs else words)


def term_counts(df: DataFrame, keys: list[str], text: str, pairs: bool = True) -> DataFrame:
    """(keys, term, tf) of `terms_of` each text; rows that share their keys count as one text's.

    A text is counted in the task that reads it, so terms aren't shuffled; rows come grouped by term within some
    megabytes of text, which keeps what is written or shuffled of them small.  Only rows of repeated keys are summed.
    """
    held = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).cast("binary").alias("_text"))
    again = held.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    types = {k: held.schema[k].dataType for k in keys}
    schema = T.StructType([*[T.StructField(k, t) for k, t in types.items()], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, counts, sizes = [], [], []
        for t in batch.column("_text"):
            found = terms_of(t.as_py(), pairs)
            terms += found.keys()
            counts += found.values()
            sizes.append(len(found))
        column = pa.array(terms, pa.binary())
        order = np.argsort(column.dictionary_encode().indices.to_numpy(), kind="stable")
        rows = np.repeat(np.arange(batch.num_rows), sizes)[order]
        own = [batch.column(k).take(pa.array(rows)) for k in keys]
        return pa.RecordBatch.from_arrays([*own, column.take(pa.array(order)).cast(pa.string()), pa.array(np.array(counts, dtype=np.int64)[order])], names=[*keys, "term", "tf"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("_text")).to_numpy().astype(np.int64)) // BLOCK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
            for a, b in pairwise(cuts):
                if b > a:
                    yield block(batch.slice(a, b - a))

    if again.isEmpty():
        return held.mapInArrow(count, schema)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    once, more = (held.join(again, same, how).mapInArrow(count, schema) for how in ("left_anti", "left_semi"))
    return once.unionByName(more.groupBy(*keys, "term").agg(F.sum("tf").alias("tf")))


def vocabulary(counts: DataFrame, least: int = 2, most_terms: int | None = None) -> DataFrame:
    """(term, df, id), written: every term in at least `least` documents of the counts, numbered from 0 without gaps.

    Terms are dealt to ordered ranges and numbered within each; the ranges' sizes give the offsets, so ids are dense,
    without collisions, and no table of terms passes through one task.  With `most_terms` the most frequent ones are
    numbered first and others go; else the order is that of the terms.
    """
    found = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    order = ["term"] if most_terms is None else [F.desc("df"), F.asc("term")]
    parts = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(found.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "vocabulary")
    part = F.shiftright("_at", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each range
    offsets = list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    before = F.element_at(F.create_map(*[F.lit(x) for pair in offsets for x in pair]), part) if offsets else F.lit(0)
    out = placed.select("term", "df", (before + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("id"))
    return out if most_terms is None else out.where(F.col("id") < most_terms)


def tfidf(counts: DataFrame, terms: DataFrame, documents: int, broadcast_terms: int = 500_000) -> DataFrame:
    """(keys, term, id, weight): tf * ln((N + 1) / (df + 1)) of the vocabulary's terms.

    The most frequent terms, at most `broadcast_terms`, are broadcast, so that only the counts of rarer ones are shuffled.
    """
    heights = sorted((tuple(r) for r in terms.groupBy("df").agg(F.count("*").alias("n")).collect()), reverse=True)  # distinct frequencies
    sizes = list(accumulate(n for _, n in heights))
    common = next((df for (df, _), n in zip(heights, sizes, strict=True) if n > broadcast_terms), 0)  # the largest frequency that doesn't fit
    frequent = F.broadcast(terms.where(F.col("df") > common))
    joined = counts.join(frequent, "term")
    if common:
        joined = joined.unionByName(counts.join(frequent, "term", "left_anti").join(terms.where(F.col("df") <= common), "term"))
    return joined.withColumn("weight", F.col("tf") * F.ln((F.lit(documents) + 1.0) / (F.col("df") + 1.0))).drop("tf", "df")


def tfidf_vectors(df: DataFrame, text: str, terms: DataFrame, documents: int) -> DataFrame:
    """`df` with the vector `features` in place of the text, written: weights as in `tfidf`, places by the terms' ids.

    The terms are few, as a model has coefficients for each: tasks get them as a dictionary, so no row is shuffled.
    """
    from pyspark.ml.linalg import VectorUDT

    weights = {r["term"].encode(): (r["id"], math.log((documents + 1.0) / (r["df"] + 1.0))) for r in terms.collect()}
    size, held = max(1, len(weights)), df.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in df.columns if c != text]
    fields = [df.schema[c] for c in kept]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            ids, values, ends = [], [], [0]
            for t in batch.column("_text"):
                found = sorted((*known[term], n) for term, n in terms_of(t.as_py() or b"").items() if term in known)
                ids += [i for i, _, _ in found]
                values += [w * n for _, w, n in found]
                ends.append(len(ids))
            n, places = batch.num_rows, pa.array(ends, pa.int32())
            parts = {
                "type": pa.array(np.zeros(n, np.int8)), "size": pa.array(np.full(n, size, np.int32)),
                "indices": pa.ListArray.from_arrays(places, pa.array(ids, pa.int32())), "values": pa.ListArray.from_arrays(places, pa.array(values, pa.float64())),
            }
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.StructArray.from_arrays(list(parts.values()), list(parts))], names=[*kept, "features"])

    path = shared_path(df.sparkSession, "tfidf")
    plain = T.StructType([*fields, T.StructField("features", VectorUDT.sqlType())])  # how a vector is stored
    df.select(*kept, F.col(text).cast("binary").alias("_text")).mapInArrow(code, plain).write.parquet(path)
    return df.sparkSession.read.schema(T.StructType([*fields, T.StructField("features", VectorUDT())])).parquet(path)


def tfidf_logistic(df: DataFrame, text: str, label: str, split: str, strengths: tuple[float, ...] = (0.5, 2.0, 8.0), most_terms: int = 1 << 18) -> tuple[DataFrame, float]:
    """TF-IDF of words and word pairs into a balanced logistic regression; C is chosen by validation macro F1.

    The vocabulary is exact: terms of two or more training documents, at most the `most_terms` most frequent ones, as
    the coefficients are held by the driver.  Returns the predictions on all rows (label, split, prediction) and the
    chosen C.
    """
    from pyspark.ml.classification import LogisticRegression

    from .metrics import confusion, confusion_metrics

    known = written(df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).withColumn("_row", F.monotonically_increasing_id()), "labelled")
    learned = known.where(F.col(split) == "train")
    terms = vocabulary(term_counts(learned, ["_row"], text), 2, most_terms)
    classes = sorted(r[0] for r in known.select(label).distinct().collect())
    place = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    rows = known.select(*[c for c in df.columns if c != text], F.element_at(place, F.col(label)).alias("_y"), text)
    coded = tfidf_vectors(rows, text, terms, learned.count())
    train = coded.where(F.col(split) == "train")
    counts = {r["_y"]: r["n"] for r in train.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    weights = F.create_map(*[F.lit(x) for y, m in counts.items() for x in (y, n / (len(counts) * m))])
    train = train.withColumn("_wt", F.element_at(weights, F.col("_y")))
    best, chosen, kept = -1.0, strengths[0], None
    for c in strengths:
        model = LogisticRegression(labelCol="_y", weightCol="_wt", regParam=1 / (c * n), maxIter=40).fit(train)
        scored = model.transform(coded.where(F.col(split) == "validation"))
        row = confusion_metrics(confusion(scored, [], "_y", "prediction"), [], [float(i) for i in range(len(classes))]).collect()[0]
        if row["macro_f1"] > best:
            best, chosen, kept = row["macro_f1"], c, model
    name = F.get(F.array(*map(F.lit, classes)), F.col("prediction").cast("int"))
    return kept.transform(coded).withColumn("predicted", name).drop("features", "rawPrediction", "probability", "_y", "prediction"), chosen
