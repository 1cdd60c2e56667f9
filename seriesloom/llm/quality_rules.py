"""Quality rules with adaptive thresholds, in DataFrame functions only.

Statistics of whole texts come from array functions within each row, so no word is shuffled.  For each
language and source, quantile sketches of the statistics are built in parts and merged; groups with few rows
use their language's merged sketch, or that of all rows.  Thresholds are fences around the quartiles, and
documents are filtered by joining them to their group's fences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, free_name

# Fixed values of the contract.
SPACE = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: Statistic -> (has a lower fence, slack beyond the quartiles that every group has)
STATISTICS = {"symbol_rate": (False, 0.25), "word_length": (True, 2.0), "repeat_line_share": (False, 0.35)}
SPREAD = 6.0
MIN_ROWS = 100
SKETCH_K = 4096
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with the columns of BASE and STATISTICS, each with `prefix` in front of its name.

    Null texts have no words.  Windows are compared by 64-bit hashes of their words' hashes.
    """
    p = lambda name: f"{prefix}{name}"
    t, words, lines, codes, windows, pairs = (p(f"_{x}") for x in ("text", "words", "lines", "codes", "windows", "pairs"))
    at = lambda name, i: F.get(F.col(name), i)
    df = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumns({words: F.array_remove(F.split(t, SPACE), ""), lines: F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))})
    df = df.withColumns(
        {
            p("n_words"): F.size(words).cast("long"),
            p("word_chars"): F.char_length(F.array_join(words, "")).cast("long"),
            p("n_symbols"): F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            p("n_dup_lines"): (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            p("_n_lines"): F.size(lines),
            codes: F.transform(words, lambda w: F.xxhash64(w)),
        }
    ).drop(words, lines, t)
    every = F.when(F.col(p("n_words")) >= WINDOW, F.sequence(F.lit(0), (F.col(p("n_words")) - WINDOW).cast("int")))
    df = df.withColumn(windows, F.coalesce(F.transform(every, lambda i: F.xxhash64(*[at(codes, i + k) for k in range(WINDOW)])), F.array().cast("array<long>"))).drop(codes)
    twice = F.size(windows) > F.size(F.array_distinct(windows))
    placed = F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn(pairs, F.when(twice, F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop(windows)
    alike = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    marked = F.filter(F.col(pairs), lambda x, k: alike(x, at(pairs, k - 1)) | alike(x, at(pairs, k + 1)))
    found = F.array_sort(F.transform(marked, lambda x: x["i"]))
    covered = F.aggregate(
        found,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda s, i: F.struct((i + WINDOW).alias("end"), (s["total"] + i + WINDOW - F.greatest(i, s["end"])).alias("total")),
        lambda s: s["total"],
    )
    df = df.withColumn(p("n_repeat_words"), covered.cast("long")).drop(pairs)
    n = F.greatest(F.col(p("n_words")), F.lit(1))
    return df.withColumns(
        {
            p("base_failed"): (F.col(p("n_words")) < 10) | (100 * F.col(p("n_repeat_words")) > 20 * F.col(p("n_words"))),
            p("symbol_rate"): F.col(p("n_symbols")) / n,
            p("word_length"): F.col(p("word_chars")) / n,
            p("repeat_line_share"): F.col(p("n_dup_lines")) / F.greatest(F.col(p("_n_lines")), F.lit(1)),
        }
    ).drop(p("_n_lines"))


def fences(measured: DataFrame, prefix: str = "", min_rows: int = MIN_ROWS, k: int = SKETCH_K) -> DataFrame:
    """(lang, source, lower and upper fence of each statistic) for each pair of the two, nulls included.

    Sketches hold the rows that pass the base rules; a pair, a language or a table without such rows has null
    fences, which reject nothing.
    """
    p = lambda name: f"{prefix}{name}"
    names = list(STATISTICS)
    passed = lambda c: F.when(~F.col(p("base_failed")), F.col(p(c)).cast("double"))
    count = F.count(F.when(~F.col(p("base_failed")), 1))
    groups = cut(measured.groupBy("lang", "source").agg(count.alias("n"), *[F.kll_sketch_agg_double(passed(c), F.lit(k)).alias(c) for c in names]), "sketches")
    filled = groups.where("n > 0")
    merged = lambda c: F.kll_merge_agg_double(c, F.lit(k)).alias(c)

    def quartiles(df: DataFrame, to: str) -> DataFrame:
        return df.withColumn(to, F.struct(F.col("n").alias("n"), *[F.struct(F.kll_sketch_get_quantile_double(c, F.lit(0.25)).alias("low"), F.kll_sketch_get_quantile_double(c, F.lit(0.75)).alias("high")).alias(c) for c in names]))

    own = quartiles(filled, "own").where(F.col("n") >= min_rows).select("lang", "source", "own")
    by_lang = quartiles(filled.groupBy("lang").agg(F.sum("n").alias("n"), *map(merged, names)), "of_lang").where(F.col("n") >= min_rows).select(F.col("lang").alias("l"), "of_lang")
    overall = quartiles(filled.agg(F.sum("n").alias("n"), *map(merged, names)).where("n > 0"), "all").select("all").collect() if filled.limit(1).count() else []
    own = own.select(F.col("lang").alias("ol"), F.col("source").alias("os"), "own")
    keys = groups.select("lang", "source")
    keys = keys.join(own, keys["lang"].eqNullSafe(own["ol"]) & keys["source"].eqNullSafe(own["os"]), "left")
    keys = keys.join(by_lang, keys["lang"].eqNullSafe(by_lang["l"]), "left")
    bounds = []
    for c, (two_sided, slack) in STATISTICS.items():
        last = overall[0]["all"][c] if overall else {"low": None, "high": None}
        low, high = (F.when(F.col("own").isNotNull(), F.col("own")[c][x]).when(F.col("of_lang").isNotNull(), F.col("of_lang")[c][x]).otherwise(F.lit(last[x]).cast("double")) for x in ("low", "high"))
        spread = SPREAD * (high - low) + slack
        bounds += [(low - spread if two_sided else F.lit(None).cast("double")).alias(f"{c}_least"), (high + spread).alias(f"{c}_most")]
    return keys.select("lang", "source", *bounds)


def verdict(prefix: str = "") -> Column:
    """False for rows that fail the base rules or lie beyond a fence of their group."""
    p = lambda name: F.col(f"{prefix}{name}")
    within = ~p("base_failed")
    for c in STATISTICS:
        within = within & F.coalesce(p(c) >= F.col(f"{c}_least"), F.lit(True)) & F.coalesce(p(c) <= F.col(f"{c}_most"), F.lit(True))
    return within


def judge(measured: DataFrame, prefix: str = "", min_rows: int = MIN_ROWS, broadcast_rows: int = 50_000) -> DataFrame:
    """`measured`, a written table, with the verdict under the name `kept` (and `prefix` in front)."""
    bounds = cut(fences(measured, prefix, min_rows), "fences")
    few = bounds.count() <= broadcast_rows  # about 100 bytes a row; beyond that the join shuffles
    bounds = bounds.withColumnsRenamed({"lang": f"{prefix}_l", "source": f"{prefix}_s"})
    same = measured["lang"].eqNullSafe(bounds[f"{prefix}_l"]) & measured["source"].eqNullSafe(bounds[f"{prefix}_s"])
    joined = measured.join(F.broadcast(bounds) if few else bounds, same, "left")
    return joined.withColumn(f"{prefix}kept", verdict(prefix)).select(*measured.columns, f"{prefix}kept")


def quality_report(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The query's columns for each row.

    Null or empty texts fail the base rules.  Null languages and sources are groups of their own.  Repeated
    rows are judged each; an empty table gives an empty result.
    """
    measured = cut(measure(docs.select("doc_id", "text", "lang", "source")).drop("text"), "measured")
    return judge(measured, "", min_rows).select("doc_id", *BASE, "kept")


def accept(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The rows of `docs` that are kept, with their columns as they are."""
    prefix = free_name(docs, "rule_")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    measured = cut(measure(docs, prefix=prefix), "measured")
    return judge(measured, prefix, min_rows).where(F.col(f"{prefix}kept")).select(docs.columns)


def oracle_sql() -> str:
    """DuckDB SQL for `quality_report` over `documents`; exact while no group has more than SKETCH_K rows."""
    names = list(STATISTICS)
    quartiles = ", ".join(f"quantile_disc({c}, 0.25) FILTER (WHERE NOT base_failed) AS {c}_lo, quantile_disc({c}, 0.75) FILTER (WHERE NOT base_failed) AS {c}_hi" for c in names)
    pick = lambda x: f"CASE WHEN o.n >= {MIN_ROWS} THEN o.{x} WHEN l.n >= {MIN_ROWS} THEN l.{x} ELSE a.{x} END"
    within = []
    for c, (two_sided, slack) in STATISTICS.items():
        low, high = pick(f"{c}_lo"), pick(f"{c}_hi")
        spread = f"({SPREAD} * (({high}) - ({low})) + {slack})"
        within.append(f"coalesce(m.{c} <= ({high}) + {spread}, true)")
        if two_sided:
            within.append(f"coalesce(m.{c} >= ({low}) - {spread}, true)")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
g AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS g
    FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g WHERE g IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM f, (SELECT unnest(range(5)) AS k) WHERE c > 1 GROUP BY rid),
b AS (SELECT d.*, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
    FROM d JOIN s USING (rid) LEFT JOIN r USING (rid)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_rate,
    word_chars / greatest(n_words, 1)::DOUBLE AS word_length, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS repeat_line_share FROM b),
o AS (SELECT lang, source, count(*) FILTER (WHERE NOT base_failed) AS n, {quartiles} FROM m GROUP BY lang, source),
l AS (SELECT lang, count(*) FILTER (WHERE NOT base_failed) AS n, {quartiles} FROM m GROUP BY lang),
a AS (SELECT {quartiles} FROM m)
SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed,
    NOT m.base_failed AND {" AND ".join(within)} AS kept
FROM m JOIN o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source
    JOIN l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a"""
