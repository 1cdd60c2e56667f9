"""Token counts against the library; odd rows."""

from seriesloom.llm.bpe import WordBpe
from seriesloom.llm.frequent import frequent_words
from seriesloom.llm.shared import tokenizer_path
from seriesloom.llm.token_counts import count_report, token_counts


def test_counts_equal_library(spark):
    rows = [(1, "The cat, the cat"), (2, None), (3, ""), (3, ""), (None, "<|endoftext|> é x"), (5, "long " * 30000), (6, "w" * 70000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    library = WordBpe(tokenizer_path()).library
    want = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids), len((t or "").encode())) for i, t in rows)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_bytes) for r in count_report(docs).collect())
    assert got == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in count_report(docs).collect())


def test_small_frequent_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a a a b c", 7)], "doc_id long, text string, n_tokens int")
    out = token_counts(docs, frequent=1).collect()[0]
    assert out["n_tokens"] == 7 and out["_n_tokens"] == 5
    assert frequent_words(docs, "text", k=1) == {"a": 3}


def test_empty_table(spark):
    assert count_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
