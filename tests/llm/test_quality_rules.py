"""Quality rules against plain Python; fences, odd rows, and no Python in the plan."""

import math
import random
import re
from collections import Counter

from seriesloom.llm import quality_rules as q


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def corpus():
    rnd = random.Random(6)
    texts = [None, "", " \t\n", "one", "a b c d e a b c d e", "é ß 日本 x\x0by\x1cz", "x\nx\n\n \ny\nx", "a " * 3000, "# $ % & | < > *"]
    for _ in range(300):
        words = [rnd.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rnd.randrange(1, 60))]
        if rnd.random() < 0.2:
            words += words[: rnd.randrange(1, 12)]
        texts.append(rnd.choice([" ", "\n"]).join(words) + (" ***" * rnd.randrange(0, 30) if rnd.random() < 0.1 else ""))
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), 1) for i, t in enumerate(texts)]
    return [*rows, rows[20], (None, texts[30], "en", "a", 1)]


def expected(rows, min_rows):
    base = [slow(r[1]) for r in rows]
    stats = [(b[2] / max(b[0], 1), b[1] / max(b[0], 1), b[3] / max(len([x for x in (r[1] or "").split("\n") if x.strip(" \t\n\x0b\f\r")]), 1)) for b, r in zip(base, rows, strict=True)]

    def fences(chosen):
        out = []
        for k, (two_sided, slack) in enumerate(q.STATISTICS.values()):
            held = sorted(stats[i][k] for i in chosen)
            low, high = (held[max(0, math.ceil(p * len(held)) - 1)] for p in (0.25, 0.75))
            spread = q.SPREAD * (high - low) + slack
            out.append((low - spread if two_sided else -math.inf, high + spread))
        return out

    passed = [i for i, b in enumerate(base) if not b[5]]
    out = []
    for i, (b, r) in enumerate(zip(base, rows, strict=True)):
        own = [j for j in passed if rows[j][2:4] == r[2:4]]
        lang = [j for j in passed if rows[j][2] == r[2]]
        chosen = own if len(own) >= min_rows else lang if len(lang) >= min_rows else passed
        kept = not b[5] and all(lo <= s <= hi for s, (lo, hi) in zip(stats[i], fences(chosen), strict=True))
        out.append((str(r[0]), *b, kept))
    return sorted(out)


def test_against_plain_python(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int").repartition(3)
    for min_rows in (1, 40, 90):
        got = q.quality_report(docs, min_rows)
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == expected(rows, min_rows)
    assert not all(r[-1] for r in expected(rows, 40) if not r[-2])


def test_stage_keeps_columns_and_plan_is_native(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_words int")
    kept = q.accept(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in q.quality_report(docs).collect())
    for df in (kept, q.measure(docs.select("doc_id", "text"))):
        assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    assert kept.join(docs, "doc_id").count() >= kept.where("doc_id is not null").count()


def test_both_joins_and_empty_table(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_words int")
    from seriesloom.llm.shared import cut

    measured = cut(q.measure(docs.select("doc_id", "text", "lang", "source")), "measured")
    assert sorted(map(str, q.judge(measured, broadcast_rows=0).collect())) == sorted(map(str, q.judge(measured).collect()))
    assert q.quality_report(docs.limit(0)).count() == 0
