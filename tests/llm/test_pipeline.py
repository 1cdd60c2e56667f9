"""The pipeline's stages on a small corpus, each against brute force on its own input."""

import random

import corpus_pipeline
from seriesloom.llm.rule_ensemble import statistics

from .test_near_copies import slow_roots
from .test_packing import pack_documents


def write(spark, folder):
    rnd = random.Random(9)
    words = [f"{a}{b}" for a in "ba ko ti mu re".split() for b in "lan dor sun mek pil vra".split()]
    docs, labels = [], []
    for i in range(400):
        text = ". ".join(" ".join(rnd.choice(words) for _ in range(12)) for _ in range(rnd.randrange(1, 9))) + "."
        bad = i % 4 == 0
        if bad:
            text = text.replace(" ", "### ")
        docs.append((i, text, rnd.choice(["en", "de"]), rnd.choice(["a", "b"]), len(text)))
        labels.append((i, int(not bad), 0))
    docs += [(1000 + k, docs[1][1], "en", "a", 1) for k in range(30)] + [(2000, "too short", "en", "a", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    rows = write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(statistics("x")) > 0
    kept, ids = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert ids[0] == {r[0] for r in rows if r[0] >= 1000 or r[0] % 4}
    assert ids[1] == ids[0] - {2000}
    text = {r[0]: r[1] for r in rows}
    order = sorted(ids[1])
    assert ids[2] == {order[k] for k in slow_roots([text[i] for i in order])[0]}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == ids[2]
    assert sum(r.length for r in got) == sum(r.length for r in pack_documents(kept).collect())


def test_repeated_and_missing_ids(spark, tmp_path):
    write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id between 1 and 40 and doc_id % 4 > 0")
    own = docs.selectExpr("if(doc_id % 3 = 0, null, 7L) as doc_id", "text", "lang", "source", "n_chars")
    kept, texts = own.union(own), docs.select("text").distinct().count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
    assert kept.count() == kept.select("text").distinct().count() == texts
    assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).where("piece = 0").count() == texts


def test_empty_documents(spark, tmp_path):
    write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
