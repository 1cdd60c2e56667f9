"""License scans: families in held-out notices, unknown notices, and planted lines in a corpus."""

import math
import random
import time

import pytest

from seriesloom.llm.licenses import UNKNOWN, blocks, fit, grams, license_report, likeness, notices, owners, reworded, scan, scan_text, tokens, wrapped

FILLER = "der mit und von nicht the of and see a license of trust apache tribe public version".split()


def corpus():
    rnd = random.Random(4)
    text = lambda: "\n".join(" ".join(rnd.choice(FILLER) for _ in range(rnd.randrange(3, 30))) for _ in range(4))
    rows = []
    for i in range(60):
        line, want = [("", ""), ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache"), ("This work is licensed under the GNU General Public License, version 3.", "GPL"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("Licensed under the Zorkfoo license, version 7.", "")][i % 6]
        rows.append((i, text() + "\n" + line, want))
    return [*rows, (100, None, ""), (101, "", ""), (102, "word " * 50000 + "\nReleased under the MIT License", "MIT")]


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.createDataFrame(corpus(), "doc_id long, text string, want string"))


def test_fresh_notices(model):
    fresh = notices(seed=99, each=4)
    right = sum(model.classify(tokens(n))[0] == f for f, _, n in fresh)
    assert right >= 0.95 * len(fresh)
    assert model.classify(tokens("der die und mit von"))[0] == UNKNOWN
    assert 0 < model.temperature <= 20
    assert model.report["precision"] > 0.9 and model.report["recall"] > 0.8 and model.report["calibration_error"] < 0.2


def test_reworded_notices_still_tell_their_family():
    """What is kept holds words of this family alone and none of another's; words that every notice has tell nothing."""
    own, rnd = owners(), random.Random(5)
    assert own["affero"] == "AGPL" and own["license"] is None and own["general public license"] is None and own["the license"] is None
    kept = 0
    for family, _, notice in notices(seed=1):
        if family == UNKNOWN:
            continue
        words = tokens(notice)
        got = reworded(family, words, own, rnd)
        if got is not None:
            kept += 1
            assert set(got) <= set(words) and {own[g] for g in grams(got) if own.get(g)} == {family}
    assert kept > 300 and reworded("MIT", ["the"], own, rnd) is None and reworded("MIT", [], own, rnd) is None


def test_wordings_without_a_template(model):
    """Notices in words of their own: found, though only templates confirm."""
    lines = {"GPL": "the source is made available under version 3 of the GPL", "LGPL": "you can use this library under the LGPL, version 2.1", "MPL": "covered by the Mozilla Public License 2.0", "Apache": "all code here falls under the Apache License, Version 2.0"}
    assert {f: model.classify(tokens(x))[0] for f, x in lines.items()} == {f: f for f in lines}
    assert all(model.classify(tokens(x))[0] == UNKNOWN for x in ("licensed under the Vorpal license, version 3", "you can see the license of trust in the file", ""))


def slow_class(model, words):
    """The classifier by its definition, without the skip."""
    names = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    logits = [b + sum(float(model.weights[g][c]) for g in names if g in model.weights) for c, b in enumerate(model.intercepts)]
    top = max(logits)
    odds = [math.exp((x - top) / model.temperature) for x in logits]
    p = [x / sum(odds) for x in odds]
    best = p.index(max(p))
    return model.classes[best] if p[best] >= 0.5 else UNKNOWN


def test_every_paragraph_is_classified(model):
    for _, text, _ in corpus():
        if not text or len(text) > 10_000:
            continue
        lines = [tokens(x) for x in text.split("\n")]
        want = {k: slow_class(model, x) for k, x in enumerate(lines) if x}
        assert {k: model.classify(x)[0] for k, x in enumerate(lines) if x} == want
        got = {r["paragraph"]: r["family"] for r in scan_text(text, model)}
        assert {k for k, f in want.items() if f != UNKNOWN and likeness(f, lines[k]) >= 0.75} <= set(got)
        whole = [w for x in lines for w in x]
        assert bool(got) == any(f != UNKNOWN for f in [*want.values(), slow_class(model, whole)])


def test_blocks_between_blank_lines():
    assert blocks([["a"], ["b"], [], ["c"], [], ["d"], ["e"], ["f"]]) == [(0, 1), (5, 7)] and blocks([]) == [] == blocks([[], ["x"]])


def test_repeats_missing_ids_and_clashing_names(spark, model):
    rows = [(None, "Released under the MIT License", 1), (3, "x", 2), (3, "x", 2), (None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses int")
    got = scan(docs, model).collect()
    assert sorted((r.licenses, len(r._licenses)) for r in got) == [(1, 1), (2, 0), (2, 0), (3, 0)]
    assert sorted((str(r.doc_id), r.families) for r in license_report(docs).collect()) == [("3", ""), ("3", ""), ("None", ""), ("None", "MIT")]


def test_templates_confirm():
    assert likeness("MIT", tokens("Released under the MIT License")) == 1 and likeness("GPL", tokens("released under the MIT license")) < 0.75


def test_planted_lines(spark, model):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, licenses string").repartition(3)
    want = {i: w for i, _, w in corpus()}
    assert {r.doc_id: r.families for r in license_report(docs).collect()} == want
    assert scan_text("a\n\nReleased under the MIT License.", model)[0]["paragraph"] == 2
    assert license_report(docs.limit(0)).count() == 0


HEADER = "This program is free software: you can {}redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."


@pytest.mark.parametrize("family, name", [("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero ")])
def test_wrapped_headers(model, family, name):
    header = HEADER.format("", name)
    narrow = header.replace("\n", " ").replace(" the GNU ", " the GNU\n").replace("modify it", "modify\nit").replace("can redistribute", "can\nredistribute")
    for text in (header, narrow, "der die und\n" + header + "\nmit von\n\nund", "x\n\n" + header):
        got = [r for r in scan_text(text, model) if r["confirmed"]]
        assert [r["family"] for r in got] == [family], text
    both = scan_text(header + "\nReleased under the MIT License.", model)
    assert [r["family"] for r in both if r["confirmed"]] == [family, "MIT"]
    split = [tokens(x) for x in ("can redistribute it and/or modify", "", "it under the terms of the GNU General Public License")]
    assert wrapped(split) == [] and wrapped([split[0], split[2]]) == [(0, 1)]


def test_many_license_lines_take_linear_time(model):
    """Two sizes of one text of notices, a blank line after each: twice the lines, about twice the time."""
    took = []
    for n in (4_000, 8_000, 16_000):
        text = "\n\n".join(f"Released under the {('MIT', 'Apache')[i % 2]} License" for i in range(n))
        began = time.process_time()
        found = scan_text(text, model)
        took.append(time.process_time() - began)
        assert sum(r["confirmed"] for r in found) >= n // 2
    assert took[2] < 3 * took[1] + 0.2 and took[2] < 5
