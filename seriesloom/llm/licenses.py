"""License scans: a trained paragraph classifier, confirmed by templates.

Word n-grams of license notices are the features of a sparse multinomial logistic regression.  It is trained
on filled templates of each family against an unknown class: paragraphs of the corpus and notices of invented
licenses.  Probabilities are calibrated by one temperature on whole wordings that the fit didn't see; a paragraph
whose best family stays under one half is unknown.  A prediction counts as confirmed if the paragraph holds most
of one of that family's templates.

Paragraphs are lines and blocks of lines between blank ones; every one of them is classified.  Where none of a
paragraph's words is part of a weighted n-gram its logits are the intercepts, so that verdict is known beforehand.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, free_name, least_hashed, ship, slices

# Customary wording of public license notices; {v} stands for a version.
TEMPLATES = {
    "AGPL": ["licensed under the GNU Affero General Public License version {v}", "SPDX-License-Identifier: AGPL-{v}-or-later", "redistribute it and/or modify it under the terms of the GNU Affero General Public License", "released under the AGPL version {v}"],
    "Apache": ["licensed under the Apache License, Version {v}", "you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-{v}", "released under the Apache License {v}"],
    "BSD": ["licensed under the BSD {v}-Clause License", "released under the BSD License", "redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-{v}-Clause"],
    "CC-BY": ["licensed under CC BY {v}", "licensed under a Creative Commons Attribution {v} International License", "SPDX-License-Identifier: CC-BY-{v}", "available under the Creative Commons Attribution {v} License", "available under CC BY {v}"],
    "CC-BY-NC": ["licensed under CC BY-NC {v}", "licensed under a Creative Commons Attribution-NonCommercial {v} International License", "SPDX-License-Identifier: CC-BY-NC-{v}", "available under the Creative Commons Attribution-NonCommercial {v} License", "available under CC BY-NC {v}"],
    "CC-BY-SA": ["licensed under CC BY-SA {v}", "licensed under a Creative Commons Attribution-ShareAlike {v} International License", "SPDX-License-Identifier: CC-BY-SA-{v}", "available under the Creative Commons Attribution-ShareAlike {v} License", "available under CC BY-SA {v}"],
    "CC0": ["dedicated to the public domain under CC0 {v}", "SPDX-License-Identifier: CC0-{v}", "released under the CC0 {v} Universal public domain dedication"],
    "GPL": ["licensed under the GNU General Public License, version {v}", "redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-{v}-only", "released under the GPL version {v}"],
    "LGPL": ["licensed under the GNU Lesser General Public License, version {v}", "SPDX-License-Identifier: LGPL-{v}-or-later", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "released under the LGPL version {v}"],
    "MIT": ["licensed under the MIT License", "released under the MIT License", "permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT", "distributed under the terms of the MIT License"],
    "MPL": ["subject to the terms of the Mozilla Public License, v. {v}", "licensed under the Mozilla Public License {v}", "SPDX-License-Identifier: MPL-{v}", "released under the MPL version {v}"],
}
OPENINGS = ["", "this work is ", "this project is ", "this file is ", "the code is ", "all content is ", "copyright (c) {v} the authors, "]
#: Notices of invented licenses, which belong to no family.
FORMS = ["licensed under the {n} license, version {v}", "released under the {n} license", "this work is licensed under {n} {v}", "the {n} public license", "see the license of {n}", "subject to the terms of the {n} license", "a license to {n} is in the file", "{n} SPDX-License-Identifier: {n}", "SPDX-License-Identifier: {n}-{v}", "SPDX-License-Identifier: {n}", "available under {n} {v}", "copyright (c) {v} {n}, all rights reserved, see the file.", "redistribute it under the terms of the {n} license", "{n} may use this file"]
UNKNOWN = "unknown"
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
GRAMS = 3
CONFIRM = 0.75


def tokens(paragraph: str) -> list[str]:
    """Lower-case words; every number is the word 0."""
    return ["0" if t[0].isdigit() else t for t in _TOKEN.findall(paragraph.lower())]


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


def notices(seed: int = 3, each: int = 24) -> list[tuple[str, int, str]]:
    """(family, number of its wording, notice) rows from the templates, and of invented licenses as unknown."""
    rnd = random.Random(seed)
    out = []
    for family, wordings in TEMPLATES.items():
        for k, wording in enumerate(wordings):
            for _ in range(each):
                full = rnd.choice(OPENINGS) + wording + rnd.choice(["", ".", " or later.", ", see the file."])
                out.append((family, k, full.replace("{v}", rnd.choice(["1", "2", "2.0", "3", "3.0", "4.0", "2021"]))))
    for _ in range(len(out) // 2):
        name = "".join(rnd.choice(["ka", "lo", "mi", "ten", "ver", "sa", "pu"]) for _ in range(3))
        k = rnd.randrange(len(FORMS))
        out.append((UNKNOWN, k, rnd.choice(OPENINGS).replace("{v}", "1") + FORMS[k].replace("{n}", name).replace("{v}", rnd.choice(["1.0", "2"]))))
    return out


def owners() -> dict[str, str | None]:
    """The family of each n-gram that only one family's templates hold; None for those of several, of FORMS or OPENINGS."""
    out: dict[str, str | None] = dict.fromkeys(set().union(*(grams(tokens(w.replace("{v}", "0"))) for w in FORMS + OPENINGS)))
    for family, wordings in TEMPLATES.items():
        for g in set().union(*(grams(tokens(w.replace("{v}", "0"))) for w in wordings)):
            out[g] = family if g not in out or out[g] == family else None
    return out


def reworded(family: str, words: list[str], own: dict[str, str | None], rnd: random.Random) -> list[str] | None:
    """A notice in another word order: a part of it, some words dropped, neighbours swapped.

    None where what is left no longer tells its family: it holds no n-gram of two words or more of this family alone
    (a single word, like the German mit, may be any text's), or an n-gram of another's.
    """
    kept = words
    if words and rnd.random() < 0.5:
        n = max(1, round(len(words) * rnd.uniform(0.3, 0.9)))
        at = rnd.randrange(len(words) - n + 1)
        kept = words[at : at + n]
    kept = [w for w in kept if rnd.random() > 0.25]
    for i in range(len(kept) - 1):
        if rnd.random() < 0.1:
            kept[i], kept[i + 1] = kept[i + 1], kept[i]
    told = {(own[g], " " in g) for g in grams(kept) if own.get(g)}
    return kept if (family, True) in told and all(f == family for f, _ in told) else None


@dataclass
class LicenseModel:
    """Classes, intercepts, weights by n-gram and temperature; `report` has the figures on held-out wordings."""

    classes: list[str]
    intercepts: np.ndarray
    weights: dict[str, np.ndarray]
    temperature: float
    report: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.words = frozenset(w for g in self.weights for w in g.split(" "))
        self.bare = self._verdict(self.intercepts)

    def _verdict(self, logits: np.ndarray) -> tuple[str, float]:
        p = np.exp((logits - logits.max()) / self.temperature)
        p /= p.sum()
        best, unknown = int(p.argmax()), self.classes.index(UNKNOWN)
        return (self.classes[best], float(p[best])) if best != unknown and p[best] >= 0.5 else (UNKNOWN, float(p[unknown]))

    def classify(self, words: list[str]) -> tuple[str, float]:
        """(family or unknown, calibrated probability of it) for a paragraph's words."""
        held = self._weighted(words)
        return self._verdict(self.intercepts + sum(self.weights[g] for g in sorted(held))) if held else self.bare

    def _weighted(self, words: list[str]) -> set[str]:
        """The paragraph's n-grams that have weights; all words of such an n-gram are in `words` of the model."""
        own, weights, held = self.words, self.weights, set()
        last: list[str] = []  # the n-grams that end at the word before
        for w in words:
            if w in own:
                last = [w, *[f"{g} {w}" for g in last[: GRAMS - 1]]]
                held.update([g for g in last if g in weights])
            elif last:
                last = []
        return held


def likeness(family: str, words: list[str]) -> float:
    """The largest share of a template's word pairs that the paragraph holds."""
    held = set(zip(words, words[1:], strict=False))
    best = 0.0
    for wording in TEMPLATES[family]:
        own = tokens(wording.replace("{v}", "0"))
        pairs = list(zip(own, own[1:], strict=False))
        best = max(best, sum(p in held for p in pairs) / len(pairs))
    return best


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, k, p): the lines of each whole text that aren't empty."""
    return docs.select("doc_id", F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("k", "p")).where(F.length("p") > 0)


FOLDS = 3


def fit(docs: DataFrame, text: str = "text", sample_paragraphs: int = 4_000, penalty: float = 2e-4, seed: int = 3, variants: int = 3) -> LicenseModel:
    """Trains on the templates' notices and at most `sample_paragraphs` whole paragraphs of the corpus.

    The sample is of the lines with the least hash of document, place and text, without those that a template
    matches in full, as these are notices themselves.  Wordings are dealt into FOLDS folds; each fold's notices and
    paragraphs are scored by a fit to the others.  These scores give the temperature and the report: precision and
    recall of families, and the expected calibration error.  The model itself is fitted to all rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    spark = docs.sparkSession
    drawn = [r["p"] for r in least_hashed(paragraphs(docs, text), ["doc_id", "k", "p"], sample_paragraphs).select("p").collect()]
    plain = [p for p in drawn if max(likeness(f, tokens(p)) for f in TEMPLATES) < CONFIRM]
    known = notices(seed)
    rnd = random.Random(seed)
    rows = [(f, k % FOLDS, grams(tokens(n))) for f, k, n in known] + [(UNKNOWN, i % FOLDS, grams(tokens(p))) for i, p in enumerate(plain)]
    # Notices also come inside longer paragraphs.
    rows += [(f, k % FOLDS, grams(tokens(rnd.choice(plain) + " " + n))) for f, k, n in known if plain and rnd.random() < 0.5]
    # Other word orders and parts of the wordings, so that weight lies on the words that tell a family.
    own = owners()
    changed = [(f, k, reworded(f, tokens(n), own, rnd)) for f, k, n in known if f != UNKNOWN for _ in range(variants)]
    varied = [(f, k % FOLDS, grams(words)) for f, k, words in changed if words]
    rnd.shuffle(rows)
    classes = [*TEMPLATES, UNKNOWN]
    vocabulary = sorted(set().union(*(grams(tokens(n)) for f, _, n in known if f != UNKNOWN)))
    place = {g: i for i, g in enumerate(vocabulary)}
    code = lambda found: [(float(classes.index(f)), fold, Vectors.sparse(len(vocabulary), sorted((place[g], 1.0) for g in gs if g in place))) for f, fold, gs in found]
    coded = code(rows)
    table = spark.createDataFrame([*coded, *code(varied)], ["label", "fold", "features"]).coalesce(2).persist()
    learner = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
    logits, truth = [], []
    for fold in range(FOLDS):
        part = learner.fit(table.where(F.col("fold") != fold))
        matrix, intercepts = part.coefficientMatrix.toArray(), part.interceptVector.toArray()
        for y, own, v in coded:
            if own == fold:
                logits.append(intercepts + (matrix[:, v.indices].sum(axis=1) if len(v.indices) else 0))
                truth.append(int(y))
    model = learner.fit(table)
    table.unpersist()
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    held, right = np.array(logits), np.array(truth)

    def probabilities(temperature: float) -> np.ndarray:
        p = np.exp((held - held.max(axis=1, keepdims=True)) / temperature)
        return p / p.sum(axis=1, keepdims=True)

    loss = lambda temperature: float(-np.log(np.maximum(probabilities(temperature)[np.arange(len(right)), right], 1e-300)).mean())
    temperature = min(np.geomspace(0.2, 20.0, 97).tolist(), key=loss)
    p, unknown = probabilities(temperature), classes.index(UNKNOWN)
    said = np.where(p.max(axis=1) >= 0.5, p.argmax(axis=1), unknown)
    sure = p.max(axis=1)
    bins = np.minimum((sure * 10).astype(int), 9)
    gaps = [(bins == k).mean() * abs(sure[bins == k].mean() - (p.argmax(axis=1) == right)[bins == k].mean()) for k in set(bins.tolist())]
    report = {
        "precision": float((said == right)[said != unknown].mean()) if (said != unknown).any() else 1.0,
        "recall": float((said == right)[right != unknown].mean()),
        "calibration_error": float(sum(gaps)),
    }
    used = np.flatnonzero(np.abs(matrix).sum(axis=0))
    return LicenseModel(classes, intercepts, {vocabulary[i]: matrix[:, i].copy() for i in used}, temperature, report)


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("paragraph", T.IntegerType()),
            T.StructField("family", T.StringType()),
            T.StructField("probability", T.DoubleType()),
            T.StructField("likeness", T.DoubleType()),
            T.StructField("confirmed", T.BooleanType()),
        ]
    )
)


_PAIRS = [(f, frozenset(zip(t, t[1:], strict=False))) for f, wordings in TEMPLATES.items() for t in (tokens(w.replace("{v}", "0")) for w in wordings)]
_KNOWN = frozenset().union(*(p for _, p in _PAIRS))
_LEAST = min(-int(-CONFIRM * len(p) // 1) for _, p in _PAIRS)  # no template is held by fewer pairs
_REACH = max(len(tokens(w.replace("{v}", "0"))) for wordings in TEMPLATES.values() for w in wordings)


def wrapped(lines: list[list[str]]) -> list[tuple[int, int]]:
    """Ranges (first, last) of lines that hold most of a template only together; a line without words ends a range.

    A range takes in as many words after its first line as the longest template has.
    """
    known = [_KNOWN.intersection(zip(x, x[1:], strict=False)) for x in lines]
    out = []
    if sum(map(len, known)) < _LEAST - len(lines):
        return out
    for i, line in enumerate(lines):
        if not line:
            continue
        held, after, j, alone = set(known[i]), 0, i, [known[i]]
        while j + 1 < len(lines) and lines[j + 1] and after < _REACH:
            j += 1
            after += len(lines[j])
            held |= known[j]
            held |= _KNOWN.intersection([(lines[j - 1][-1], lines[j][0])])
            alone.append(known[j])
            if len(held) >= _LEAST and any(len(p & held) >= CONFIRM * len(p) and len(p & held) > max(len(p & k) for k in alone) for _, p in _PAIRS):
                out.append((i, j))
    return out


def blocks(lines: list[list[str]]) -> list[tuple[int, int]]:
    """Ranges (first, last) of two or more neighbouring lines with words: paragraphs between blank lines."""
    out, start = [], None
    for i, line in enumerate([*lines, []]):
        if line and start is None:
            start = i
        elif not line and start is not None:
            if i - start > 1:
                out.append((start, i - 1))
            start = None
    return out


def scan_text(text: str | None, model: LicenseModel) -> list[dict]:
    """Predicted paragraphs of one whole text, numbered by their first line from 0: lines, blocks of lines between
    blank ones, and notices wrapped over some lines of a block.

    All lines and blocks are classified.  Of paragraphs that lie within each other, or overlap and are of one
    family, the confirmed one most like a template stays, then the one of fewest lines.
    """
    if not text:
        return []
    lines = [tokens(line) for line in text.split("\n")]
    found = []
    for i, j in [(k, k) for k, x in enumerate(lines) if x] + blocks(lines) + wrapped(lines):
        words = lines[i] if i == j else [w for line in lines[i : j + 1] for w in line]
        family, probability = model.classify(words)
        if family != UNKNOWN:
            like = likeness(family, words)
            found.append((i, j, {"paragraph": i, "family": family, "probability": probability, "likeness": like, "confirmed": like >= CONFIRM}))
    kept: list[tuple[int, int, dict]] = []
    over: dict[int, list[int]] = {}  # the kept ones over each line; what lies within another or overlaps it shares a line
    for i, j, row in sorted(found, key=lambda x: (-x[2]["likeness"] if x[2]["confirmed"] else 1, x[1] - x[0], x[0])):
        met = [kept[k] for k in {k for line in range(i, j + 1) for k in over.get(line, ())}]
        if not any((a <= i and j <= b) or (i <= a and b <= j) or r["family"] == row["family"] for a, b, r in met):
            for line in range(i, j + 1):
                over.setdefault(line, []).append(len(kept))
            kept.append((i, j, row))
    return [row for _, _, row in sorted(kept, key=lambda x: x[:2])]


def scan(docs: DataFrame, model: LicenseModel, text: str = "text", name: str = "licenses") -> DataFrame:
    """`docs` with the predicted paragraphs of each whole text; null or empty texts have none.

    If `docs` has a column of the new name, that one keeps it and the paragraphs get underscores in front.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()), ("confirmed", pa.bool_())]))

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for part in slices(pa.record_batch([texts], names=["text"]), "text"):
            out += [scan_text(t, sent.value) for t in part.column("text").to_pylist()]
        return pa.array(out, kind)

    return docs.withColumn(free_name(docs, name), run(F.col(text).cast("string")))


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, number of license paragraphs, those confirmed, and the confirmed families in order.

    Repeated rows are scanned each; an empty table gives an empty result.
    """
    if not docs.head(1):
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_predicted long, n_confirmed long, families string")
    found = scan(docs.select("doc_id", "text"), fit(docs))
    sure = F.filter("licenses", lambda x: x["confirmed"])
    report = found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_predicted"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
    )
    return cut(report, "licenses")
