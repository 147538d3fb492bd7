"""Licence scan: a trained paragraph classifier, confirmed by template comparison."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import letter_words
from gristmill.session import stage

UNKNOWN = "unknown"
SPAN = 48
STRIDE = 24
SAMPLE_DOCS = 400
NEGATIVES = 2_000
VARIANTS = 24
DROPPED = 0.15
MIN_PROBABILITY = 0.5
MIN_COVERAGE = 0.6
SEED = 42
CALIBRATION = 5

# Notices by which works state their licence, by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at",
        "This project is distributed under the terms of the Apache License 2.0.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation, either version 3 of the License,"
        " or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Distributed under the GNU Affero General Public License.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public_domain": (
        "This work has been released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work"
        " under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "proprietary": (
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any"
        " form without prior written permission of the publisher.",
    ),
}


def template_rows(spark: SparkSession, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``(family, template, words)``."""
    rows = [(family, text) for family, texts in templates.items() for text in texts]
    table = spark.createDataFrame(rows, "family string, template string")
    return table.withColumn("words", letter_words(F.col("template")))


def paragraphs(
    docs: DataFrame,
    span: int = SPAN,
    stride: int = STRIDE,
    screen: Column | None = None,
    keys: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``(*keys, line, at, words)``: the lines of whole texts, long ones in overlapping spans.

    ``line`` counts from 0 and ``at`` is the first word's place in its line. Every word is in a
    span, every run of ``stride`` words wholly in one. Lines without a word are left out, with
    ``screen`` also spans that have none of its words.
    """
    lines = docs.select(*keys, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "part"))
    cut = lines.select(*keys, "line", letter_words(F.col("part")).alias("words"))
    has = lambda words: F.arrays_overlap(words, screen) if screen is not None else F.size(words) > 0
    cut = cut.filter(has(F.col("words")))
    steps = F.ceil(F.greatest(F.size("words") - span, F.lit(0)) / F.lit(stride)).cast("int")
    placed = cut.select(*keys, "line", "words", F.explode(F.sequence(F.lit(0), steps)).alias("step"))
    spans = placed.select(
        *keys, "line", (F.col("step") * stride).alias("at"),
        F.slice("words", F.col("step") * stride + 1, F.lit(span)).alias("words"),
    )
    return spans.filter(has(F.col("words")))


def wrapped_spans(docs: DataFrame, screen: Column, span: int = SPAN, stride: int = STRIDE) -> DataFrame:
    """``(doc_id, mark, line, at, last, words)``: spans over the line ends of paragraphs.

    A paragraph is neighbouring lines with words, so comment marks neither count nor end it. A
    span begins every ``stride`` words of a line, where it reaches beyond the line, and ends
    after ``span`` words or with the paragraph, in line ``last``; spans that have none of the
    words of ``screen`` are left out.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), letter_words)
    # A text without any of the words has no span to look for.
    some = docs.filter(F.arrays_overlap(letter_words(F.col("text")), screen))
    cut = some.select("doc_id", "mark", lines.alias("lines"))

    def spans_of(line: Column) -> Column:
        near = F.slice("lines", line + 1, F.lit(span + 1))
        blank = F.array_position(F.transform(near, F.size), 0).cast("int")
        part = F.slice(near, F.lit(1), F.when(blank > 0, blank - 1).otherwise(F.lit(span + 1)))
        placed = F.flatten(
            F.transform(part, lambda ws, k: F.transform(ws, lambda w: F.struct((line + k).alias("line"), w.alias("w"))))
        )
        own = F.size(F.get("lines", line))
        starts = F.filter(F.sequence(F.lit(0), F.greatest(own - 1, F.lit(0)), F.lit(stride)), lambda s: s + span > own)
        return F.transform(
            F.when(F.size(part) > 1, starts).otherwise(F.array().cast("array<int>")),
            lambda s: F.struct(line.alias("line"), s.alias("at"), F.slice(placed, s + 1, F.lit(span)).alias("placed")),
        )

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size("lines") - 1), spans_of))
    listed = cut.select("doc_id", "mark", F.explode(every).alias("s"))
    spans = listed.select(
        "doc_id", "mark", "s.line", "s.at", F.element_at("s.placed.line", -1).alias("last"), F.col("s.placed.w").alias("words")
    )
    return spans.filter(F.arrays_overlap("words", screen))


def _grams(words: str) -> Column:
    """Distinct words and pairs of neighbouring words."""
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    second = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(first, second, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(F.col(words), pairs))


def _coverage(template: Column, words: Column) -> Column:
    """Share of the template's distinct words that a span has."""
    return F.size(F.array_intersect(template, words)) / F.size(F.array_distinct(template))


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def plain_spans(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most: int = NEGATIVES) -> DataFrame:
    """``(words)``: at most ``most`` spans of ``most_docs`` documents, chosen by seeded hashes."""
    order = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = docs.select("doc_id").distinct().orderBy(order, "doc_id").limit(most_docs)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    spans = paragraphs(some).withColumn("order", F.xxhash64(F.lit(SEED), "doc_id", "line", "at"))
    return spans.orderBy("order").limit(most).select("words").distinct()


def training_rows(plain: DataFrame, templates: DataFrame, variants: int = VARIANTS) -> DataFrame:
    """``(family, words, fold)``: variants of the templates, and plain spans as unknown.

    A variant drops words at random by a seeded hash; plain spans that cover a template are
    left out. Every class is in the left-out fold as its hashes have it.
    """
    kept = lambda w, i: (F.col("copy") == 0) | (
        F.pmod(F.xxhash64(F.lit(SEED), F.col("copy"), F.col("template"), i, w), F.lit(1000)) >= int(DROPPED * 1000)
    )
    varied = templates.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)))).select(
        "family", F.filter("words", kept).alias("words")
    )
    known = [r["words"] for r in templates.select("words").collect()]
    covered = reduce(
        lambda a, b: a | b, [_coverage(_texts(words), F.col("words")) >= MIN_COVERAGE for words in known]
    )
    clear = plain.filter(~covered).select(F.lit(UNKNOWN).alias("family"), "words")
    rows = varied.unionByName(clear).filter(F.size("words") > 0)
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(SEED), "words"), F.lit(CALIBRATION)))


def anchors(plain: DataFrame, templates: DataFrame, min_coverage: float = MIN_COVERAGE) -> list[str]:
    """Words of which a span must have one to cover any template.

    Of each template these are just so many of its words that no span can reach the coverage
    without them; the words that fewest plain spans have are taken. So screening spans by them
    loses nothing.
    """
    common = dict(plain.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count().collect())
    found: set[str] = set()
    for row in templates.select("words").collect():
        words = sorted(set(row["words"]), key=lambda w: (common.get(w, 0), -len(w), w))
        need = math.ceil(min_coverage * len(words) - 1e-9)
        found.update(words[: len(words) - need + 1])
    return sorted(found)


@dataclass(frozen=True)
class LicenceModel:
    """A fitted classifier with its vocabulary, classes, temperature and screening words."""

    fitted: LogisticRegressionModel
    grams: list[str]
    families: list[str]
    heat: float
    anchors: list[str]


def _features(rows: DataFrame, grams: list[str]) -> DataFrame:
    """Add ``features``: which of the vocabulary's n-grams a row's words have."""
    counter = CountVectorizerModel.from_vocabulary(grams, "grams", "features", binary=True)
    return counter.transform(rows.withColumn("grams", _grams("words")))


def train(docs: DataFrame, templates: DataFrame) -> LicenceModel:
    """Multinomial logistic regression with an L1 penalty, so that most weights are zero.

    The features are the words and word pairs of the templates, so the vocabulary is bounded by
    them; what is in no template says nothing. The unknown class is learned from a bounded
    sample of the corpus. A temperature, fitted on the fold left out, calibrates the
    probabilities, that of the unknown class among them.
    """
    plain = stage(plain_spans(docs), "licence-plain")
    rows = training_rows(plain, templates)
    grams = sorted(r["g"] for r in templates.select(F.explode(_grams("words")).alias("g")).distinct().collect())
    families = [UNKNOWN, *sorted(r["family"] for r in templates.select("family").distinct().collect())]
    label = (F.array_position(_texts(families), F.col("family")) - 1).cast("double")
    table = _features(rows.withColumn("label", label), grams)
    # A bounded table of short rows: one task passes over it faster than many could meet.
    table = stage(table.select("fold", "label", "features").coalesce(1), "licence-features")
    fit = LogisticRegression(
        family="multinomial", regParam=1e-3, elasticNetParam=0.5, maxIter=60, standardization=False
    )
    model = fit.fit(table.filter("fold > 0"))
    left_out = model.transform(table.filter("fold = 0")).select("label", vector_to_array("rawPrediction").alias("raw"))
    heats = [0.5 * 1.25**k for k in range(14)]

    def loss(heat: float) -> Column:
        own = F.element_at(_probabilities(F.col("raw"), heat), F.col("label").cast("int") + 1)
        return F.avg(-F.log(F.greatest(own, F.lit(1e-12))))

    losses = left_out.agg(*[loss(h).alias(f"h{i}") for i, h in enumerate(heats)]).first()
    heat = min((x, h) for x, h in zip(losses, heats, strict=True))[1] if losses[0] is not None else 1.0
    return LicenceModel(model, grams, families, heat, anchors(plain, templates))


def _probabilities(raw: Column, heat: float) -> Column:
    scaled = F.transform(raw, lambda x: F.exp((x - F.array_max(raw)) * F.lit(heat)))
    return F.transform(scaled, lambda x: x / F.aggregate(scaled, F.lit(0.0), lambda a, y: a + y))


def scan(docs: DataFrame, min_probability: float = MIN_PROBABILITY, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``(doc_id, line, at, family, probability, coverage)``: the licence notices of all texts.

    All lines are read whole, in spans. A family is reported if its calibrated probability,
    against unknown and all others, is at least ``min_probability`` and the span has at least
    ``min_coverage`` of the words of one of its templates. Both must hold, so the cheaper test
    goes first: spans without any screening word, which cannot cover a template, are passed
    over, then those that cover none; the classifier judges the rest. Of the spans of a line
    the best of each family is kept, ``at`` being its first word's place in the line.

    Documents are not shuffled, only what is reported. Null or empty texts have no spans, null
    ids are kept, rows that repeat an id and a text give one row, and an empty table none. Other
    texts of the same id, or without one, are scanned and reported by themselves.
    """
    templates = stage(template_rows(docs.sparkSession), "licence-templates")
    model = train(docs, templates)
    by_family: dict[str, list[list[str]]] = {}
    for row in templates.select("family", "words").collect():
        by_family.setdefault(row["family"], []).append(row["words"])
    covered = {
        family: F.greatest(F.lit(0.0), *[_coverage(_texts(words), F.col("words")) for words in known])
        for family, known in by_family.items()
    }
    marked = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    screen = _texts(model.anchors)
    single = paragraphs(marked, screen=screen, keys=("doc_id", "mark")).select(
        "doc_id", "mark", F.lit(False).alias("wrapped"), "line", "at", F.col("line").alias("last"), "words"
    )
    spans = single.unionByName(wrapped_spans(marked, screen).withColumn("wrapped", F.lit(True)))
    spans = spans.filter(F.greatest(*covered.values()) >= min_coverage)
    judged = model.fitted.transform(_features(spans, model.grams)).select(
        "doc_id", "mark", "wrapped", "line", "at", "last", "words", vector_to_array("rawPrediction").alias("raw")
    )
    # Written, or the plan would score a span again for every use of its scores.
    judged = stage(judged, "licence-spans")
    p = _probabilities(F.col("raw"), model.heat)
    best = F.array_position("raw", F.array_max("raw")).cast("int")
    named = judged.select(
        "doc_id", "mark", "wrapped", "line", "at", "last", "words",
        F.element_at(_texts(model.families), best).alias("family"), F.array_max(p).alias("probability"),
    ).filter((F.col("family") != UNKNOWN) & (F.col("probability") >= min_probability))
    coverage = F.lit(0.0)
    for family, share in covered.items():
        coverage = F.when(F.col("family") == family, share).otherwise(coverage)
    confirmed = named.withColumn("coverage", coverage).filter(F.col("coverage") >= min_coverage)
    best = F.max(F.struct("coverage", "probability", (-F.col("at")).alias("early"), "last")).alias("best")
    found = confirmed.groupBy("doc_id", "mark", "wrapped", "line", "family").agg(best)
    return _without_overlaps(found).select(
        "doc_id", "line", (-F.col("best.early")).alias("at"), "family",
        F.col("best.probability").alias("probability"), F.col("best.coverage").alias("coverage"),
    )


def _without_overlaps(found: DataFrame) -> DataFrame:
    """All notices of single lines, and of wrapped ones the best where several spans overlap."""
    span = F.struct(
        "wrapped", (-F.col("best.coverage")).alias("c"), (-F.col("best.probability")).alias("p"), "line", "best",
    )
    listed = found.groupBy("doc_id", "mark", "family").agg(F.sort_array(F.collect_set(span)).alias("spans"))

    def add(taken: Column, s: Column) -> Column:
        meets = F.exists(taken, lambda t: (t["line"] <= s["best"]["last"]) & (s["line"] <= t["best"]["last"]))
        return F.when(s["wrapped"] & meets, taken).otherwise(F.concat(taken, F.array(s)))

    chosen = F.aggregate("spans", F.slice("spans", F.lit(1), F.lit(0)), add)
    return listed.select("doc_id", "family", F.explode(chosen).alias("s")).select("doc_id", "family", "s.line", "s.best")
