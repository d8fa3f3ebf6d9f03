"""Licence scans: a trained paragraph classifier whose findings a comparison with templates confirms.

A paragraph is a line. Its features are the words and word pairs it contains; a multinomial logistic regression with an L1
penalty (MLlib) tells apart the licence families, licence notices of no known family ("unknown") and ordinary prose
("none"). It is fitted on the fixed templates, on edits of them, and on a bounded sample of corpus paragraphs. A second
regression on held-out examples turns the margin of the best family into a probability that the family is right.

Scoring covers every paragraph of every text. The weights bound how far a paragraph without certain features can get, so
those features are a screen that loses nothing: what lacks all of them is "none" by arithmetic, not by assumption.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, written

NONE, UNKNOWN = "none", "unknown"

# Short notices of well-known licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
}

# Notices that name no family; {} stands for an invented name.
OTHER_NOTICES = (
    "Licensed under the {} License.",
    "Released under the {} License, version 1.",
    "This work is licensed under the {} License, version 2.",
    "Distributed under the terms of the {} Public License.",
    "You may use this file under the {} license agreement.",
    "All rights reserved by {}; no license is granted.",
)
INVENTED = ("Aldora", "Brimwood", "Cressil", "Dunhart", "Elmstow", "Farrow Vale", "Gildern", "Hollin")
#: Corpus paragraphs the classifier is fitted on at most; the smallest hashes are taken, so the sample is the same each time.
SAMPLE = 2000
#: Paragraphs with such wording are never examples of ordinary prose.
WORDING = "(?i)licen[sc]|permission|redistribut|copyright|all rights reserved"
SIMILAR = 0.8
SHINGLE = 3
MARGIN = 0.5


def grams_of(text: str) -> list[str]:
    """Distinct words and word pairs, as ``grams`` gives them for a column."""
    words = [w for w in re.split(r"[^0-9a-z]+", text.lower()) if w]
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^0-9a-z]+"), lambda w: w != "")


def grams(w: str) -> Column:
    """Of a column of words; it must be a column, as each step of the transform looks into it."""
    w = F.col(w)
    return F.array_distinct(F.concat(w, F.transform(F.slice(w, 2, F.size(w)), lambda x, i: F.concat_ws(" ", F.get(w, i), x))))


def shingles(w: Column) -> Column:
    return F.array_distinct(F.when(F.size(w) < SHINGLE, F.array(F.concat_ws(" ", w))).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.concat_ws(" ", F.slice(w, i, SHINGLE)))))


def examples() -> list[tuple[str, str, bool]]:
    """(text, class, held out): templates and their edits. An edit leaves out one or two words, or keeps one side."""
    out = []
    notices = [(t, k) for k, texts in TEMPLATES.items() for t in texts] + [(t.format(n), UNKNOWN) for t in OTHER_NOTICES for n in INVENTED]
    for text, kind in notices:
        parts = text.split()
        edits = [text, text.upper(), f"{text} {text}"]
        own = {w.lower() for w in parts}
        # Without the words that set the family apart from the others a notice names no family any more.
        apart = own - {w.lower() for t, k in notices if k != kind for w in t.split()}
        for i, w in enumerate(parts):
            if w.lower() not in apart:
                edits.append(" ".join(parts[:i] + parts[i + 1 :]))
                edits.append(" ".join([*parts[:i], "the", *parts[i:]]))
        out += [(e, kind, j % 5 == 4) for j, e in enumerate(edits)]
    return out


@dataclass(frozen=True)
class Model:
    """Weights per gram (one per class, ``classes`` order), intercepts, and the calibration p = 1 / (1 + exp(-(a m + b)))."""

    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    intercepts: tuple[float, ...]
    slope: float
    shift: float
    common: frozenset[str]

    def screen(self) -> list[str]:
        """Grams of which a paragraph must have one to be anything but "none": without them the largest sum any other
        class can reach above "none" stays below zero."""
        none = self.classes.index(NONE)
        needed: set[str] = set()
        for k in range(len(self.classes)):
            if k == none:
                continue
            gain = sorted(((w[k] - w[none], g) for g, w in self.weights.items() if w[k] > w[none]), reverse=True)
            left = self.intercepts[k] - self.intercepts[none] + math.fsum(g for g, _ in gain)
            for value, gram in gain:
                if left < 0:
                    break
                needed.add(gram)
                left -= value
            if left >= 0:
                raise ValueError(f"class {self.classes[k]} wins without any feature; fit on more ordinary paragraphs")
        return sorted(needed)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its number from 0), text of every line with a letter or digit."""
    text = body(docs)
    each = docs.select(docs["doc_id"].alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("paragraph", "text"))
    return each.where(F.trim("text") != "")


def prose(docs: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` distinct paragraphs without licence wording, picked by the hash of their text: the same each time."""
    each = paragraphs(docs).select(F.xxhash64("text").alias("h"), "text").where(~F.col("text").rlike(WORDING))
    every = max(1, each.agg(F.approx_count_distinct("h")).first()[0] // sample)
    return each.where(F.pmod("h", F.lit(every)) == 0).dropDuplicates(["h"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the templates and their edits, and on ``sample`` paragraphs of the corpus without licence wording, as "none";
    a table with fewer, or none, is made up to that number by paragraphs without features.

    Grams that ordinary paragraphs of the sample contain tell nothing and are no features, so few paragraphs pass the screen.
    """
    spark = docs.sparkSession
    notices = examples()
    classes = (NONE, UNKNOWN, *TEMPLATES)
    ordinary = written(prose(docs, sample).withColumn("w", words(F.col("text"))).withColumn("g", grams("w")).select("h", "g"), "prose")
    candidates = sorted({g for t, _, _ in notices for g in grams_of(t)})
    common = {r["g"] for r in ordinary.select(F.explode("g").alias("g")).where(F.col("g").isin(candidates)).distinct().collect()}  # of the candidates
    vocabulary = [g for g in candidates if g not in common]
    given = spark.createDataFrame([(float(classes.index(k)), held, grams_of(t)) for t, k, held in notices], "label double, held boolean, g array<string>")
    none = ordinary.orderBy("h").select(F.lit(0.0).alias("label"), (F.pmod("h", F.lit(5)) == 4).alias("held"), "g")
    # Where the corpus has fewer ordinary paragraphs, some without any feature stand in: most are like that.
    short = spark.range(max(0, sample - ordinary.count())).select(F.lit(0.0).alias("label"), (F.col("id") % 5 == 4).alias("held"), F.array().cast("array<string>").alias("g"))
    features = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="g", outputCol="features").setBinary(True)
    # A bounded table in one partition: sums have one order, so every run finds the same weights.
    rows = written(features.transform(given.unionByName(none).unionByName(short)).select("features", "label", "held").coalesce(1), "licence-examples").coalesce(1)
    model = LogisticRegression(family="multinomial", regParam=2e-3, elasticNetParam=0.5, maxIter=60, standardization=False).fit(rows.where(~F.col("held")))
    weights = model.coefficientMatrix.toArray()
    kept = {g: tuple(float(x) for x in weights[:, j]) for j, g in enumerate(vocabulary) if weights[:, j].any()}
    scored = model.setPredictionCol("best").transform(rows.where("held")).select(vector_to_array("rawPrediction").alias("raw"), "label", "best")
    margin = F.array_max(F.slice("raw", 3, len(TEMPLATES))) - F.greatest(F.get("raw", F.lit(0)), F.get("raw", F.lit(1)))
    right = ((F.col("label") >= 2) & (F.col("label") == F.col("best"))).cast("double")
    pairs = scored.select(array_to_vector(F.array(margin)).alias("features"), right.alias("label")).coalesce(1)
    cal = LogisticRegression(regParam=1e-3, maxIter=60).fit(pairs)
    return Model(classes, kept, tuple(float(x) for x in model.interceptVector), float(cal.coefficients[0]), float(cal.intercept), frozenset(common))


def _screen(model: Model) -> str:
    """A pattern that every paragraph with one of the screen's grams has: the pair itself, or a word of it that is not common."""
    rare = lambda g: [w for w in g.split(" ") if w not in model.common]
    forms = {max(rare(g), key=len) if rare(g) else r"[^0-9a-z]+".join(g.split(" ")) for g in model.screen()}
    return r"(?<![0-9a-z])(?:" + "|".join(sorted(forms)) + ")(?![0-9a-z])"


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per paragraph that is a licence notice: doc_id, paragraph, family, probability, similarity, confirmed.

    ``family`` is "unknown" when the paragraph reads like a notice but no family reaches a calibrated probability of one
    half. ``similarity`` is the largest share of a template's word triples, among the templates of the family, that the
    paragraph contains; from 0.8 on the family is ``confirmed``. Null and empty texts have no paragraphs. Repeated rows give
    repeated findings. An empty table gives no rows. Only doc_id and text are read.
    """
    model = model or fit(docs)
    spark, classes = docs.sparkSession, model.classes
    near = paragraphs(docs).where(F.lower("text").rlike(_screen(model)))
    near = written(near.select(F.monotonically_increasing_id().alias("key"), "doc_id", "paragraph", words(F.col("text")).alias("w")), "screened")
    weights = spark.createDataFrame(sorted(model.weights.items()), "g string, v array<double>")  # as many rows as the templates have grams
    sums = near.select("key", F.explode(grams("w")).alias("g")).join(F.broadcast(weights), "g").groupBy("key").agg(
        *[(F.sum(F.get("v", F.lit(k))) + model.intercepts[k]).alias(f"c{k}") for k in range(len(classes))]
    )
    families = [f"c{k}" for k in range(2, len(classes))]
    sums = sums.withColumn("best", F.greatest(*families)).where(F.greatest("best", "c1") > F.col("c0"))
    scored = near.join(sums, "key").withColumn("family_raw", F.array(*families))
    scored = scored.withColumn("p", 1 / (1 + F.exp(-(model.slope * (F.col("best") - F.greatest("c0", "c1")) + model.shift))))
    family = F.when(F.col("p") >= MARGIN, F.element_at(F.array(*[F.lit(c) for c in classes[2:]]), F.array_position("family_raw", F.col("best")).cast("int"))).otherwise(F.lit(UNKNOWN))
    named = scored.withColumn("family", family)
    forms = F.array(*[F.struct(F.lit(k).alias("family"), F.array(*[F.lit(s) for s in _triples(t)]).alias("s")) for k, texts in TEMPLATES.items() for t in texts])
    own = shingles(F.col("w"))
    share = F.array_max(F.transform(F.filter(forms, lambda f: f["family"] == F.col("family")), lambda f: F.size(F.array_intersect(f["s"], F.col("own"))) / F.size(f["s"])))
    out = named.withColumn("own", own).withColumn("similarity", F.coalesce(share, F.lit(0.0)))
    return out.select("doc_id", F.col("paragraph").cast("int").alias("paragraph"), "family", F.round("p", 3).alias("probability"), F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= SIMILAR).alias("confirmed"))


def _triples(text: str) -> list[str]:
    w = [x for x in re.split(r"[^0-9a-z]+", text.lower()) if x]
    return sorted({" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))})
