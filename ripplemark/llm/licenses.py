"""Licence families of paragraphs, by a trained sparse n-gram classifier.

A multinomial logistic regression over word unigrams and bigrams is fitted
on licence notices, written out below, on ordinary sentences that use their
words, and on a bounded sample of the corpus as the class ``unknown``. Its
probabilities are calibrated by a temperature on a held-out part. A family
is reported if its probability reaches a limit; a comparison of word
trigrams with the family's notices confirms it.

Features hold at least one word that is not a stop word (an anchor). A
paragraph without any anchor has no feature, so its class is ``unknown`` and
it needs no scoring. The distinct paragraphs with anchors are scored once.

All of it is DataFrame expressions and Spark's own regression.

Cases: a null or empty text has no paragraphs; rows repeated with one id
are each reported; an empty table gives an empty result; paragraphs are
lines, handled whole; of families with equal probability the first by name
is taken.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import text_of
from ripplemark.session import stage

#: Paragraphs of the corpus that stand for ``unknown`` in training, about.
SAMPLE = 2000
#: Features of the model at most; they are the n-grams of the notices.
FEATURES = 4096
PROBABILITY, CONFIRMED = 0.6, 0.5
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)

# Short public notices by family.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache 2.0 license.",
        "This project is distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
        "This code is licensed under the terms of the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the BSD 2-Clause License.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under the Creative Commons Attribution License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the Creative Commons Attribution-NonCommercial License, for non-commercial use only.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL, version 2 or later.",
        "Licensed under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Released under the LGPL, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Licensed under the MIT license.",
        "This project is distributed under the terms of the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "All rights reserved. Reproduction in whole or in part without written permission is prohibited.",
    ],
}
# Sentences with the same words that are no notices.
ORDINARY = [
    "The driver must show a valid license at the counter.",
    "She got her driving license in spring and a fishing license in summer.",
    "The software was released last week and the new version works.",
    "Apache is a web server and the name of a people.",
    "He studied at MIT and works in public service.",
    "Permission to enter the building was granted by the office.",
    "General terms and conditions of sale are listed below.",
    "The public library has free copies of the work.",
    "Copyright law differs from country to country.",
    "The source code of the program was written in one night.",
    "A notice about the distribution of food was published.",
    "No commercial use of the beach is planned, the mayor said.",
    "They share the content with all users under one roof.",
    "All seats are reserved and no rights are lost.",
    "The foundation gave the creative class a common room.",
]
STOP = (
    "a an and any are as at be been but by can for from had has have he her his if in into is it its may more must no not of on "
    "or our shall should she so such than that the their them then there these they this to was we were what when which "
    "who will with without would you your one all"
).split()
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *sorted(NOTICES)]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def features(text: Column) -> Column:
    """Distinct unigrams that are no stop words, and bigrams with at least one word that is none."""
    words = tokens(text)
    stop = lambda w: w.isin(STOP)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.transform(F.filter(pairs, lambda p: ~(stop(p["a"]) & stop(p["b"]))), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    return F.array_distinct(F.concat(F.filter(words, lambda w: ~stop(w)), pairs))


def shingles(text: Column) -> Column:
    """Distinct word trigrams; a shorter text is one shingle."""
    words = tokens(text)
    n = F.size(words) - 2
    return F.when(n < 1, F.array(F.concat_ws(" ", words))).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, 3))))
    )


def labelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, family``: notices whole and in halves, ordinary sentences, and sampled paragraphs of the corpus."""
    spark = docs.sparkSession
    known = [(n, family) for family, notices in NOTICES.items() for n in notices] + [(s, UNKNOWN) for s in ORDINARY]
    cut = []
    for text, family in known:
        words = text.split()
        cut += [(text, family), (text.upper(), family)]
        if len(words) > 12:
            cut += [(" ".join(words[: len(words) // 2 + 3]), family), (" ".join(words[len(words) // 2 - 3 :]), family)]
    own = spark.createDataFrame(cut, "text string, family string")
    n = docs.count()
    share = min(1.0, sample / n) if n else 0.0
    body = F.filter(F.split(F.col("body"), "\n"), lambda p: F.size(tokens(p)) > 3)
    picked = docs.select(F.col("body")).where(F.abs(F.xxhash64(F.lit("sample"), "body") % 1_000_000) < int(share * 1_000_000))
    # One paragraph of a document, by hash; the notices themselves stay out.
    one = picked.select(F.try_element_at(F.array_sort(F.transform(body, lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("p")))), F.lit(1))["p"].alias("text"))
    return own.union(one.where("text is not null").where(~F.regexp_like(F.lower("text"), F.lit("licen[cs]e|copyright"))).distinct().withColumn("family", F.lit(UNKNOWN)))


def weights_of(rows: DataFrame) -> tuple[DataFrame, list[float]]:
    """``feature, w`` with one weight per family, and the families' intercepts."""
    spark = rows.sparkSession
    label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("double") - 1
    ready = rows.select(features(F.col("text")).alias("words"), label.alias("label"))
    notices = spark.createDataFrame([(n,) for family in NOTICES.values() for n in family], "text string")
    vocabulary = [r["feature"] for r in notices.select(F.explode(features(F.col("text"))).alias("feature")).distinct().orderBy("feature").limit(FEATURES).collect()]
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="features")
    sizes = {r["label"]: r["count"] for r in ready.groupBy("label").count().collect()}
    # Families weigh alike, however many paragraphs stand for unknown.
    weight = F.lit(0.0)
    for one, n in sizes.items():
        weight = F.when(F.col("label") == one, sum(sizes.values()) / (len(sizes) * n)).otherwise(weight)
    ready = counted.setBinary(True).transform(ready).select("label", "features", weight.alias("weight")).coalesce(2)
    model = LogisticRegression(
        family="multinomial", weightCol="weight", regParam=0.001, elasticNetParam=0.3, maxIter=40, standardization=False
    ).fit(ready)
    matrix = model.coefficientMatrix.toArray()
    table = [(word, [float(x) for x in matrix[:, n]]) for n, word in enumerate(vocabulary) if matrix[:, n].any()]
    return spark.createDataFrame(table, "feature string, w array<double>"), [float(x) for x in model.interceptVector]


def logits(texts: DataFrame, weights: DataFrame, intercepts: list[float]) -> DataFrame:
    """Distinct ``text`` with ``z``, a logit per family. The weights are at most FEATURES rows, so they are broadcast."""
    each = texts.select("text", F.explode(features(F.col("text"))).alias("feature")).join(F.broadcast(weights), "feature")
    sums = each.groupBy("text").agg(*[F.sum(F.col("w")[n]).alias(f"z{n}") for n in range(len(FAMILIES))])
    return sums.select("text", F.array(*[F.col(f"z{n}") + F.lit(b) for n, b in enumerate(intercepts)]).alias("z"))


def softmax(z: Column, temperature: float) -> Column:
    top = F.array_max(z)
    powers = F.transform(z, lambda x: F.exp((x - top) / temperature))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, list[float], float]:
    """Weights, intercepts and the temperature that suits a held-out part best."""
    rows = stage(labelled(docs, sample), "labelled")
    held = F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(5)) == 0
    weights, intercepts = weights_of(rows.where(~held))
    tried = rows.where(held).distinct().join(logits(rows.where(held).select("text").distinct(), weights, intercepts), "text")
    truth = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("int")
    losses = tried.agg(*[F.avg(-F.log(F.element_at(softmax(F.col("z"), t), truth) + 1e-12)).alias(f"t{n}") for n, t in enumerate(TEMPERATURES)]).first()
    temperature = min(zip(losses, TEMPERATURES))[1] if losses[0] is not None else 1.0
    weights, intercepts = weights_of(rows)
    return stage(weights, "weights"), intercepts, temperature


def anchors_of(weights: DataFrame) -> list[str]:
    """Words that every feature has at least one of; at most twice FEATURES."""
    words = weights.select(F.explode(F.split("feature", " ")).alias("word")).where(~F.col("word").isin(STOP)).distinct()
    return sorted(r["word"] for r in words.collect())


def license_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, probability: float = PROBABILITY) -> DataFrame:
    """``doc_id, paragraph_no, paragraph, family, probability, overlap, confirmed`` of every paragraph of a known family."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
    weights, intercepts, temperature = fit(rows, sample)
    anchors = anchors_of(weights)
    lines = F.transform(F.split("body", "\n"), lambda p, i: F.struct(i.alias("paragraph_no"), p.alias("text")))
    anchored = F.filter(lines, lambda x: F.exists(F.split(F.lower(x["text"]), "[^a-z0-9]+"), lambda w: w.isin(anchors)))
    found = stage(rows.select("doc_id", F.explode(anchored).alias("line")).select("doc_id", "line.*"), "anchored")
    scored = logits(found.select("text").distinct(), weights, intercepts)
    p = softmax(F.col("z"), temperature)
    ranked = F.array_max(F.transform(p, lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    best = scored.select("text", ranked.alias("best")).select("text", F.col("best.p").alias("probability"), F.element_at(F.array(*map(F.lit, FAMILIES)), 1 - F.col("best.i")).alias("family"))
    best = best.where((F.col("family") != UNKNOWN) & (F.col("probability") >= probability))
    notices = docs.sparkSession.createDataFrame([(f, n) for f, ns in NOTICES.items() for n in ns], "family string, notice string")
    notices = notices.select("family", shingles(F.col("notice")).alias("known"))
    compared = best.withColumn("own", shingles(F.col("text"))).join(F.broadcast(notices), "family")
    share = F.size(F.array_intersect("own", "known")) / F.least(F.size("own"), F.size("known"))
    known = stage(compared.groupBy("text", "family", "probability").agg(F.max(share).alias("overlap")), "scored")
    return found.join(known, "text").select(
        "doc_id", F.col("paragraph_no").cast("bigint").alias("paragraph_no"), F.col("text").alias("paragraph"), "family",
        F.round("probability", 4).alias("probability"), F.round("overlap", 4).alias("overlap"), (F.col("overlap") >= CONFIRMED).alias("confirmed"),
    )
