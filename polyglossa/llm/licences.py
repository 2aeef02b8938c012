"""Licence scans with a trained paragraph classifier, DataFrame functions only.

A multinomial logistic regression over sparse word bigrams and trigrams tells licence families and `none` apart. It is trained on the
templates below, in whole and in parts, against a bounded sample of the corpus' own paragraphs as class `none`: half of them without
a licence word, half with one but next to nothing of a template. A paragraph ends at a blank line or at a line end behind a closing mark, so
wrapped notices stay together; long ones are read in overlapping windows of words. The model scores every window, with or without a licence
word: words that no template has are masked, as no gram with one of them is a feature, and a window without two words that stand side by side in a
template, which has no feature at all, is none. The model is asked twice: how much speaks for a licence at all (all families together), and which family
is likeliest. A window over the first threshold only is `unknown`: a licence that no template has. One over both is confirmed by the share of its
trigrams in the family's templates, or of a template's trigrams in the window, and by a trigram that no other family has; one that is not is
`unknown` too. Both thresholds are calibrated on rows that the model was not fitted on: what speaks for a licence in families that were left
out of the fit stands for unlisted licences, a quarter of the sample for none.

One result per row, repeated rows and null ids too. Null and empty texts have no paragraphs. Other
columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, keep

#: Sentences of widely used licences and of their notices.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "BSD": (
        "Distributed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0, the Creative Commons Attribution-ShareAlike license.",
        "Released under the Creative Commons Zero (CC0) public domain dedication.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
}
#: Words of the templates; a gram with another word is no feature.
TERMS = tuple(sorted({w for ts in TEMPLATES.values() for t in ts for w in re.findall("[a-z0-9]+", t.lower())}))
#: A letter or digit; what stands between two words of a masked text.
_CHAR, _GAP = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}|]+"


def _one_of(rows: list[tuple[str, ...]]) -> str:
    """Pattern of rows of letters and gaps, each common beginning once."""
    rest: dict[str, list[tuple[str, ...]]] = {}
    for row in rows:
        rest.setdefault(row[0], []).append(row[1:])
    ends = {x: [r for r in rs if r] for x, rs in rest.items()}
    return "(?:" + "|".join(x + (_one_of(rs) + "?" * (len(rs) < len(rest[x])) if rs else "") for x, rs in ends.items()) + ")"


def _template_grams(n: int) -> str:
    """Pattern of n words that stand side by side in a template; it is tried at the beginnings of words that are not masked."""
    words = [re.findall("[a-z0-9]+", t.lower()) for ts in TEMPLATES.values() for t in ts]
    found = sorted({" ".join(w[i : i + n]) for w in words for i in range(len(w) - n + 1)})
    return f"(?=[a-z0-9])(?<!{_CHAR})" + _one_of([tuple(_GAP if x == " " else x for x in g) for g in found]) + f"(?!{_CHAR})"


#: A word that no template has; two and three words side by side in a template.
_FOREIGN = f"(?={_CHAR})(?<!{_CHAR})(?!{_one_of([tuple(w) for w in TERMS])}(?!{_CHAR})){_CHAR}++"
_TWO, _THREE = _template_grams(2), _template_grams(3)
#: Each match of CUES holds one of these, in lower case.
HINTS = ("licen", "copyright", "warrant", "redistribut", "permission", "public domain", "spdx", "source code form", "mpl")
#: Fixed value: licence words, by which the sample for none is halved.
CUES = r"(?i)licen[cs]|copyright|warrant|redistribut|permission|public domain|spdx|source code form|\bmpl\b"
PARTS = 3
#: Rounds of calibration, each without the families of one in so many.
FOLDS = 4
#: Words of a window, and between the starts of two.
WINDOW, STEP = 80, 40


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _paragraphs(text: Column) -> Column:
    return F.split(text, r"\n[ \t\r]*\n\s*|(?<=[.!?:;])[ \t\r]*\n")


def _windows(paragraph: Column) -> Column:
    # bound by a lambda, as the words would be cut again for each window otherwise
    cut = F.array(F.split(F.trim(F.regexp_replace(paragraph, r"\s+", " ")), " "))
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (WINDOW - STEP), F.lit(1)), F.lit(STEP))
    return F.transform(cut, lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, WINDOW), " ")))[0]


def _seen(low: Column) -> Column:
    """Structs, one for each window with two words side by side in a template, of mask (its words, each stretch of words that no template has as |) and n_own (its distinct trigrams; 0 where none is a template's). low: text in lower case, without |."""
    # a paragraph is masked before it is cut; blanks stay, so it is cut like its own text
    mask = lambda p: F.regexp_replace(p, _FOREIGN, "|")
    tidy = lambda w: F.regexp_replace(F.trim(F.regexp_replace(w, _GAP, " ")), r"\|(?: ?\|)+", "|")
    kind = "array<struct<mask: string, n_own: int>>"
    none = F.array().cast(kind)
    n_own = lambda w, own: F.when(w.rlike(_THREE), F.size(F.array_distinct(_grams(_words(own), 3)))).otherwise(0)
    told = lambda w, n: F.when(w.rlike(_TWO), F.struct(tidy(w).alias("mask"), n.alias("n_own")))
    plain = lambda m: F.transform(_windows(m), lambda w: told(w, F.lit(0))).cast(kind)
    near = lambda m, p: F.zip_with(_windows(m), _windows(p), lambda w, own: told(w, n_own(w, own))).cast(kind)
    masked = lambda p: F.transform(F.array(mask(p)), lambda m: F.when(m.rlike(_THREE), near(m, p)).otherwise(plain(m)))[0]
    each = F.transform(_paragraphs(low), lambda p: F.when(p.rlike(_TWO), masked(p)).otherwise(none))
    return F.when(low.rlike(_TWO), F.array_compact(F.flatten(each))).otherwise(none)


def _features(df: DataFrame) -> DataFrame:
    w = df if "words" in df.columns else df.withColumn("words", _words(F.col("unit")))
    return w.withColumn("grams", F.concat(_grams(F.col("words"), 2), _grams(F.col("words"), 3)))


def _shares(df: DataFrame, templates: DataFrame) -> DataFrame:
    """df (words, f) with `share`, the larger part of trigrams in common with a template of family f, of the template's or of its own; `own_share`, the latter; `telling`, whether one of them is no other family's. Masked words come with n_own, the number of their own trigrams."""
    own = F.array_distinct(_grams(F.col("words"), 3))
    named = templates.withColumnRenamed("family", "of")
    both = df.withColumn("own", own).join(F.broadcast(named), F.col("f") == F.col("of"), "left")  # as many rows as families
    of_template = F.array_max(F.transform("shingles", lambda t: F.size(F.array_intersect("own", t)) / F.size(t)))
    n_own = F.col("n_own") if "n_own" in df.columns else F.size("own")
    of_own = F.coalesce(F.when(n_own > 0, F.size(F.array_intersect("own", F.flatten("shingles"))) / n_own), F.lit(0.0))
    share = F.coalesce(F.greatest(of_template, of_own), F.lit(0.0))
    return both.withColumns({"share": share, "own_share": of_own, "telling": F.coalesce(F.arrays_overlap("own", "alone"), F.lit(False))}).drop("own", "of", "shingles", "alone")


def scan_documents(df: DataFrame, sample: int = 2_000, confirm: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence (family, 'unknown' or null), probability (of the family; for unknown, of any licence), confirmed, n_paragraphs (windows of a family or unknown)."""
    spark = df.sparkSession
    families = ["none", *TEMPLATES]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lowered = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.translate(F.lower(text), "|", "/").alias("low"))
    hinted = reduce(Column.__or__, (F.col("low").contains(x) for x in HINTS))
    cued = F.when(hinted, F.filter(F.flatten(F.transform(F.filter(_paragraphs(F.col("text")), lambda p: p.rlike(CUES)), _windows)), lambda u: u.rlike(CUES)))
    # rows get a number that stays, as it is stored; of windows, what the model reads, and those with a licence word whole for the sample
    rows = lowered.select(F.monotonically_increasing_id().alias("row"), "doc_id", _seen(F.col("low")).alias("seen"), cued.alias("units"), F.size(_paragraphs(F.col("text"))).alias("n"))
    rows = keep(spark, rows, "licence-rows")
    cued = rows.select("row", F.explode("units").alias("unit"))
    windows = rows.select("row", F.inline("seen")).select("row", F.split("mask", " ").alias("words"), "n_own")
    known = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, unit string").withColumn("words", _words(F.col("unit")))
    # the trigrams of each template; of a template of two words there is none
    templates = known.select("family", _grams(F.col("words"), 3).alias("t")).filter(F.size("t") > 0).groupBy("family").agg(F.collect_list("t").alias("shingles"))
    alone = templates.select("family", F.explode(F.flatten("shingles")).alias("t")).groupBy("t").agg(F.min("family").alias("family"), F.max("family").alias("last")).filter("family = last")
    templates = templates.join(alone.groupBy("family").agg(F.collect_set("t").alias("alone")), "family")
    # templates, and parts of each, so that cut or wrapped notices are met in training; the last part is for calibration
    size = F.size("words")
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.struct(F.array_join(F.slice("words", (k * size / PARTS).cast("int") + 1, F.greatest((size * 2 / PARTS).cast("int"), F.lit(4))), " ").alias("unit"), (k < PARTS - 1).alias("fit")))
    positive = known.select("family", "unit", F.lit(True).alias("fit")).union(known.select("family", F.explode(parts).alias("p")).select("family", "p.unit", "p.fit"))

    def few(units: DataFrame, n: int, fits: Column = F.lit(True)) -> DataFrame:
        """Half the sample, units that fit, by the smallest hashes, each text once; n is about the number of units. Only a share of the hashes is ever looked at, shuffled or sorted."""
        hashed = units.select("unit", F.xxhash64("unit").alias("h"))
        cut = min(1.0, (2 * sample + 100) / max(n, 1))
        low = hashed.filter(F.col("h") <= int(-(2**63) + cut * (2**64 - 2**12))).filter(fits).distinct().orderBy("h", "unit").limit(sample // 2)
        return low.select(F.lit("none").alias("family"), "unit", (F.pmod("h", F.lit(4)) > 0).alias("fit"))

    n, n_cued = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.greatest(F.size("units"), F.lit(0))), F.lit(0))).first()
    plain = df.select(F.explode(_paragraphs(text)).alias("unit")).filter(F.length("unit") > 0)
    every = templates.select(F.lit("any").alias("family"), F.explode("shingles").alias("t")).groupBy("family").agg(F.collect_list("t").alias("shingles"))
    near = few(cued, n_cued).union(few(plain, n, ~F.col("unit").rlike(CUES))).withColumn("words", _words(F.col("unit"))).withColumn("f", F.lit("any"))
    # a licence, unlisted or without a licence word, shares some trigrams with the templates, and must not stand for none
    near = _shares(near, every.withColumn("alone", F.array().cast("array<string>"))).filter("share < 0.2 and own_share < 0.05").select(F.lit("none").alias("family"), "unit", "fit")
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    train = keep(spark, _features(positive.union(near)).select("family", "fit", "grams", label.alias("label")).coalesce(1), "licence-train")
    # what several families say, once more by itself: it tells licences from none, whichever family it is
    own = train.filter("label > 0").select("family", "fit", "label", "grams", F.explode("grams").alias("g"))
    said = own.groupBy("g").agg(F.count_distinct("family").alias("k")).filter("k > 1").select("g")  # of templates only
    shared = own.join(F.broadcast(said), "g").groupBy("family", "fit", "label", "grams").agg(F.collect_list("g").alias("some")).drop("grams").withColumnRenamed("some", "grams")
    fitted = keep(spark, train.unionByName(shared).coalesce(1), "licence-fit")
    # both sides weigh alike, however many paragraphs stand for none
    n_none, n_some = fitted.filter("fit").agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") > 0)).first()
    weighed = fitted.withColumn("weight", F.when(F.col("label") > 0, max(1.0, n_none / n_some)).otherwise(1.0))
    vectors = CountVectorizer(inputCol="grams", outputCol="x", binary=True, vocabSize=1 << 14, minDF=1.0).fit(fitted.filter("label > 0"))
    classifier = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=0.001, maxIter=60, tol=1e-4)
    weighed = keep(spark, vectors.transform(weighed), "licence-vectors")

    def probabilities(model: LogisticRegressionModel, frame: DataFrame) -> DataFrame:
        """With some (probability of any family), best (of the likeliest) and f (that family)."""
        scored = model.transform(frame).withColumn("p", vector_to_array("probability"))
        best = F.array_max(F.slice("p", 2, len(families) - 1))
        return scored.withColumns({"some": 1 - F.col("p")[0], "best": best, "f": F.element_at(F.array(*map(F.lit, families)), F.array_position(F.col("p"), best).cast("int"))})

    model = classifier.fit(weighed.filter("fit"))
    # families left out stand for unlisted licences; they keep their place among the classes, without rows
    out = [(F.col("label") > 0) & (F.col("label") % FOLDS == k) for k in range(FOLDS)]
    strange = reduce(DataFrame.union, (probabilities(classifier.fit(weighed.filter("fit").filter(~o)), weighed.filter(o)).select("some", "best") for o in out))
    rest = probabilities(model, weighed.filter("not fit"))
    odds = F.ln(F.col("some")) - F.ln(F.greatest(1 - F.col("some"), F.lit(1e-12)))
    low, unlisted = strange.agg(F.percentile(odds, F.lit(0.5)), F.percentile("best", F.lit(0.9))).first()
    plain, sure = rest.agg(F.max(F.when(F.col("label") == 0, odds)), F.percentile(F.when(F.col("f") == F.col("family"), F.col("best")), F.lit(0.1))).first()
    # halfway, in log odds, between the least plain paragraph and half of the unlisted licences; between those and the families
    licence_at = max(0.02, min(0.8, 1 / (1 + math.exp(-((low if plain is None else plain) + low) / 2))))
    family_at = max(0.3, min(0.9, (unlisted + (sure or 1.0)) / 2))
    found = _shares(probabilities(model, vectors.transform(_features(windows))).filter(F.col("some") >= licence_at).select("row", "words", "n_own", "some", "best", "f"), templates)
    found = found.withColumn("confirmed", (F.col("best") >= family_at) & (F.col("share") >= confirm) & F.col("telling"))
    licence = F.when(F.col("confirmed"), F.col("f")).otherwise("unknown")
    hits = found.select("row", "confirmed", licence.alias("licence"), F.round(F.when(F.col("confirmed"), F.col("best")).otherwise(F.col("some")), 6).alias("probability"))
    order = F.struct(F.col("confirmed").cast("int"), "probability", "licence")
    best = keep(spark, hits.groupBy("row").agg(F.max_by("licence", order).alias("licence"), F.max_by("probability", order).alias("probability"), F.max("confirmed").alias("confirmed"), F.count("*").alias("n_paragraphs")), "licence-hits")
    discard(spark, train, fitted, weighed)
    return rows.select("row", "doc_id").join(best, "row", "left").select(
        "doc_id", "licence", "probability", F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs")
    )
