"""Licence scans: a trained paragraph classifier whose predictions are confirmed by the licences' texts.

Features are the n-grams of one to three words that hold a cue (a stem such as ``licens`` or ``warrant``) or another telling word
of a template, each counted once in a paragraph, and whether it denies a licence. A multinomial logistic regression with an elastic
net, trained here on the built-in examples, weighs them by licence family and for the class of paragraphs that name no licence.
The examples are sentences of the licences' texts, their names and identifiers in common phrases, and, as paragraphs that name
none, negated phrases and everyday sentences with cues. The threshold for ``unknown`` is calibrated on whole sentences and phrases
that another fit has not seen; the weights are then fitted on all. A prediction counts when a template of its family (a sentence or
a name) has enough of its words in the paragraph. Of each template so many words are telling that no paragraph with enough of it
lacks them all (``_telling_words``).

All of it is DataFrame functions and the JVM's own learner; scoring is a projection without a shuffle. Every line of every text is
cut into words, and all that have a feature are scored. A paragraph is a line that holds a notice by itself, or lines of a wrapped
text: each line with a feature is also read with the lines around it, as far as the next line that is blank (has no letter or
digit) or holds a notice by itself, and at most ``AROUND`` words to each side. Null and empty texts have no licence; repeated rows
and rows without an id are scanned like any other.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache, reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Stems and words by which n-grams are features, as a pattern for one lower-case word.
CUE_WORD = "licen|warrant|copyright|permission|redistribut|^creative$|^commons$|^domain$|^cc$|^cc0$|^gnu$|^gpl|^lgpl|^agpl|^apache$|^mozilla$|^bsd$|^mit$|^spdx$"
#: The least share of a template's distinct words that a paragraph has to have.
CONFIRM = 0.75
#: Names and identifiers of each family's licences.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0", "AGPL-3.0-only", "AGPLv3"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0"),
    "bsd-2-clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "bsd-3-clause": ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause"),
    "cc-by-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"),
    "cc-by-nc-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "cc-by-sa-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "cc0-1.0": ("CC0 1.0 Universal license", "CC0 1.0", "CC0-1.0"),
    "epl-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL-2.0"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU GPL, version 2", "GPL-2.0", "GPL-2.0-only", "GPLv2"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU GPL, version 3", "GPL-3.0", "GPL-3.0-or-later", "GPLv3"),
    "isc": ("ISC License", "ISC"),
    "lgpl-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPLv2.1"),
    "lgpl-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"),
    "mit": ("MIT License", "MIT license", "MIT"),
    "mpl-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0"),
    "unlicense": ("Unlicense", "Unlicense license"),
}
#: Phrases that give a name as the licence, and phrases that deny it.
FRAMES = (
    "Licensed under the {}.",
    "Released under the {}.",
    "Distributed under {}.",
    "License: {}",
    "SPDX-License-Identifier: {}",
    "SPDX: {}",
    "This project is licensed under the terms of the {}.",
    "The code is available under the {}, see the LICENSE file.",
    "Published under the {} by its authors.",
)
DENIALS = ("Not licensed under the {}.", "This work is not released under the {}.", "It is no longer distributed under the {}.", "The code was never licensed under the terms of the {}.", "Neither licensed nor released under the {}.")
#: Sentences by which each family's licences are known.
TEXTS: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind.",
        "This project is released under the terms of the Apache 2.0 license.",
    ),
    "agpl-3.0": (
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd-2-clause": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation of the two clause BSD license.",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain, for more information refer to the Unlicense.",
    ),
    "bsd-3-clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution license.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC 4.0 for noncommercial use.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Content is available under CC BY-SA 4.0 unless otherwise noted.",
    ),
    "cc0-1.0": (
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL-3.0 license.",
    ),
    "lgpl-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the LGPL-3.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
}
#: Paragraphs that hold cues and name no licence.
COUNTEREXAMPLES = (
    "He renewed his driver's license last week and kept a copy at home.",
    "The fishing licence costs ten euros and is valid for one year.",
    "A liquor license was granted to the restaurant by the city council.",
    "The company offers a two year warranty on all its products.",
    "The warranty does not cover damage that is caused by water.",
    "Copyright 2019 by the author, all rights reserved.",
    "All rights reserved, no part of this publication may be copied.",
    "You need permission from your parents to join the trip.",
    "The commons were open to every farmer of the village.",
    "She is known as a creative writer with an eye for detail.",
    "The Apache helicopter landed near the base at noon.",
    "The Apache people lived in the south west of the country.",
    "He studied physics at MIT and then moved to Boston.",
    "A researcher at MIT said that the results were promising.",
    "The gnu is a large antelope of the African plains.",
    "License plates of the region begin with two letters.",
    "The state may redistribute the income among its citizens.",
    "An arrest warrant was issued on Monday by the court.",
    "The committee gave its permission to publish the report.",
    "The license server is down, please try again later.",
    "House of Commons debates the new law this evening.",
    "Our creative team redistributes the work among its members.",
    "She got her license while she was at MIT.",
    "His license from MIT hangs on the wall.",
    "The general public has no license to enter the building.",
    "The Mozilla office is on the second floor.",
    "The commission published version 3 of the report.",
    "A license fee of 2.0 percent is due every year.",
    "The BSD conference takes place in May.",
    "The Apache web server runs version 2.0 of the software.",
    "You may copy the file with the permission of the editor.",
    "No licence is needed to sail on the lake.",
)


def _templates() -> dict[str, tuple[str, ...]]:
    """What confirms a family: its sentences, and its names of more than one word or of a word that says it all."""
    telling = lambda n: len(n.replace("-", " ").split()) > 1 or "licen" in n.lower() or any(c.isdigit() for c in n)
    return {f: (*TEXTS.get(f, ()), *(n for n in names if telling(n))) for f, names in NAMES.items()}


TEMPLATES = _templates()
#: Words set around examples, so that a licence is known inside a longer paragraph.
FILLERS = ("", "The text below was written by many hands.", "See the file for more.", "In the beginning there was a house on the hill and it was old.", "Copyright 2020 the authors.")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.+(?=\P{N}|$)"), "")


@lru_cache
def _template_words(text: str) -> frozenset[str]:
    return frozenset(w for w in re.split(r"[^\w.]+|\.+(?=\D|$)", text.lower().replace("_", " ")) if w)


def _telling_words() -> list[str]:
    """Words without which no template is confirmed. A paragraph lacks fewer of a template's words than ``most``, so it has one of
    any ``most`` of them: the cues, and where they are too few the longest words, first of those that no name or phrase has, as
    both also stand where a licence is denied."""
    told, sets = {"version"}, [_template_words(t) for texts in TEMPLATES.values() for t in texts]  # it tells versions apart
    said = _template_words(" ".join((*FRAMES, *DENIALS, *(n for names in NAMES.values() for n in names))))
    for words in sets:
        most = len(words) - math.ceil(CONFIRM * len(words)) + 1
        cues = sum(bool(re.search(CUE_WORD, w)) for w in words)
        plain = sorted((w for w in words if not re.search(CUE_WORD, w)), key=lambda w: (w[0].isdigit(), w in said, -len(w), sum(w in s for s in sets), w))
        told.update(plain[: max(0, most - cues)])
    return sorted(told)


#: Words that are features by themselves.
WHOLE_WORDS = _telling_words()
#: Of each feature, one word is like this.
FEATURE_WORD = CUE_WORD + "".join(f"|^{re.escape(w)}$" for w in WHOLE_WORDS)


def is_feature_word(w: Column) -> Column:
    """Whether a lower-case word fits ``FEATURE_WORD``; a set of literals and plain searches are much cheaper than a pattern."""
    cues = CUE_WORD.split("|")
    stems = [c.lstrip("^") for c in cues if not c.endswith("$")]
    whole = w.isin(*(c.strip("^$") for c in cues if c.endswith("$")), *WHOLE_WORDS)
    return whole | (reduce(or_, (w.contains(s) for s in stems)) & w.rlike(FEATURE_WORD))


def has_cue(low: Column) -> Column:
    """Whether a lower-case text has a feature, but for denials."""
    return F.exists(words_of(low), is_feature_word)


#: Fixed value: how a paragraph denies a licence: a word of denial shortly before one of granting.
DENIED = r"(^| )(not|never|neither|nor|no longer)( [^ ]+){0,3} (licensed|released|distributed|available|published|covered)( |$)"


def ngrams_of(words: Column) -> Column:
    """Distinct n-grams of one to three words that hold a feature word, and ``!`` where a licence is denied."""
    return F.array_distinct(F.concat(_cue_ngrams(words), F.when(F.array_join(words, " ").rlike(DENIED), F.array(F.lit("!"))).otherwise(F.array().cast("array<string>"))))


def _cue_ngrams(words: Column) -> Column:
    return (
        F.flatten(
            F.transform(
                words,
                lambda w, i: F.when(
                    is_feature_word(w),
                    F.flatten(
                        F.array(
                            F.array(w),
                            *(
                                F.when((i + a >= 0) & (i + a + n <= F.size(words)), F.array(F.array_join(F.slice(words, i + a + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
                                for n in (2, 3)
                                for a in range(1 - n, 1)
                            ),
                        )
                    ),
                ).otherwise(F.array().cast("array<string>")),
            )
        )
    )


#: Every so-manieth sentence or phrase is held out when the threshold is calibrated.
FOLDS = 4


def examples(spark: SparkSession) -> DataFrame:
    """``(family, text, fold)``: sentences, names in phrases and counterexamples, each by itself and among fillers; all forms of a
    sentence, and all names in a phrase, are in one fold."""
    said = [(f, t, i) for f, texts in TEXTS.items() for i, t in enumerate(texts, 1)]
    said += [(f, frame.format(n), i) for f, names in NAMES.items() for n in names for i, frame in enumerate(FRAMES)]
    said += [(f, n, 1) for f, names in TEMPLATES.items() for n in names if n in NAMES[f]]
    said += [(UNKNOWN, frame.format(n), i) for f, names in NAMES.items() for n in names[:2] for i, frame in enumerate(DENIALS)]
    said += [(UNKNOWN, t, i) for i, t in enumerate(COUNTEREXAMPLES)]
    around = (("", ""), (FILLERS[1], ""), ("", FILLERS[3]), (FILLERS[4], FILLERS[2]))
    once: dict[tuple[str, str], tuple[str, str, int]] = {}
    for family, t, i in said:
        once.setdefault((family, t.lower()), (family, t, i))
    rows = [(family, f"{a} {t} {b}".strip(), i % FOLDS) for family, t, i in once.values() for a, b in around]
    return spark.createDataFrame(rows, "family string, text string, fold int").coalesce(1)


class Model:
    """Weights by n-gram and family, the families and the threshold below which a paragraph is ``unknown``."""

    def __init__(self, weights: dict[str, list[float]], intercepts: list[float], families: list[str], threshold: float):
        self.weights, self.intercepts, self.families, self.threshold = weights, intercepts, families, threshold

    def score(self, words: Column) -> Column:
        """Softmax over the families for an array of words."""
        vocabulary = F.array(*map(F.lit, self.weights))
        table = F.map_from_arrays(vocabulary, F.array(*(F.array(*map(F.lit, w)) for w in self.weights.values())))
        start = F.array(*map(F.lit, self.intercepts))
        known = F.filter(ngrams_of(words), lambda g: g.isin(*self.weights))  # a set of literals
        logits = F.aggregate(known, start, lambda total, g: F.zip_with(total, F.element_at(table, g), lambda a, b: a + b))
        return F.transform(logits, lambda x: F.exp(x))


def fit(rows: DataFrame) -> Model:
    """Weights of the examples ``(family, grams)``; the threshold is one half."""
    families = [UNKNOWN, *TEMPLATES]
    labelled = rows.withColumn("label", F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1)
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(labelled)
    learner = LogisticRegression(family="multinomial", regParam=0.0003, elasticNetParam=0.5, maxIter=60, standardization=False)
    fitted = learner.fit(counter.transform(labelled))
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    weights = {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(counter.vocabulary) if abs(matrix[:, i]).max() > 1e-9}
    return Model(weights, [float(x) for x in intercepts], families, 0.5)


def held_out(spark: SparkSession) -> tuple[Model, list[tuple[str, str, float]]]:
    """A model that has not seen one fold, and ``(family, likeliest, p)`` of that fold's examples."""
    rows = examples(spark).withColumn("grams", ngrams_of(words_of(F.col("text")))).cache()
    model = fit(rows.where("fold <> 0"))
    got = rows.where("fold = 0").select("family", best(model, words_of(F.col("text"))).alias("b")).select("family", "b.family", "b.p").collect()
    rows.unpersist()
    return model, [tuple(r) for r in got]


def train(spark: SparkSession, false_rate: float = 0.0) -> Model:
    """Fit the classifier on all built-in examples; ``unknown`` is calibrated on those that another fit has not seen.

    The threshold is the highest probability that a share ``1 - false_rate`` of the held-out counterexamples stays below, and
    at least one half.
    """
    _, told = held_out(spark)
    wrong = sorted(p if likely != UNKNOWN else 0.0 for family, likely, p in told if family == UNKNOWN)
    rows = examples(spark).withColumn("grams", ngrams_of(words_of(F.col("text")))).cache()
    model = fit(rows)
    rows.unpersist()
    model.threshold = max(0.5, wrong[math.ceil((1 - false_rate) * len(wrong)) - 1])
    return model


def best(model: Model, words: Column) -> Column:
    """``(family, p)`` of the likeliest class."""
    raw = model.score(words)
    pairs = F.zip_with(raw, F.array(*map(F.lit, model.families)), lambda p, f: F.struct(p.alias("p"), f.alias("family")))
    top = F.array_max(pairs)
    return F.struct(top["family"].alias("family"), (top["p"] / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)).alias("p"))


def containment(words: Column, family: Column) -> Column:
    """The largest share of a template's distinct words, over the family's templates, that the paragraph has."""
    cases = None
    for name, texts in TEMPLATES.items():
        sets = [sorted(_template_words(t)) for t in texts]
        share = F.greatest(*(F.size(F.array_intersect(words, F.array(*map(F.lit, s)))) / float(len(s)) for s in sets))
        cases = F.when(family == name, share) if cases is None else cases.when(family == name, share)
    return cases.otherwise(0.0)


#: How many words before and after a line are read with it: half as many again as the longest template has.
AROUND = 3 * max(len(t.split()) for texts in TEMPLATES.values() for t in texts) // 2


def confirmed(model: Model, words: Column, confirm: float) -> Column:
    """``(p, family, share)`` of the likeliest licence where it is sure enough and a template confirms it, else null."""
    likely = F.transform(F.array(best(model, words)), lambda b: F.when((b["family"] != UNKNOWN) & (b["p"] > model.threshold), b))
    shared = F.transform(likely, lambda b: F.when(b.isNotNull(), F.struct(b["p"].alias("p"), b["family"].alias("family"), containment(words, b["family"]).alias("share"))))
    return F.get(F.filter(shared, lambda x: x["share"] >= confirm), F.lit(0))


def until_blank(lines: Column) -> Column:
    """The lines before the first one without words."""
    end = F.array_position(F.transform(lines, F.size), 0)
    return F.when(end > 0, F.slice(lines, F.lit(1), (end - 1).cast("int"))).otherwise(lines)


def surroundings(lines: Column, i: Column) -> tuple[Column, Column, Column]:
    """Words before and after line ``i``, and how many lines the former are on."""
    # a line that is not blank has a word, so AROUND lines are enough
    first = F.greatest(i - AROUND, F.lit(0))
    before = F.reverse(until_blank(F.reverse(F.slice(lines, first + 1, i - first))))
    words = F.flatten(before)
    after = F.flatten(until_blank(F.slice(lines, i + 2, F.lit(AROUND))))
    return F.slice(words, F.greatest(F.size(words) - AROUND, F.lit(0)) + 1, F.lit(AROUND)), F.slice(after, 1, AROUND), F.size(before)


def scan(docs: DataFrame, model: Model | None = None, confirm: float = CONFIRM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, license, licenses, n_paragraphs, confidence)`` for every row.

    ``license`` is the family of the surest confirmed paragraph, ``licenses`` all confirmed families in order, and
    ``n_paragraphs`` their number of paragraphs; texts with none have null, an empty list and 0.
    """
    model = model or train(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.lower(text)
    lines = F.transform(F.split(low, "\r\n?|\n"), words_of)
    held = F.transform(lines, lambda w: F.struct(w.alias("w"), F.exists(w, is_feature_word).alias("cue")))
    # in one expression, as the next step is given a copy of what this one returns: of a text without features that is nothing
    some = F.transform(F.array(held), lambda h: F.when(F.exists(h, lambda x: x["cue"]), h))
    rows = docs.select(F.col(id_col), F.get(some, F.lit(0)).alias("held"))
    # lines by themselves
    alone = F.transform("held", lambda x: F.struct(x["w"].alias("w"), x["cue"].alias("cue"), F.when(x["cue"], confirmed(model, x["w"], confirm)).alias("own")))
    rows = rows.select(id_col, alone.alias("held"))
    # lines with the ones around them; a line that holds a notice by itself parts the others
    parted = F.transform("held", lambda x: F.when(x["own"].isNull(), x["w"]).otherwise(F.array().cast("array<string>")))
    rows = rows.select(id_col, F.transform("held", lambda x, i: F.struct(i.alias("i"), x.alias("x"))).alias("held"), parted.alias("lines"))
    near = F.transform(F.filter("held", lambda h: h["x"]["cue"]), lambda h: F.struct(h["i"].alias("i"), h["x"]["w"].alias("w"), h["x"]["own"].alias("own"), F.struct(*(c.alias(k) for c, k in zip(surroundings(F.col("lines"), h["i"]), ("before", "after", "above"), strict=True))).alias("s")))
    rows = rows.select(id_col, near.alias("held"))
    joined = lambda h: F.array(F.concat(h["s"]["before"], h["w"], h["s"]["after"]))
    wide = F.transform(
        "held",
        lambda h: F.struct(
            h["i"].alias("i"),
            h["s"]["above"].alias("above"),
            h["own"].alias("own"),
            F.when(F.size(h["s"]["before"]) + F.size(h["s"]["after"]) > 0, F.get(F.transform(joined(h), lambda w: confirmed(model, w, confirm)), F.lit(0))).alias("wide"),
        ),
    )
    rows = rows.select(id_col, wide.alias("held"))
    # the start of a wrapped notice may read as another one's, of which it has less
    other = lambda h: h["wide"].isNotNull() & (h["own"].isNull() | ((h["wide"]["family"] != h["own"]["family"]) & (h["wide"]["share"] > h["own"]["share"])))
    read = F.transform("held", lambda h: F.struct(h["i"].alias("i"), h["above"].alias("above"), other(h).alias("wrapped"), F.when(other(h), h["wide"]).otherwise(h["own"]).alias("hit")))
    rows = rows.select(id_col, F.filter(read, lambda r: r["hit"].isNotNull()).alias("held"))
    # lines of a wrapped notice are one paragraph, as sure as the surest of them
    same = lambda a, b: b["wrapped"] & (a["hit"]["family"] == b["hit"]["family"]) & (a["i"] > b["i"]) & (a["i"] - a["above"] <= b["i"])
    firsts = F.filter("held", lambda a: ~(a["wrapped"] & F.exists("held", lambda b: same(a, b))))
    hit = lambda h: F.struct(h["hit"]["p"].alias("p"), h["hit"]["family"].alias("family"))
    none = F.array().cast("array<struct<p:double,family:string>>")
    rows = rows.select(id_col, F.coalesce(F.transform("held", hit), none).alias("found"), F.coalesce(F.size(firsts), F.lit(0)).alias("paragraphs"))
    top = F.array_max("found")
    return rows.select(
        id_col,
        top["family"].alias("license"),
        F.sort_array(F.array_distinct(F.transform("found", lambda x: x["family"]))).alias("licenses"),
        F.greatest("paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"),
        F.round(top["p"], 6).alias("confidence"),
    )
