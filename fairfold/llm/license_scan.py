"""Licences of files: TF-IDF cosine of their lines to templates, then the nearest licensed ancestor directory."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairfold.llm.text import plain_text, stored

LEAST_COSINE = 0.75
FILE_SHARE = 0.5  # share of a file's words in licence lines that makes it a licence file of its directory

# fixed values: notices as projects write them
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under Creative Commons Attribution ShareAlike 4.0."),
    ("Proprietary", "Copyright. All rights reserved. Do not distribute."),
)


def _terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def licence_lines(files: DataFrame, templates=TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """``path, line, template, cosine, words`` of lines whose best template reaches ``least``; files are (path, text).

    Term weights are (1 + ln tf) * idf with line frequencies over all files; terms outside the templates
    weigh as if one line held them.  A line can only reach ``least`` if it holds more than ``least`` squared
    of a template's energy, so only lines with one of the templates' weightiest terms are scored: exact.
    Ties between templates go to the first name.
    """
    vocabulary = sorted({t for _, text in templates for t in _terms(text)})
    words = F.filter(F.split(F.lower(F.col("value")), "[^a-z0-9]+"), lambda w: w != "")
    lines = files.select("path", F.posexplode(F.split(plain_text(), "\n")).alias("line", "value")).where("value != ''").select("path", "line", words.alias("words"))
    every = F.array(*[F.lit(t) for t in vocabulary])
    n = lines.count()
    counts = {r[0]: r[1] for r in lines.select(F.explode(F.array_intersect("words", every)).alias("t")).groupBy("t").count().collect()}
    idf = {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}
    unknown = math.log((1 + n) / 2) + 1
    weighted, core = [], set()
    for number, (name, text) in enumerate(templates):
        own = _terms(text)
        w = {t: (1 + math.log(own.count(t))) * idf[t] for t in own}
        norm = math.sqrt(sum(x * x for x in w.values()))
        w = {t: x / norm for t, x in w.items()}
        weighted += [(t, number, name, x) for t, x in sorted(w.items())]
        held = 0.0
        for t in sorted(w, key=lambda t: (w[t], t)):
            held += w[t] * w[t]
            if held >= least * least - 1e-9:
                core.add(t)
    spark = files.sparkSession
    table = spark.createDataFrame(weighted, "term string, number int, template string, weight double")
    weights = spark.createDataFrame([(t, idf[t]) for t in vocabulary], "term string, idf double")
    scored = lines.where(F.arrays_overlap("words", F.array(*[F.lit(t) for t in sorted(core)])))
    tf = scored.select("path", "line", F.size("words").alias("n_words"), F.explode("words").alias("term")).groupBy("path", "line", "n_words", "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    own = tf.join(F.broadcast(weights), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    norm = own.groupBy("path", "line", "n_words").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = own.join(F.broadcast(table), "term").groupBy("path", "line", "number", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosines = dots.join(norm, ["path", "line"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= least)
    best = F.max_by(F.struct("template", "cosine"), F.struct("cosine", (-F.col("number")).alias("first"))).alias("best")
    return cosines.groupBy("path", "line", "n_words").agg(best).select("path", "line", "best.template", "best.cosine", F.col("n_words").cast("long").alias("words"))


def scan(files: DataFrame, templates=TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """One row per path: path, license, cosine, origin (``own``, ``inherited`` or NULL), from_path.

    A file's own licence is the one of its line of greatest cosine (then the first line).  A file in which
    licence lines hold at least FILE_SHARE of the words is a licence file and speaks for its directory; of
    several, the one with the greatest cosine, then the first path.  A file without an own licence inherits
    from the nearest ancestor directory with a licence file, found by joining directories with their
    ancestors; without one it has none.  NULL and empty texts have no own licence; a NULL path has no
    ancestors.  Rows with equal paths are one file.  An empty table gives an empty result; further columns
    are ignored.
    """
    files = files.select("path", plain_text().alias("text"))
    found = stored(licence_lines(files.where("path is not null"), templates, least))
    size = F.size(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != ""))
    order = F.struct("cosine", (-F.col("line")).alias("line"))
    own = found.groupBy("path").agg(F.max_by("template", order).alias("own"), F.max("cosine").alias("cosine"), F.sum("words").alias("licensed"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    whole = files.groupBy("path").agg(F.sum(size).alias("n_words"))
    all_ = stored(whole.join(own, "path", "left").withColumn("folder", folder))
    speaks = all_.where(f"licensed >= {FILE_SHARE} * n_words")
    of_folder = speaks.groupBy("folder").agg(F.min_by(F.struct("own", "path"), F.struct((-F.col("cosine")).alias("c"), F.col("path").alias("p"))).alias("first"))
    of_folder = of_folder.select(F.col("folder").alias("ancestor"), F.col("first.own").alias("license"), F.col("first.path").alias("from_path"))
    parts = F.split("folder", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = all_.where("own is null and path is not null").select("folder").distinct().withColumn("ancestor", F.explode(ancestors))
    near = folders.join(of_folder, "ancestor").groupBy("folder").agg(F.max_by(F.struct("license", "from_path"), F.length("ancestor")).alias("near"))
    return all_.join(near, "folder", "left").select(
        "path", F.coalesce("own", "near.license").alias("license"), F.round("cosine", 6).alias("cosine"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("own").isNull(), F.col("near.from_path")).alias("from_path"),
    )
