"""License scan by diagonal voting: rolling word grams joined to template positions, counted by offset.

Built-in functions only. The template table is part of the library, so its broadcast has a fixed size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Words after A-Z are lower-cased: runs of digits, a-z and anything that isn't ASCII.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a gram. A gram that begins with a word in SHORT has two.
GRAM = 3

#: Phrases that must stand as they are, and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Licence notices, and their labels.
TEMPLATES = [
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache-2.0",
    ),
    ("Released under the MIT License", "mit"),
    ("Licensed under the MIT License", "mit"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "mit",
    ),
    ("licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("licensed under the GNU General Public License, version 2", "gpl-2.0"),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation",
        "gpl",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
        "bsd",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at",
        "mpl-2.0",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
]


@dataclass(frozen=True)
class LicenseTemplate:
    text: str
    label: str
    #: A phrase counts only whole, and is reported by place.
    phrase: bool = False


def default_templates() -> list[LicenseTemplate]:
    return [LicenseTemplate(t, x, True) for t, x in PHRASES] + [LicenseTemplate(t, x) for t, x in TEMPLATES]


def template_words(text: str) -> list[str]:
    low = text.translate(str.maketrans(UPPER, LOWER))
    return [w for w in re.split(SEPARATOR, low) if w]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATOR, -1), "")


def gram_hash(a: Column, b: Column, c: Column, short: set[str]) -> Column:
    return F.when(a.isin(*sorted(short)), F.xxhash64(a, b)).otherwise(F.xxhash64(a, b, c)) if short else F.xxhash64(a, b, c)


def template_grams(spark: SparkSession, templates: list[LicenseTemplate]) -> tuple[DataFrame, set[str]]:
    """(hash, template, at, label, phrase, of, words, gram) of every gram of every template, and the words with short grams.

    A gram that would reach beyond its template is left out.
    """
    lists = [template_words(t.text) for t in templates]
    if any(len(w) < 2 for w in lists):
        raise ValueError("a template has two words at least")
    short = {w[0] for w in lists if len(w) == 2}
    rows = []
    for k, (t, words) in enumerate(zip(templates, lists, strict=True)):
        at = [i for i, w in enumerate(words) if i + (2 if w in short else GRAM) <= len(words)]
        rows += [(k, i, words[i], words[i + 1], words[i + 2] if i + 2 < len(words) else None, t.label, t.phrase, len(at), len(words)) for i in at]
    schema = "template int, at int, a string, b string, c string, label string, phrase boolean, of int, words int"
    table = spark.createDataFrame(rows, schema)
    gram = F.when(F.col("a").isin(*sorted(short)), F.array("a", "b")).otherwise(F.array("a", "b", "c")) if short else F.array("a", "b", "c")
    return table.select(gram_hash(F.col("a"), F.col("b"), F.col("c"), short).alias("hash"), "template", "at", "label", "phrase", "of", "words", gram.alias("gram")), short


def scan_licenses(docs: DataFrame, templates: list[LicenseTemplate] | None = None, coverage: float = 0.75, drift: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, places, found.

    places: array<struct<start, label>>, where a phrase's words stand consecutively. found: array<struct<label, score,
    start, end>>, spans in words whose grams cover at least ``coverage`` of a template's, on diagonals (position in the
    text less position in the template) that follow one another at ``drift`` words at most; such spans are no longer
    than the template's words plus ``drift`` for each of its grams that is missing. Grams meet by hash and count where
    their words are the same.

    A null or empty text has no words. Rows with equal doc_id and text share one result; each has its row. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    grams, short = template_grams(spark, templates or default_templates())
    # each text ends with this mark, whose position is the number of words, so that texts without a hit stay
    mark = F.xxhash64(F.lit("end of text"), F.lit("callweave"))
    ends = spark.range(1).select(mark.alias("hash"), *[F.lit(v).cast(grams.schema[n].dataType).alias(n) for n, v in (("template", -1), ("at", 0), ("label", None), ("phrase", None), ("of", 1), ("words", 0), ("gram", None))])
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    rows = rows.select("doc_id", F.xxhash64("__text").alias("__h"), words_of(F.col("__text")).alias("__w"))
    rolling = F.transform("__w", lambda w, i: gram_hash(w, F.get(F.col("__w"), i + 1), F.get(F.col("__w"), i + 2), short))
    rolled = rows.select("doc_id", "__h", "__w", F.posexplode(F.concat(rolling, F.array(mark))).alias("__pos", "hash"))
    hits = rolled.join(F.broadcast(grams.unionAll(ends)), "hash")
    # a hash only proposes a place: the words decide
    hits = hits.where(F.col("gram").isNull() | (F.slice("__w", F.col("__pos") + 1, F.size("gram")) == F.col("gram")))
    key = ["doc_id", "__h"]
    # a vote per (text, template, diagonal)
    votes = hits.groupBy(*key, "template", (F.col("__pos") - F.col("at")).alias("__diag")).agg(
        F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("of").alias("of"), F.first("words").alias("words"),
        F.collect_set("at").alias("__ats"), F.min("__pos").alias("__from"), F.max("__pos").alias("__to"), F.count(F.lit(1)).alias("__n"),
    )
    along = Window.partitionBy(*key, "template").orderBy("__diag")
    fresh = (F.col("__diag") - F.lag("__diag").over(along) > drift) | F.col("phrase") | F.lag("__diag").over(along).isNull()
    runs = votes.withColumn("__run", F.sum(F.when(fresh, 1).otherwise(0)).over(along))
    merged = runs.groupBy(*key, "template", "__run").agg(
        F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("of").alias("of"), F.first("words").alias("words"),
        F.array_distinct(F.flatten(F.collect_list("__ats"))).alias("__ats"), F.min("__from").alias("__from"), F.max("__to").alias("__to"),
        F.min("__diag").alias("__diag"), F.max("__n").alias("__n"),
    )
    score = F.size("__ats") / F.col("of")
    width = F.col("__to") - F.col("__from")
    whole = (score >= F.when(F.col("phrase"), F.lit(1.0)).otherwise(F.lit(coverage))) & (width <= F.col("words") + F.lit(drift) * (F.col("of") - F.size("__ats")))
    place = F.when(F.col("phrase") & whole, F.struct(F.col("__diag").alias("start"), "label"))
    span = F.when(~F.col("phrase") & whole, F.struct("label", score.alias("score"), F.col("__from").alias("start"), (F.col("__to") + GRAM).alias("end")))
    end = F.when(F.col("template") < 0, F.struct(F.col("__diag").alias("n"), F.col("__n").alias("times")))
    out = merged.groupBy(*key).agg(
        F.max(end).alias("__end"), F.sort_array(F.collect_list(place)).alias("places"), F.sort_array(F.collect_list(span)).alias("found")
    )
    # rows that were equal are counted by their marks
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__end.times")))
    return out.select("doc_id", F.col("__end.n").alias("n_words"), "places", "found", each.alias("__each")).drop("__each")
