"""License scans by a positional index of rare words. DataFrame and SQL functions only.

Each template (a licence notice) has postings of its rarest words: where in it
they stand. Of a file, the rarest words that it shares with a template are
looked up; a posting and a place of the word in the file give a relative
position, and where enough weight of a template's words agrees on one, the
template may stand. It does if its mandatory phrases stand there too. How rare a
word is comes from all files.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import materialize, numbered, pick

#: Words of a template in the index; of these, the most of a file that are looked up; words by which relative positions may differ; the least share of weight that agrees, in hundredths.
INDEXED, LOOKED_UP, SLACK, LEAST_PERCENT = 16, 8, 8, 60
#: Words: no ASCII but letters (lower-cased before) and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that name a licence wherever their words stand consecutively (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    """A notice that gives ``label``; each of ``phrases``, words of ``text``, must be there."""

    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(BETWEEN, self.text.lower()) if w]


#: Notices as licences ask for them (fixed values).
TEMPLATES = (
    Template("mit", "Released under the MIT License.", ("the mit license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("permission is hereby granted free of charge", "the above copyright notice and this permission notice shall be included"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"),
    ),
    Template(
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce"),
    ),
    Template(
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
        ("endorse or promote products derived from this software", "without specific prior written permission"),
    ),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        ("you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing"),
    ),
    Template(
        "gpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("under the terms of the gnu general public license", "version 3 of the license or at your option any later version"),
    ),
    Template(
        "gpl-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ("under the terms of the gnu general public license", "version 2 of the license or at your option any later version"),
    ),
    Template(
        "lgpl-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ("under the terms of the gnu lesser general public license", "version 2 1 of the license or at your option any later version"),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("subject to the terms of the mozilla public license v 2 0",),
    ),
    Template(
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
        ("creative commons attribution 4 0 international license",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software released into the public domain",),
    ),
)


def normal(text: Column) -> Column:
    """The words of a text (A-Z lower-cased), each with a space before it and one after the last; null is the empty text."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), BETWEEN, " ")
    return F.when(spaced == " ", "").otherwise(spaced)


def count_words(spaced: Column) -> Column:
    """How many words stand in (a piece of) a normal text that begins with a space, whether or not one ends it."""
    whole = F.rtrim(spaced)
    return (F.length(whole) - F.length(F.replace(whole, F.lit(" "), F.lit("")))).cast("long")


def base_facts(words: Column, total: Column, base: dict[str, str]) -> Column:
    """Struct n_base, first_word, last_word, base_labels of a normal text: it is parted ahead of every place of a phrase."""
    pieces = F.split(words, f" (?=(?:{'|'.join(base)}) )")
    found = F.filter(F.array(*[F.when(F.contains(words, F.lit(f" {p} ")), label) for p, label in base.items()]), lambda x: x.isNotNull())
    n = (F.size(pieces) - 1).cast("long")
    ahead = F.element_at(pieces, 1)
    return F.when(
        F.size(found) > 0,
        F.struct(n.alias("n_base"), count_words(ahead).alias("first_word"), (total - count_words(F.concat(F.lit(" "), F.element_at(pieces, -1)))).alias("last_word"), F.array_sort(F.array_distinct(found)).alias("base_labels")),
    ).otherwise(F.struct(F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.array().cast("array<string>").alias("base_labels")))


@dataclass(frozen=True)
class Index:
    """``words[t]``: the rarest words of template t, the rarest first, with weights; ``full[t]``: the weight of the first ``LOOKED_UP``."""

    templates: tuple[Template, ...]
    words: tuple[tuple[tuple[str, int], ...], ...]

    @property
    def full(self) -> list[int]:
        return [sum(w for _, w in of[:LOOKED_UP]) for of in self.words]


def index_of(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> Index:
    """The index of ``templates`` by how many of ``docs`` (text) hold each of their words: one row a template word reaches the driver.

    A word's weight is the bit length of (number of texts) div (texts that hold it).
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    texts = pick(docs, "text").select(normal(F.col("text")).alias("words"))
    own = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split("words", " "))
    seen = texts.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word")).groupBy("word").count()  # the empty word counts texts
    counts = {r["word"]: r["count"] for r in seen.collect()}
    total = counts.get("", 0)
    weight = lambda w: (total // max(1, counts.get(w, 0))).bit_length()
    ranked = [sorted(set(t.words), key=lambda w: (counts.get(w, 0), w.encode()))[:INDEXED] for t in templates]
    return Index(tuple(templates), tuple(tuple((w, weight(w)) for w in of) for of in ranked))


def sum_of(words: Column, weights: dict[str, int]) -> Column:
    """The summed weight of an array of words."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.coalesce(F.try_element_at(table, w), F.lit(0)))


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs`` (doc_id, text).

    n_base counts the places of base phrases, first_word and last_word are the
    least and greatest start (null if none). ``labels`` joins base labels and
    those of templates that stand in the text. ``score`` is the greatest share
    of a template's weight found at one relative position, and 1 where a base
    phrase stands; 0 if nothing agrees.

    Null and empty texts have no words and no label; very long texts are read
    whole, in time linear in their length; repeated rows come back as often; a
    text may hold many notices; an empty table gives no row; other columns are not read.
    """
    index = index_of(docs, templates)
    longest = max(len(p) for t in templates for p in t.phrases)
    heads = sorted({p.split(" ")[0] for t in templates for p in t.phrases})
    phrase_words = max(len(p.split(" ")) for t in templates for p in t.phrases)
    vocabulary = sorted({w for of in index.words for w, _ in of})

    rows = numbered_rows(docs).select("row", "doc_id", normal(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", count_words(F.col("words"))).withColumn("held", F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split("words", " ")))
    rows = rows.withColumn("base", base_facts(F.col("words"), F.col("n_words"), base))
    looked = []
    for k, of in enumerate(index.words):
        shared = F.slice(F.array_intersect(F.array(*[F.lit(w) for w, _ in of]), F.col("held")), 1, LOOKED_UP)
        enough = 100 * sum_of(shared, dict(of)) >= LEAST_PERCENT * index.full[k]
        looked.append(F.when(enough, F.struct(F.lit(k).alias("template"), shared.alias("words"))))
    may = F.filter(F.array(*looked), lambda x: x.isNotNull())
    rows = rows.withColumn("may", F.when(F.size("held") > 0, may).otherwise(F.filter(F.array(looked[0]), lambda x: F.lit(False))))
    rows = rows.withColumn("sought", F.array_distinct(F.flatten(F.transform("may", lambda x: x["words"]))))

    def places(words: Column, sought: Column) -> Column:
        """Structs place, word, phrase of the words sought and, where a phrase may begin, what follows; the array is made once, as a lambda's variable."""

        def one(w: Column, i: Column, ws: Column) -> Column:
            follows = F.when(w.isin(heads), F.array_join(F.slice(ws, i + 1, phrase_words), " "))
            return F.when(F.array_contains(sought, w) | w.isin(heads), F.struct((i - 1).alias("place"), w.alias("word"), F.left(follows, F.lit(longest + 1)).alias("phrase")))

        return F.element_at(F.transform(F.array(F.split(words, " ")), lambda ws: F.filter(F.transform(ws, lambda w, i: one(w, i, ws)), lambda x: x.isNotNull())), 1)

    none = F.filter(F.array(F.struct(F.lit(0).alias("place"), F.lit("").alias("word"), F.lit("").alias("phrase"))), lambda x: F.lit(False))
    rows = rows.withColumn("at", F.when(F.size("may") > 0, places(F.col("words"), F.col("sought"))).otherwise(none))
    stored = materialize(rows.select("row", "doc_id", "n_words", "base.*", "may", "at"), "licence-words")

    # Votes: a place of a word in the file less its place in the template, in two grids of bins, so that positions that differ by SLACK share one.
    spark = docs.sparkSession
    postings = [(k, w, weight, at) for k, (t, of) in enumerate(zip(templates, index.words, strict=True)) for w, weight in of for at, x in enumerate(t.words) if x == w]
    posting = F.broadcast(spark.createDataFrame(postings, "template int, word string, weight int, at int"))  # as many as the templates' words
    sought = stored.filter(F.size("may") > 0).select("row", "at", F.explode("may").alias("m")).select("row", F.col("m.template").alias("template"), F.col("m.words").alias("mine"), F.explode("at").alias("p")).filter(F.array_contains("mine", F.col("p.word")))
    votes = sought.select("row", "template", F.col("p.word").alias("word"), F.col("p.place").alias("place")).join(posting, ["template", "word"]).select("row", "template", "word", "weight", (F.col("place") - F.col("at")).alias("offset"))
    grids = F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((F.col("offset") + g * SLACK) / (2 * SLACK)).alias("bin")) for g in (0, 1)])
    binned = votes.withColumn("b", F.explode(grids)).groupBy("row", "template", "b.grid", "b.bin", "word").agg(F.max("weight").alias("weight"), F.min("offset").alias("low"), F.max("offset").alias("high"))
    found = binned.groupBy("row", "template", "grid", "bin").agg(F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))
    facts = F.broadcast(spark.createDataFrame([(k, t.label, f) for k, (t, f) in enumerate(zip(templates, index.full, strict=True))], "template int, label string, full int"))
    agreed = found.join(facts, "template").withColumn("share", F.col("weight") / F.col("full"))

    # A mandatory phrase stands near where the relative position puts it.
    wanted = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(n).alias("phrase"), F.lit(p + " ").alias("text"), F.lit(place_in(t.words, p)).alias("at")) for k, t in enumerate(templates) for n, p in enumerate(t.phrases)])
    starts = stored.filter(F.size("may") > 0).select("row", F.explode("at").alias("p")).filter("p.phrase is not null").select("row", F.col("p.place").alias("place"), F.concat("p.phrase", F.lit(" ")).alias("follows"))
    begun = starts.select("row", "place", F.explode(F.filter(wanted, lambda x: F.startswith(F.col("follows"), x["text"]))).alias("w"))
    phrases = begun.select("row", "w.template", "w.phrase", (F.col("place") - F.col("w.at")).alias("offset"))
    near = phrases.withColumn("b", F.explode(grids)).groupBy("row", "template", "b.grid", "b.bin").agg(F.expr("bit_or(shiftleft(1L, phrase))").alias("seen"))
    need = F.create_map(*[F.lit(x) for k, t in enumerate(templates) for x in (k, (1 << len(t.phrases)) - 1)])
    verified = agreed.join(near, ["row", "template", "grid", "bin"], "left").withColumn("stands", (100 * F.col("weight") >= LEAST_PERCENT * F.col("full")) & (F.coalesce("seen", F.lit(0)) == F.element_at(need, F.col("template"))))
    told = verified.groupBy("row").agg(F.collect_set(F.when(F.col("stands"), F.col("label"))).alias("more"), F.max("share").alias("share"))  # as many labels as there are
    every = stored.drop("may", "at").join(told, "row", "left")
    joined = lambda c: F.array_join(c, ",")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return every.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"), joined(labels).alias("labels"), score.alias("score"))


def place_in(words: list[str], phrase: str) -> int:
    want = phrase.split(" ")
    return next(k for k in range(len(words)) if words[k : k + len(want)] == want)


def numbered_rows(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``row``, a number of its own for each row; written before it is used twice."""
    return pick(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
