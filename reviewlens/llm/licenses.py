"""License scans by diagonal voting.

All word k-grams of all texts are joined to the positions of the same k-gram in
the templates (a fixed, small table). A match votes for the diagonal (place in
the text minus place in the template); neighbouring diagonals are merged, as a
word more or less moves the rest by one, and the span of a merged diagonal
counts if enough of the template stands in it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import pick, table

LONG_GRAM, SHORT_GRAM = 4, 2
#: Share of a template's grams that have to be found, the distance of diagonals to merge, and the growth of a span.
LEAST_SCORE, DIAGONAL_GAP, SPAN_GROWTH = 0.6, 4, 1.5

# The phrases and labels of the contract.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Published license texts and notices, without names and years.
TEMPLATES = (
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     "the Software."),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
     "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-text", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
     "in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
     "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
     "specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
     "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
     "more details."),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
     "distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-text", "This work is licensed under a Creative Commons Attribution"),
    ("cc-by-nc-text", "Creative Commons Attribution-NonCommercial"),
    ("cc-by-sa-text", "Creative Commons Attribution-ShareAlike"),
    ("all-rights-reserved", "All rights reserved."),
)

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    base: bool = False

    @property
    def gram(self) -> int:
        return SHORT_GRAM if len(self.words) < LONG_GRAM else LONG_GRAM

    def grams(self) -> list[str]:
        return [" ".join(self.words[i : i + self.gram]) for i in range(len(self.words) - self.gram + 1)]


def template(label: str, text: str, base: bool = False) -> Template:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return Template(label, tuple(w for w in re.split(_BREAKS, lowered) if w), base)


def all_templates() -> tuple[Template, ...]:
    return (
        *(template(label, phrase, True) for phrase, label in BASE_PHRASES.items()),
        *(template(label, text) for label, text in TEMPLATES),
    )


def word_list(text: Column) -> Column:
    """Words of letters, digits and all beyond ASCII, with A-Z lower-cased; a null text has none.

    ``lower`` turns two other characters into ASCII letters (and combining
    marks); texts with these are translated letter by letter.
    """
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(
        text.contains("K") | text.contains("İ"),
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
    ).otherwise(F.lower(text))
    # Only the first and the last of these may be empty; the split begins after any leading break.
    return F.filter(F.split(lowered, _BREAKS), lambda w: w != "")


def license_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] | None = None
) -> DataFrame:
    """Per text: doc_id, copies, n_words, and ``spans``: (label, base, first word, words, score) of what was found.

    Rows with equal key and text are one row with their number as ``copies``. A
    text without words, or null, has no spans. A template of one word is not
    possible. Two places of one template count twice if they lie apart.
    """
    spark = docs.sparkSession
    templates = templates or all_templates()
    gram_rows = [
        (number, place, t.gram, gram, " ".join(gram.split(" ")[:SHORT_GRAM]))
        for number, t in enumerate(templates)
        for place, gram in enumerate(t.grams())
    ]
    # Fixed and small: some hundred grams, whatever is scanned.
    grams = spark.createDataFrame(gram_rows, "template int, place int, gram int, words string, start string")
    starts = F.broadcast(grams.select(F.xxhash64("start").alias("start_hash")).distinct())
    positions = F.broadcast(
        grams.select("template", "place", F.col("gram").alias("width"), "words", F.xxhash64("words").alias("gram_hash"))
    )
    facts = F.broadcast(
        spark.createDataFrame(
            [(n, t.label, t.base, len(t.words), len(t.grams()), t.gram) for n, t in enumerate(templates)],
            "template int, label string, base boolean, length int, grams int, width int",
        )
    )

    rows = pick(docs, doc_id=key, _text=text).select(
        "doc_id", F.xxhash64("_text").alias("text_key"), word_list(F.col("_text")).alias("words")
    )
    rows = rows.select("doc_id", "text_key", F.size("words").alias("n_words"), "words", F.posexplode_outer("words").alias("at", "word"))
    start = F.xxhash64(F.concat_ws(" ", "word", F.get("words", F.col("at") + 1)))
    rows = rows.join(starts, start == F.col("start_hash"), "left")
    marker = F.col("at").isNull() | (F.col("at") == 0)
    rows = rows.where(marker | F.col("start_hash").isNotNull())
    # The first position of a text stays as the text's own row (gram width 0).
    widths = F.array_compact(
        F.array(
            F.when(marker, 0),
            *(F.when(F.col("start_hash").isNotNull() & (F.col("at") + k <= F.col("n_words")), k) for k in (SHORT_GRAM, LONG_GRAM)),
        )
    )
    rows = rows.withColumn("found_width", F.explode(widths))
    found = F.when(F.col("found_width") > 0, F.array_join(F.slice("words", F.col("at") + 1, F.col("found_width")), " "))
    rows = rows.select("doc_id", "text_key", "n_words", "at", "found_width", found.alias("found"))
    same = (F.xxhash64("found") == F.col("gram_hash")) & (F.col("found_width") == F.col("width"))
    votes = rows.join(positions, same & (F.col("found") == F.col("words")), "left")
    votes = votes.where((F.col("found_width") == 0) | F.col("template").isNotNull())
    keys = ["doc_id", "text_key", "n_words"]
    diagonals = votes.groupBy(*keys, "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("at").alias("first"), F.max(F.col("at") + F.col("width")).alias("end")
    )

    # Few rows are left: one per text, and its diagonals. All that follows keeps this partitioning.
    diagonals = diagonals.repartition("doc_id", "text_key", "n_words")
    of_text = Window.partitionBy(*keys)
    copies = F.max(F.when(F.col("template").isNull(), F.col("votes"))).over(of_text)
    diagonals = diagonals.withColumn("copies", copies).join(facts, "template", "left")
    along = Window.partitionBy(*keys, "template").orderBy("diagonal")
    gap = F.when(F.col("base") | (F.col("length") < LONG_GRAM), 0).otherwise(DIAGONAL_GAP)
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > gap, F.lit(True))
    diagonals = diagonals.withColumn("fresh", fresh.cast("int"))
    diagonals = diagonals.withColumn("run", F.sum("fresh").over(along))
    merged = diagonals.groupBy(*keys, "copies", "template", "run").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("end").alias("end"),
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("length").alias("length"),
        F.first("grams").alias("grams"),
    )
    score = F.least(F.lit(1.0), F.col("votes") / F.col("copies") / F.col("grams"))
    whole = F.col("base") & (score == 1.0)
    near = ~F.col("base") & (score >= LEAST_SCORE) & (F.col("end") - F.col("first") <= SPAN_GROWTH * F.col("length") + DIAGONAL_GAP)
    span = F.when(
        F.col("template").isNotNull() & (whole | near),
        F.struct("label", "base", F.col("first"), (F.col("end") - F.col("first")).alias("words"), score.alias("score")),
    )
    return merged.groupBy(*keys, "copies").agg(F.sort_array(F.collect_list(span)).alias("spans")).drop("text_key")


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = license_spans(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first"].cast("bigint"))
    label = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    rows = found.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
