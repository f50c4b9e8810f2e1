"""Operator 13: license scans by diagonal voting, in DataFrame functions only.

Words of all texts are joined, by the hash of two words that follow each other, to the places of those two
words in templates. A hit is a vote for a diagonal: place in the text less place in the template. Votes of
templates of ``LONG`` words or more count only where the hash of four words agrees. Votes are summed up
by text, template and diagonal; diagonals at most ``GAP`` words apart, as left-out and put-in words make them,
are merged; and the merged span is verified by its words, which have to equal the template's (not only their
hashes): all words of a short template in place, of a long one a share of ``SHARE`` of the template's words, in a
span of which they are such a share. Where spans of different templates overlap, the better one stays (so a
notice of one license is not taken for a similar one); places of base phrases always stay.

Texts meet the templates where they are read: the templates are code, a few thousand words, and broadcast.
Only hits and one row for each text are shuffled, after being summed up, so a text of many places and many
copies of one row are dealt over tasks.

Defined cases: a null text has no words; an empty one neither; such rows have 0 places, null first and last
word, empty labels and score 0. Repeated rows give repeated rows; rows of one id, or of none, with other
texts are judged each by itself; equal scores of overlapping spans keep both; texts of any length are read
whole; columns other than id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispan.llm.common import require

# What a word is, and the base phrases with their labels.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE_PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# Notices of well-known licenses, as their publishers ask to print them.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0"),
    ("cc0", "CC0 1.0 Universal"),
    ("bsd", "BSD License"),
    ("isc", "ISC License"),
    ("mpl", "Mozilla Public License"),
    ("reserved", "all rights reserved"),
)
#: Templates of so many words may have gaps and changes; shorter ones have to stand whole.
LONG = 20
GAP = 4
SHARE = 0.7
#: Templates may hold so many words in all: they are broadcast.
TEMPLATE_WORDS = 100_000


def words_of(text: str) -> list[str]:
    """The words of a template, as the operator takes them from texts."""
    import re

    return [w for w in re.split(GAPS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def templates(base=BASE_PHRASES, notices=NOTICES) -> list[tuple[int, str, bool, list[str]]]:
    """(template, label, is base, words); each has two words at least."""
    found = [(k, label, k < len(base), words_of(text)) for k, (label, text) in enumerate((*base, *notices))]
    if any(len(w) < 2 for *_, w in found):
        raise ValueError("a template has two words at least")
    if sum(len(w) for *_, w in found) > TEMPLATE_WORDS:
        raise ValueError(f"the templates hold more than {TEMPLATE_WORDS} words")
    return found


def template_grams(spark: SparkSession, found: list[tuple[int, str, bool, list[str]]]) -> DataFrame:
    """(template, label, base, m, k, place, t0..t3, pair, four): each place of a template where a k-gram starts.

    The row of template -1 meets the empty word before a text's first, so that every text has a hit.
    """
    rows = [(-1, "", False, 1, 1, 0, "", None, None, None)]
    for template, label, base, w in found:
        k = 4 if len(w) >= LONG else 2
        rows += [(template, label, base, len(w), k, p, *w[p : p + k], *[None] * (4 - k)) for p in range(len(w) - k + 1)]
    grams = spark.createDataFrame(rows, "template int, label string, base boolean, m int, k int, place int, t0 string, t1 string, t2 string, t3 string")
    return grams.select("*", _pair("t0", "t1").alias("pair"), F.when(F.col("k") == 4, F.xxhash64("t0", "t1", "t2", "t3")).alias("four"))


def _pair(a: str, b: str):
    return F.when(F.col(a) == "", F.lit(0)).otherwise(F.xxhash64(a, b))


def scan_licenses(df: DataFrame, base=BASE_PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each row.

    ``spans`` lists what was verified: array<struct<first_word, last_word, label, base, score>>, by place.
    """
    grams = template_grams(df.sparkSession, templates(base, notices))
    text = require(df, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    split = text.select("id", F.xxhash64("text", F.length("text")).alias("mark"), F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), GAPS, -1), "").alias("w"))
    split = split.select("id", "mark", F.size("w").alias("n_words"), F.concat(F.array(F.lit("")), F.col("w")).alias("w"))
    shifted = [F.slice("w", k + 1, F.size("w")).alias(f"w{k}") for k in range(4)]
    zipped = split.select("id", "mark", "n_words", F.arrays_zip(*[s for s in shifted]).alias("z"))
    rolled = zipped.select("id", "mark", "n_words", F.posexplode_outer("z").alias("at", "g"))
    rolled = rolled.select("id", "mark", "n_words", (F.col("at") - 1).alias("at"), *[F.col(f"g.w{k}").alias(f"w{k}") for k in range(4)])
    rolled = rolled.withColumn("pair", _pair("w0", "w1"))
    met = rolled.join(F.broadcast(grams.withColumnRenamed("pair", "pair_t")), (F.col("pair") == F.col("pair_t")) & (F.col("four").isNull() | (F.col("four") == F.xxhash64("w0", "w1", "w2", "w3"))))

    # votes for diagonals; a place counts where the words themselves are equal
    doc, template = ["id", "mark", "n_words"], ["template", "label", "base", "m", "k"]
    same = (F.col("w0") == F.col("t0")) & ((F.col("k") < 2) | (F.col("w1") == F.col("t1"))) & ((F.col("k") < 4) | ((F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3"))))
    votes = met.groupBy(*doc, *template, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set(F.when(same, F.col("place"))).alias("places"), F.count(F.lit(1)).alias("n"))
    voted = votes.where(F.size("places") > 0).withColumn("covered", F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1)))))

    # neighbouring diagonals become one span
    along = Window.partitionBy(*doc, *template).orderBy("diagonal")
    gap = F.when(F.col("m") >= LONG, GAP).otherwise(0)
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > gap).cast("int"), F.lit(0))
    numbered = voted.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(along))
    merged = numbered.groupBy(*doc, *template, "cluster").agg(
        F.sum("n").alias("n"),
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("of_template"),
        F.array_distinct(F.flatten(F.collect_list(F.transform("covered", lambda x: x + F.col("diagonal"))))).alias("at"),
    )
    sized = merged.select(*doc, *template, "n", "of_template", F.size("at").alias("of_text"), F.array_min("at").alias("first"), F.array_max("at").alias("last"))
    cover, alike = F.col("of_template") / F.col("m"), F.col("of_text") / (F.col("last") - F.col("first") + 1)
    whole = (F.col("of_template") == F.col("m")) & (F.col("of_text") == F.col("m"))
    spans = sized.withColumn("score", cover * alike).where(F.when(F.col("m") >= LONG, (cover >= SHARE) & (alike >= SHARE)).otherwise(whole))

    # of spans that overlap the better stays
    by = Window.partitionBy(*doc).orderBy("first", "last", "template")
    reach = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("apart", F.coalesce((F.col("first") > reach).cast("int"), F.lit(0))).withColumn("island", F.sum("apart").over(by))
    span = F.struct("first", "last", "template", "label", "base", "score", "n")
    held = islands.groupBy(*doc, "island").agg(F.collect_list(span).alias("s"))
    beaten = lambda a: F.exists("s", lambda b: (b["score"] > a["score"]) & (b["first"] <= a["last"]) & (a["first"] <= b["last"]) & (b["label"] != a["label"]))
    best = held.select(*doc, F.explode_outer(F.filter("s", lambda a: a["base"] | ~beaten(a))).alias("s")).select(*doc, "s.*")

    real = F.col("template") >= 0
    label_list = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    one = F.struct(F.col("first").cast("long").alias("first_word"), F.col("last").cast("long").alias("last_word"), "label", "base", "score")
    each = best.groupBy(*doc).agg(
        F.max(F.when(~real, F.col("n"))).alias("copies"),
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        label_list(F.col("base")).alias("base_labels"),
        label_list(real).alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("score"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(real, one))).alias("spans"),
    )
    out = each.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
