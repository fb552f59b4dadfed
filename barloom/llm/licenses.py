"""License scan by diagonal voting.

Templates are short license texts and base phrases. All rolling word k-gram hashes of all texts are joined in Spark to
the positions that hold them in a template (k is four, or the length of a shorter template). A hit votes for its
diagonal, text position minus template position. Votes are summed per text, template and diagonal; diagonals at most
``SHIFT`` words apart are merged into one span (words put in or left out move the diagonal); a span is verified on the
words themselves: their longest common subsequence with the template must hold most of it, so the order counts. A base phrase
is a template of its own length, so each hit is a place.

The table of template positions is a constant of the code (some thousand rows), which bounds the broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import cut_lineage

from .common import ascii_lower, shingle_hashes, texts

GRAM, SHIFT = 4, 3
#: Least share of a template's grams that vote, and of its words that the span holds in order, for a span to count.
VOTED, HELD = 0.5, 0.7

# Base phrases, and public license notices by SPDX-like label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
           "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
           "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                  "the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
           "conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
           "published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software "
           "to the public domain worldwide",
}
# Whole public license texts; a text that holds one holds its notice above as well, and more of its words.
WHOLE = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
}
#: Words: runs of letters, digits and characters beyond ASCII, after lower-casing A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text):
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def _grams(of: DataFrame) -> DataFrame:
    """``_grams``: hashes of all 2-, 3- and 4-grams of ``_w`` in this order, then one entry that every text has."""
    of = of.withColumn("_h1", F.expr("transform(_w, w -> xxhash64(w))"))
    for k in (2, 3, 4):
        of = of.withColumn(f"_h{k}", F.expr(
            f"CASE WHEN size(_w) >= {k} THEN zip_with(slice(_h{k - 1}, 1, size(_w) - {k - 1}), slice(_h1, {k}, size(_w) - {k - 1}), "
            f"(a, b) -> xxhash64({k}, a, b)) ELSE cast(array() AS array<bigint>) END"))
    return of.withColumn("_grams", F.concat("_h2", "_h3", "_h4", F.array(F.lit(0).cast("long")))).drop("_h1", "_h2", "_h3", "_h4")


def templates(spark, notices: dict[str, str], base: dict[str, str], whole: dict[str, str]) -> DataFrame:
    rows = [(i, label, text, is_base) for i, (label, text, is_base) in enumerate(
        [(label, text, False) for of in (notices, whole) for label, text in of.items()] + [(label, text, True) for text, label in base.items()])]
    return (spark.createDataFrame(rows, "_template int, _label string, text string, _base boolean")
            .select("_template", "_label", "_base", _words(F.col("text")).alias("_words"))
            .withColumn("_k", F.least(F.lit(GRAM), F.size("_words"))))


def common_in_order(template: list[str], part: list[str]) -> int:
    """Length of the longest common subsequence, by one number whose zero bits are the matched template words."""
    at: dict[str, int] = {}
    for i, word in enumerate(template):
        at[word] = at.get(word, 0) | 1 << i
    open_ = every = (1 << len(template)) - 1
    for word in part:
        hit = open_ & at.get(word, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & every
    return len(template) - open_.bit_count()


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_words`` and ``_part`` with ``_held``, the words that both have in one order, in their place."""
    for batch in batches:
        held = [common_in_order(a.as_py(), b.as_py()) for a, b in zip(batch.column("_words"), batch.column("_part"))]
        kept = batch.select([x for x in batch.schema.names if x not in ("_words", "_part")])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([len(a) for a in batch.column("_words")], pa.int32()), pa.array(held, pa.int32())],
                                         names=[*kept.schema.names, "_whole", "_held"])


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE, whole: dict[str, str] = WHOLE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans of every row.

    Templates have two words or more. ``score`` is the largest share of a template's grams found in a verified span (1 for
    a base phrase, 0 without any). Null and empty texts have no word and no label. Rows of equal ``doc_id`` and text
    are scanned once and returned as often as they occur; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    known = templates(spark, notices, base, whole)
    of = known.select("_template", "_label", "_base", "_k", F.col("_words").alias("_w"))
    places = (_grams(of).select("_template", "_label", "_base", "_k", F.size("_w").alias("_n"), F.posexplode("_grams").alias("_i", "_gram"))
              .withColumn("_first", F.expr("CASE _k WHEN 2 THEN 0 WHEN 3 THEN _n - 1 ELSE 2 * _n - 3 END"))
              .where("_i >= _first AND _i < _first + _n - _k + 1")
              .select("_gram", "_template", "_label", "_base", F.col("_k").alias("_kind"), (F.col("_i") - F.col("_first")).alias("_at"),
                      (F.col("_n") - F.col("_k") + 1).alias("_of")))
    every = spark.range(1).select(F.lit(0).cast("long").alias("_gram"), F.lit(-1).alias("_template"), F.lit(None).cast("string").alias("_label"),
                                  F.lit(False).alias("_base"), F.lit(0).alias("_kind"), F.lit(0).alias("_at"), F.lit(0).alias("_of"))

    key = ["doc_id", "_hash"]
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("_hash"), _words(F.col("text")).alias("_w"))
    grams = _grams(rows).select(*key, F.size("_w").alias("_n"), F.posexplode_outer("_grams").alias("_i", "_gram"))
    hits = (grams.join(F.broadcast(places.union(every)), "_gram")
            .withColumn("_pos", F.col("_i") - F.expr("CASE _kind WHEN 3 THEN greatest(_n - 1, 0) WHEN 4 THEN greatest(_n - 1, 0) + greatest(_n - 2, 0) ELSE 0 END"))
            # a hash of another length can't vote
            .where("_kind = 0 OR (_pos >= 0 AND _pos <= _n - _kind)"))
    # One row per text and place; copies of a row are counted by the entry that every text has.
    hits = cut_lineage(hits.groupBy(*key, "_n", "_template", "_label", "_base", "_of", "_at", "_pos").agg(F.count("*").alias("_copies")))

    per_diagonal = (hits.where("_template >= 0").withColumn("_diagonal", F.when(F.col("_base"), F.col("_pos")).otherwise(F.col("_pos") - F.col("_at")))
                    .groupBy(*key, "_template", "_label", "_base", "_of", "_diagonal")
                    .agg(F.collect_set("_at").alias("_voted"), F.min("_pos").alias("_from"), F.max("_pos").alias("_to")))
    w = Window.partitionBy(*key, "_template").orderBy("_diagonal")
    spans = (per_diagonal.withColumn("_new", (F.col("_base") | (F.col("_diagonal") - F.lag("_diagonal", 1, -1000).over(w) > SHIFT)).cast("int"))
             .withColumn("_span", F.sum("_new").over(w))
             .groupBy(*key, "_template", "_label", "_base", "_of", "_span")
             .agg(F.array_distinct(F.flatten(F.collect_list("_voted"))).alias("_voted"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
             .withColumn("_share", F.size("_voted") / F.col("_of"))
             .where(F.col("_base") | (F.col("_share") >= VOTED)))

    # Verification reads the words of the texts that hold a notice span, and compares them with the template in order.
    # The spans are written first: only texts that hold one are moved, and where the spans are few nothing else is.
    notice = cut_lineage(spans.where(~F.col("_base")).withColumn("_to", F.col("_to") + GRAM))
    held = texts(docs).withColumn("_hash", F.xxhash64("text"))
    same = lambda other: [held[c].eqNullSafe(other[c]) for c in key]
    held = held.join(notice, same(notice), "left_semi").dropDuplicates(key)
    held = notice.join(held, same(notice)).select(*(notice[c] for c in notice.columns), _words(F.col("text")).alias("_w"))
    held = held.withColumn("_part", F.expr("slice(_w, _from + 1, _to - _from)")).drop("_w")
    held = held.join(F.broadcast(known.select("_template", "_words")), "_template")
    held = held.select(*key, "_label", "_base", "_from", "_share", "_words", "_part")
    kept = [f for f in held.schema.fields if f.name not in ("_words", "_part")]
    held = held.mapInArrow(_in_order, T.StructType([*kept, T.StructField("_whole", T.IntegerType()), T.StructField("_held", T.IntegerType())]))
    verified = held.where(F.col("_held") >= HELD * F.col("_whole")).select(*key, "_label", "_base", "_from", "_share")
    found = spans.where("_base").select(*key, "_label", "_base", "_from", "_share").union(verified)

    rows = hits.where("_template < 0").select(*key, F.col("_n").cast("long").alias("n_words"), "_copies")
    per_text = found.groupBy(*key).agg(
        F.count_if("_base").alias("n_base"), F.min(F.when(F.col("_base"), F.col("_from"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("_base"), F.col("_from"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("_base"), F.col("_label")))).alias("_base_labels"),
        F.array_sort(F.collect_set("_label")).alias("_labels"), F.max("_share").alias("score"),
        F.count_if(~F.col("_base")).alias("n_spans"))
    out = rows.join(per_text, [rows[c].eqNullSafe(per_text[c]) for c in key], "left")
    return (out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
            .select(rows["doc_id"], "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
                    F.coalesce(F.array_join("_base_labels", ","), F.lit("")).alias("base_labels"),
                    F.coalesce(F.array_join("_labels", ","), F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
                    F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans")))
