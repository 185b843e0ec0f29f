"""Licence scans by sentence rules, in DataFrame functions only (operator 7).

Texts are cut into parts at ends of sentences and lines. A known licence sentence is found where its words are
those of a run of parts, so it may be wrapped over lines or hold colons; a document's known sentences in order
are matched against licences, each an ordered list of sentence ids.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (sentence id, sentence). Case and punctuation don't count, words and numbers do: a version that is not
#: here is no known sentence.
SENTENCES = [
    ("by-nc", "Licensed under CC BY-NC 4.0."),
    ("by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("by", "Licensed under CC BY 4.0."),
    ("by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("by-sa", "Licensed under CC BY-SA 4.0."),
    ("by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "This work is dedicated to the public domain."),
    ("gpl2-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl2-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-warranty", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-notice-kept", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("as-is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("bsd-use", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("rights", "All rights reserved."),
]
#: Fixed values: (licence, its sentence ids in order). A document has a licence if its known sentences hold them in this order.
RULES = [
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-copy", "apache-warranty"]),
    ("BSD-2-Clause", ["bsd-use", "bsd-source", "bsd-binary"]),
    ("CC-BY-4.0", ["by"]),
    ("CC-BY-NC-4.0", ["by-nc"]),
    ("CC-BY-SA-4.0", ["by-sa"]),
    ("CC0-1.0", ["cc0"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("GPL-3.0", ["gpl-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "mit-notice-kept", "as-is"]),
    ("Proprietary", ["rights"]),
]
#: A part ends at a newline, or at a full stop, colon, question or exclamation mark before white space.
GAP = r"\n|[.:?!][ \t\r]+"


def _norm(said: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", said.lower()))


def scan(docs: DataFrame, sentences: list = SENTENCES, rules: list = RULES) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences) of every row; other columns are ignored.

    n_sentences counts known sentences, sentence_ids has them in order of their first words, licences the matched
    ones, sorted and distinct, joined by commas. Of sentences that start at one part the longest counts ("BY-" before a
    line of "NC" is not BY). Lines without letters and digits don't end a sentence. A null, empty or unlicensed text
    has 0 and empty values; repeated rows stay, an empty table gives none. Words and rules are literals: each row is judged
    by itself, in one pass without a shuffle.
    """
    ids_of: dict[str, list[str]] = {}
    for i, said in sorted(set(sentences)):
        if norm := _norm(said):
            ids_of.setdefault(norm, []).append(i)
    longest_first = sorted(ids_of, key=lambda n: (-len(n), n))
    place = r"\n(?=(" + ("|".join(n.replace(" ", "[ \\n]") for n in longest_first) or "(?!)") + r")\n)"
    # parts as lines of words in lower case, with a newline before the first and after the last
    lines = F.regexp_replace(F.regexp_replace(F.lower("text"), GAP, "\n"), r"[^a-z0-9\n]+", " ")
    flat = F.regexp_replace(F.concat(F.lit("\n"), lines, F.lit("\n")), r" *\n[ \n]*", "\n")
    known = F.create_map(*[F.lit(x) for norm, ids in ids_of.items() for x in (norm, "|".join(ids))]) if ids_of else F.create_map(F.lit(""), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = own.select("doc_id", F.regexp_extract_all(flat, F.lit(place), F.lit(1)).alias("parts"))
    listed = parts.select("doc_id", F.array_join(F.transform("parts", lambda x: F.element_at(known, F.translate(x, "\n", " "))), "|").alias("ids"))
    # ids in order with others between: a pattern of the literal ids; most documents have none and are not tried
    text = F.concat(F.lit("|"), F.col("ids"), F.lit("|"))
    hits = F.array(*[F.when(text.rlike("(?s)" + "(?:.*?)".join(rf"\|\Q{i}\E(?=\|)" for i in order)), F.lit(name)) for name, order in rules])
    licences = F.array_join(F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))), ",")
    some = F.col("ids") != ""
    return listed.select(
        "doc_id",
        F.when(some, F.length("ids") - F.length(F.translate("ids", "|", "")) + 1).otherwise(0).cast("long").alias("n_sentences"),
        F.translate("ids", "|", ",").alias("sentence_ids"),
        F.when(some, licences).otherwise(F.lit("")).alias("licences"),
    )


def duckdb(sentences: list = SENTENCES, rules: list = RULES) -> str:
    """scan() of documents in DuckDB SQL: each part's start is held against each known sentence, letter by letter."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(i)}, {quote(_norm(s))})" for i, s in sentences)
    wanted = ", ".join(f"({k}, {quote(name)}, {len(order)}, {place}, {quote(i)})" for k, (name, order) in enumerate(rules) for place, i in enumerate(order))
    return f"""
WITH RECURSIVE known AS (SELECT DISTINCT sentence_id, norm FROM (VALUES {values}) t(sentence_id, norm)),
steps(rule, licence, size, place, sentence_id) AS (VALUES {wanted}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), {quote(GAP)}, chr(10), 'g') AS said FROM documents),
f AS (SELECT r, doc_id, regexp_replace(chr(10) || regexp_replace(said, '[^a-z0-9\n]+', ' ', 'g') || chr(10), ' *\n[ \n]*', chr(10), 'g') AS flat FROM d),
p AS (SELECT r, flat, string_split(flat, chr(10)) AS parts FROM f WHERE regexp_matches(flat, 'licen|public domain|redistribut|warrant|permission|rights')),
s AS (SELECT r, flat, unnest(range(1, len(parts) + 1)) AS k, unnest(list_transform(range(1, len(parts) + 1), lambda i: i + list_sum(list_transform(list_slice(parts, 1, i - 1), lambda x: len(x))))) AS spot FROM p),
hit AS (SELECT r, k, norm, sentence_id FROM s JOIN known ON replace(substr(flat, CAST(coalesce(spot, 1) AS BIGINT), len(norm)), chr(10), ' ') = norm AND substr(flat, CAST(coalesce(spot, 1) AS BIGINT) + len(norm), 1) = chr(10)),
best AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY k, sentence_id) AS n, sentence_id FROM (SELECT *, max(len(norm)) OVER (PARTITION BY r, k) AS most FROM hit) WHERE len(norm) = most),
walk AS (SELECT best.r, rule, licence, size, place, min(n) AS n FROM best JOIN steps USING (sentence_id) WHERE place = 0 GROUP BY ALL
  UNION ALL SELECT walk.r, walk.rule, walk.licence, walk.size, walk.place + 1, (SELECT min(b.n) FROM best b JOIN steps t USING (sentence_id) WHERE b.r = walk.r AND t.rule = walk.rule AND t.place = walk.place + 1 AND b.n > walk.n) FROM walk WHERE walk.place + 1 < walk.size AND walk.n IS NOT NULL),
l AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM walk WHERE place + 1 = size AND n IS NOT NULL GROUP BY r),
i AS (SELECT r, count(*) AS n, string_agg(sentence_id, ',' ORDER BY n) AS ids FROM best GROUP BY r)
SELECT doc_id, CAST(coalesce(i.n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences
FROM f LEFT JOIN i USING (r) LEFT JOIN l USING (r)"""
