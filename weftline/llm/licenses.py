"""Licence scans by sentence rules.

A text is normalised (lower case, letters and digits with single separators), where a
separator is a sentence's end (also a blank line), a line's end or a space. A known
sentence stands between ends of sentences or lines, may be wrapped over lines, and each
line may begin with a comment leader. Known sentences become identifiers. The sequence of a
text's identifiers is matched against ordered rules, longest first; a rule takes the
identifiers that it matches, so that they don't count again for a shorter one. All of
it is one projection of the scan: nothing is shuffled and no function leaves the JVM.

Defined cases: a null or empty text has no sentence and no licence; repeated rows are
scanned alike; a licence found twice is named once; an empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_or_empty

# Sentences of public licences and of the notices that name them.
SENTENCES = {
    "mit-ref": "Released under the MIT License.",
    "mit-ref-2": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-title-2": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software",
    "gpl3-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-more": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-ref": "Licensed under CC BY 4.0.",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0.",
    "cc0-ref": "Licensed under CC0 1.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

# Ordered rules, licence and the identifiers in the order in which they stand.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("Apache-2.0", ["apache-notice", "apache-compliance", "apache-copy", "apache-asis", "apache-see"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-grant", "gpl-hope", "gpl-implied", "gpl-more"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-grant", "gpl-hope", "gpl-implied", "gpl-more"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-grant"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-grant"]),
    ("Apache-2.0", ["apache-notice", "apache-compliance"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("MIT", ["mit-title-2", "mit-grant"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-ref-2"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-title-2"]),
    ("Apache-2.0", ["apache-ref"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
]

#: What comments put before a line.
LEADER = r"(?dm)^[^a-z0-9\n]+(?:(?:dnl|rem)[\x20\x09]+[^a-z0-9\n]*)?|^(?:dnl|rem)[\x20\x09]+[^a-z0-9\n]*"

#: Every known sentence has one of these, in any case and wrapped anywhere; other texts aren't normalised.
HINTS = ["licen", "permission", r"free[^a-z0-9]+(?:(?:dnl|rem)[^a-z0-9]+)?software", "redistribut", "warrant", "liable"]


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


KNOWN = {normalised(s): k for k, s in SENTENCES.items()}
assert all(re.search("|".join(HINTS), s.lower()) for s in SENTENCES.values())


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences in a text, in their order."""
    low = F.lower(text)
    bare = F.regexp_replace(F.concat(F.lit("\n"), low, F.lit("\n")), LEADER, "")
    ends = F.regexp_replace(bare, r"[.!?;:][\x20\x09\n]+", "\n\n")
    # a blank line stands for a sentence's end from here on, then a bar
    marked = F.regexp_replace(ends, r"[^a-z0-9\n]+", " ")
    line = F.regexp_replace(marked, r"\x20*\n\x20*", "\n")
    stream = F.concat(F.lit("|"), F.regexp_replace(line, r"\n\n+", "|"), F.lit("|"))
    # the longest first, as one may begin another
    known = "|".join(s.replace(" ", "[\\x20\n]") for s in sorted(KNOWN, key=lambda s: (-len(s), s)))
    found = F.regexp_extract_all(stream, F.lit(f"(?<=[|\n])({known})(?=[|\n])"), F.lit(1))
    ids = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    return F.when(low.rlike("|".join(HINTS)), F.transform(found, lambda s: F.element_at(ids, F.translate(s, "\n", " ")))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(doc_id, sentence_ids, licenses), one row per row of `docs`; licences are sorted and distinct."""
    rules = RULES if rules is None else rules
    df = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(text_or_empty(text_col)).alias("sentence_ids"))
    # identifiers stand between bars of their own, so that one taken leaves its neighbours apart
    df = df.withColumn("__s", F.array_join(F.transform("sentence_ids", lambda s: F.concat(F.lit("|"), s, F.lit("|"))), ""))
    left, found = F.col("__s"), []
    for name, ids in sorted(rules, key=lambda r: -len(r[1])):
        run = "".join(f"|{i}|" for i in ids)
        found.append(F.when(F.contains(left, F.lit(run)), F.lit(name)))
        left = F.replace(left, F.lit(run), F.lit("#"))
    licenses = F.when(F.col("__s") == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))))
    return df.withColumn("licenses", licenses).select("doc_id", "sentence_ids", "licenses")


def op5(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    runs = ["".join(f"|{i}|" for i in ids) for _, ids in ordered]
    steps, prev = [], "s0"
    for k, run in enumerate(runs):
        steps.append(f"r{k} AS (SELECT doc_id, n, ids, replace(s, {quoted(run)}, '#') AS s, CASE WHEN contains(s, {quoted(run)}) THEN list_append(f, {quoted(ordered[k][0])}) ELSE f END AS f FROM {prev})")
        prev = f"r{k}"
    known = ", ".join(f"{quoted(s)}: {quoted(i)}" for s, i in KNOWN.items())
    return f"""
WITH m AS (SELECT MAP {{{known}}} AS known),
u AS (SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t]+', '\\1\n', 'g'), chr(10)), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS u FROM documents),
i AS (SELECT doc_id, list_transform(list_filter(u, lambda x: x IN ({", ".join(map(quoted, KNOWN))})), lambda x: known[x]) AS ids FROM u, m),
s0 AS (SELECT doc_id, len(ids) AS n, array_to_string(ids, ',') AS ids, array_to_string(list_transform(ids, lambda x: '|' || x || '|'), '') AS s, []::VARCHAR[] AS f FROM i),
{", ".join(steps)}
SELECT doc_id, n AS n_known, ids AS sentence_ids, array_to_string(list_sort(list_distinct(f)), ',') AS licenses FROM {prev}
"""


OP5_SQL = _sql()
