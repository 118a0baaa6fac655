"""License scans: sentences that licences are known by, and ordered rules over the sequence of their identifiers.

Text is split after sentence ends before white space. Lines of other matter may stand before, between and after: any run of
whole lines within a sentence may be known, and a list marker at the start of a line or sentence is not part of it. Sentences
are lower-cased, everything but a-z and 0-9 becomes one space, and looked up. The SQL knows no list markers, and runs of lines
only at the end of a sentence. The identifiers of a document, in order, are matched by the rules in turn; what a rule matches is taken out before the next, so that a longer licence hides the shorter ones in it.
Documents without any of the words that every known sentence has one of are answered without splitting.
All of it is built-in functions. Null and empty texts: no licence. Rows are answered one by one, other columns ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import table

#: Sentences of public licence texts and notices.
SENTENCES = {
    "apache_notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache_asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache_see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache_short": "Licensed under the Apache License, Version 2.0.",
    "apache_spdx": "SPDX-License-Identifier: Apache-2.0",
    "mit_title": "The MIT License (MIT)",
    "mit_short": "Released under the MIT License.",
    "mit_short2": "Licensed under the MIT License.",
    "mit_spdx": "SPDX-License-Identifier: MIT",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit_liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc_asis": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_asis": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd2_spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd3_spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "gpl2_later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl3_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_see": "See the GNU General Public License for more details.",
    "gpl3_short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2_short": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3_spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "lgpl_short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mpl_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ccby": "Licensed under CC BY 4.0.",
    "ccbysa": "Licensed under CC BY-SA 4.0.",
    "ccbync": "Licensed under CC BY-NC 4.0.",
    "ccby_long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa_long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0": "This work is marked with CC0 1.0 Universal license.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Every sentence has one of these in its lower-cased text (a test sees to it), so that other documents need no splitting.
MARKS = ("licen", "copyright", "warrant", "software", "redistribut", "mpl", "cc by")
#: (licence, identifiers in order; others may stand between those joined by >; alternatives by |), tried in turn.
RULES = (
    ("Apache-2.0", "apache_notice>apache_copy|apache_asis>apache_see"), ("Apache-2.0", "apache_notice"), ("Apache-2.0", "apache_short|apache_spdx"),
    ("MIT", "mit_grant>mit_keep>mit_asis>mit_liable"), ("MIT", "mit_grant>mit_asis"), ("MIT", "mit_title|mit_short|mit_short2|mit_spdx"),
    ("ISC", "isc_grant>isc_asis"), ("BSD-3-Clause", "bsd_grant>bsd_source>bsd_binary>bsd_names>bsd_asis"), ("BSD-2-Clause", "bsd_grant>bsd_source>bsd_binary>bsd_asis"),
    ("BSD-3-Clause", "bsd3_spdx"), ("BSD-2-Clause", "bsd2_spdx"), ("GPL-3.0-or-later", "gpl3_later>gpl_hope>gpl_see"), ("GPL-2.0-or-later", "gpl2_later>gpl_hope>gpl_see"),
    ("GPL-3.0-or-later", "gpl3_later"), ("GPL-2.0-or-later", "gpl2_later"), ("GPL-3.0-only", "gpl3_short|gpl3_spdx"), ("GPL-2.0-only", "gpl2_short"), ("LGPL-3.0-only", "lgpl_short"),
    ("MPL-2.0", "mpl_notice>mpl_copy"), ("MPL-2.0", "mpl_notice"), ("CC-BY-NC-4.0", "ccbync"), ("CC-BY-SA-4.0", "ccbysa|ccbysa_long"), ("CC-BY-4.0", "ccby|ccby_long"), ("CC0-1.0", "cc0"), ("Unlicense", "unlicense"),
)
#: Where sentences end: at a mark after two characters and before white space, and at a colon that ends a line.
ENDS = r"""([^ \t\r\n][^ \t\r\n][.!?]["')]?)[ \t\r\n]+|(:)[ \t\r]*\n[ \t\r\n]*"""

#: List markers: 1., 2), (a), at the start of a line or sentence, after any other signs.
ITEM = r"(^|[\n\x01])[^A-Za-z0-9\n\x01]*(?:[0-9]{1,3}|[A-Za-z]|[ivxIVX]{1,5})[.)]+[ \t]+"
#: In the SQL: no known sentence has as many words, so none is spread over as many lines.
LINES = 80


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def pattern(rule: str) -> str:
    """A rule as a regular expression over ',a,b,c,'."""
    return "(?:[a-z0-9_]+,)*?".join(f"(?:{'|'.join(x.split('|'))})," for x in rule.split(">"))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order: the longest known run of whole lines at each line or sentence start."""
    known = F.create_map(*[F.lit(x) for k, s in SENTENCES.items() for x in (normal(s), k)])
    bare = F.regexp_replace(F.regexp_replace(text, ENDS, "$1$2\x01"), ITEM, "$1")
    words = F.regexp_replace(F.lower(bare), "[^a-z0-9\n\x01]+", " ")
    lines = F.trim(F.regexp_replace(F.regexp_replace(words, "[ \n]*\n[ \n]*", "\n"), "[ \n]*\x01[ \n]*", "\x01"))
    runs = "|".join(normal(s).replace(" ", "[ \n]") for s in sorted(SENTENCES.values(), key=len, reverse=True))
    found = F.regexp_extract_all(lines, F.lit(rf"(?:^|(?<=[\n\x01]))({runs})(?=[\n\x01]|$)"), F.lit(1))
    return F.transform(found, lambda s: F.try_element_at(known, F.replace(s, F.lit("\n"), F.lit(" "))))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, licenses, sentences, others): licences in the order of the rules, identifiers in order, those no rule took."""
    low = F.lower(F.col(text))
    marked = reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in MARKS])
    rows = docs.select(F.col(key), F.when(marked, identifiers(F.col(text))).otherwise(F.array().cast("array<string>")).alias("ids"))
    rows = rows.select(key, F.array_join("ids", ",").alias("sentences"))
    # What is left after each rule, and the licences so far, as a fold over the rules.
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + pattern(rule)).alias("regex")) for name, rule in RULES])
    start = F.struct(F.concat(F.lit(","), F.col("sentences"), F.lit(",")).alias("left"), F.lit("").alias("names"))
    step = lambda s, r: F.when(F.rlike(s["left"], r["regex"]), F.struct(F.regexp_replace(s["left"], r["regex"], F.lit(",")).alias("left"), F.concat(s["names"], F.when(F.contains(F.concat(F.lit(","), s["names"]), F.concat(F.lit(","), r["name"], F.lit(","))), "").otherwise(F.concat(r["name"], F.lit(",")))).alias("names"))).otherwise(s)
    folded = F.aggregate(rules, start, step)
    rows = rows.withColumn("f", F.when(F.col("sentences") != "", folded))
    none = lambda c: F.coalesce(F.trim(c, F.lit(",")), F.lit(""))
    return rows.select(key, none(F.col("f.names")).alias("licenses"), "sentences", none(F.col("f.left")).alias("others"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sql() -> str:
    """The same for DuckDB, the rules as a chain of steps."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{q(normal(s))}: {q(k)}" for k, s in SENTENCES.items()) + "}"
    look = lambda s: f"{known}[trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))]"
    marked = " OR ".join(f"contains(lower(text), {q(m)})" for m in MARKS)
    ctes = [
        f"k AS (SELECT doc_id, CASE WHEN {marked} THEN string_split(regexp_replace(text, {q(ENDS)}, '\\1\\2' || chr(1), 'g'), chr(1)) ELSE [] END AS s FROM documents)",
        "l AS (SELECT doc_id, n, string_split(x, chr(10)) AS l FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS n FROM k))",
        f"t AS (SELECT doc_id, n, l, list_filter(list_transform(range(greatest(0, len(l) - {LINES}), len(l)), lambda i: {{'i': i, 'id': {look("array_to_string(l[i + 1:], ' ')")}}}), lambda h: h.id IS NOT NULL)[1] AS f FROM l)",
        f"i AS (SELECT k.doc_id, list_filter(flatten(coalesce(list(CASE WHEN f IS NULL THEN list_transform(l, lambda x: {look('x')}) ELSE list_append(list_transform(l[:f.i], lambda x: {look('x')}), f.id) END ORDER BY n) FILTER (n IS NOT NULL), [])), lambda x: x IS NOT NULL) AS ids FROM k LEFT JOIN t ON t.doc_id = k.doc_id GROUP BY k.doc_id)",
        "s0 AS (SELECT doc_id, array_to_string(ids, ',') AS sentences, ',' || array_to_string(ids, ',') || ',' AS rest, '' AS names FROM i)",
    ]
    for n, (name, rule) in enumerate(RULES):
        regex = q("," + pattern(rule))
        ctes.append(f"s{n + 1} AS (SELECT doc_id, sentences, regexp_replace(rest, {regex}, ',', 'g') AS rest, CASE WHEN regexp_matches(rest, {regex}) AND NOT contains(',' || names, {q(',' + name + ',')}) THEN names || {q(name + ',')} ELSE names END AS names FROM s{n})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, trim(names, ',') AS licenses, coalesce(sentences, '') AS sentences, trim(coalesce(rest, ''), ',') AS others FROM s{len(RULES)}"
