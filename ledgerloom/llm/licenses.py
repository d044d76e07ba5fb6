"""Licence scan by sentence rules.

A text is cut into stretches at blank lines and after . ! ? ; : before a blank; a stretch's lines, comment marks and
all, are normalised to their ASCII letters and digits in lower case, one blank between words. A known sentence is a
stretch's last lines together (so it may be wrapped, and a line without a stop may stand before it) or one of its lines.
What remains of a document is the sequence of its known sentences' identifiers. A licence rule is an ordered list of
identifiers and fits where its list stands in the sequence with no other known sentence in between; from left to right,
the longest rule that fits takes its sentences, and no other rule gets them.

Spark's part: all of it is one projection in built-in functions; the tables of sentences and rules (fixed, some dozens)
are literals. No shuffle, no group, so a line that half of all documents share costs what any other line costs. A known
sentence has at most ``MOST_WORDS`` words and so lines, which bounds the stretches of lines that are looked up.

Defined cases: null text is empty; a document without a known sentence gets empty strings and 0; repeated rows are
judged each; sentences may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import BLANKS, ascii_lower, documents, let, whole_text

#: Normalised sentences of public licence notices, by identifier (two characters).
SENTENCES = {
    "a0": "licensed under the apache license version 2 0",
    "a1": "licensed under the apache license version 2 0 the license",
    "a2": "you may not use this file except in compliance with the license",
    "a3": "you may obtain a copy of the license at",
    "a4": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "a5": "see the license for the specific language governing permissions and limitations under the license",
    "b0": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "b1": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "b2": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "b3": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "b4": "licensed under the bsd 3 clause license",
    "b5": "licensed under the bsd 2 clause license",
    "c0": "licensed under cc by nc 4 0",
    "c1": "licensed under cc by 4 0",
    "c2": "licensed under cc by sa 4 0",
    "c3": "licensed under cc by nc sa 4 0",
    "c4": "licensed under cc by nd 4 0",
    "c5": "licensed under cc0 1 0",
    "c6": "this work is licensed under a creative commons attribution 4 0 international license",
    "c7": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "c8": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "g0": "this work is licensed under the gnu general public license version 3",
    "g1": "this work is licensed under the gnu general public license version 2",
    "g2": "this program is free software",
    "g3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "g4": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "g7": "this program is distributed in the hope that it will be useful but without any warranty",
    "g8": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "g9": "see the gnu general public license for more details",
    "ga": "you should have received a copy of the gnu general public license along with this program",
    "gb": "this library is free software",
    "gc": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "gd": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "ge": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "g5": "this work is licensed under the gnu lesser general public license version 3",
    "g6": "this work is licensed under the gnu affero general public license version 3",
    "m0": "released under the mit license",
    "m1": "licensed under the mit license",
    "m2": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "m3": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "m4": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "m5": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "b6": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "b7": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    "i0": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "i1": "licensed under the isc license",
    "s0": "distributed under the boost software license version 1 0",
    "p0": "licensed under the mozilla public license version 2 0",
    "p1": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "u0": "this is free and unencumbered software released into the public domain",
    "z0": "all rights reserved",
}
#: Licence, ordered identifiers.
RULES = (
    ("Apache-2.0", ("a0",)),
    ("Apache-2.0", ("a1", "a2", "a3", "a4", "a5")),
    ("Apache-2.0", ("a1", "a2", "a3")),
    ("BSD-3-Clause", ("b0", "b1", "b2", "b3", "b6", "b7")),
    ("BSD-3-Clause", ("b0", "b1", "b2", "b3")),
    ("BSD-2-Clause", ("b0", "b1", "b2", "b6", "b7")),
    ("BSD-2-Clause", ("b0", "b1", "b2")),
    ("BSD-3-Clause", ("b4",)),
    ("BSD-2-Clause", ("b5",)),
    ("CC-BY-NC-4.0", ("c0",)),
    ("CC-BY-4.0", ("c1",)),
    ("CC-BY-SA-4.0", ("c2",)),
    ("CC-BY-NC-SA-4.0", ("c3",)),
    ("CC-BY-ND-4.0", ("c4",)),
    ("CC0-1.0", ("c5",)),
    ("CC-BY-4.0", ("c6",)),
    ("CC-BY-SA-4.0", ("c7",)),
    ("CC-BY-NC-4.0", ("c8",)),
    ("GPL-3.0", ("g0",)),
    ("GPL-2.0", ("g1",)),
    ("GPL-3.0-or-later", ("g2", "g3", "g7", "g8", "g9", "ga")),
    ("GPL-3.0-or-later", ("g2", "g3")),
    ("GPL-2.0-or-later", ("g2", "g4", "g7", "g8", "g9", "ga")),
    ("GPL-2.0-or-later", ("g2", "g4")),
    ("LGPL-2.1-or-later", ("gb", "gc")),
    ("LGPL-3.0-or-later", ("gb", "gd")),
    ("AGPL-3.0-or-later", ("g2", "ge")),
    ("LGPL-3.0", ("g5",)),
    ("AGPL-3.0", ("g6",)),
    ("MIT", ("m0",)),
    ("MIT", ("m1",)),
    ("MIT", ("m2", "m3", "m4", "m5")),
    ("MIT", ("m2", "m3")),
    ("ISC", ("i0",)),
    ("ISC", ("i1",)),
    ("BSL-1.0", ("s0",)),
    ("MPL-2.0", ("p0",)),
    ("MPL-2.0", ("p1",)),
    ("Unlicense", ("u0",)),
    ("Proprietary", ("z0",)),
)
#: Every known sentence has one of these, so a sentence without any needs no lookup (tests check it).
SIGNS = "licens|software|redistribut|permission|copyright|reserved|warrant"
MOST_WORDS = max(len(s.split()) for s in SENTENCES.values())


def sentence_rows(text: Column) -> Column:
    """The known identifiers of a text, in order."""
    table = F.create_map(*[F.lit(x) for k, v in SENTENCES.items() for x in (v, k)])
    known = lambda s: F.try_element_at(table, s)
    cut = F.filter(F.split(ascii_lower(text), rf"\n[^a-z0-9\n]*\n|[.!?;:]+[{BLANKS}]+"), lambda s: s.rlike(SIGNS))

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        tails = F.transform(F.sequence(F.greatest(F.lit(1), n - MOST_WORDS + 1), F.greatest(F.lit(1), n)), lambda i: F.when(known(F.array_join(F.slice(lines, i, n), " ")).isNotNull(), i))
        return let(F.coalesce(F.array_min(tails), n + 1), lambda i: F.concat(F.transform(F.slice(lines, 1, i - 1), known), F.array(known(F.array_join(F.slice(lines, i, n), " ")))))

    lines = lambda s: F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))), lambda x: x != "")
    return F.filter(F.flatten(F.transform(F.transform(cut, lines), of_lines)), lambda k: k.isNotNull())


def scan(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """doc_id, n_sentences (known ones), sentences (their identifiers) and licenses (distinct, sorted; comma-joined)."""
    text = whole_text()
    known = docs.select("doc_id", F.when(text.rlike(f"(?i){SIGNS}"), sentence_rows(text)).otherwise(F.array().cast("array<string>")).alias("known"))
    shown = {"".join(f"<{i}>" for i in ids): name for name, ids in sorted(rules, key=lambda r: -len(r[1]))}
    names = F.create_map(*[F.lit(x) for pair in shown.items() for x in pair])
    sequence = F.concat(F.lit("<"), F.array_join("known", "><"), F.lit(">"))
    fits = F.regexp_extract_all(sequence, F.lit(f"({'|'.join(shown)})"), F.lit(1))
    licenses = F.array_sort(F.array_distinct(F.transform(fits, lambda r: F.try_element_at(names, r))))
    return known.select("doc_id", F.size("known").cast("long").alias("n_sentences"), F.array_join("known", ",").alias("sentences"), F.when(F.size("known") > 0, F.array_join(licenses, ",")).otherwise("").alias("licenses"))


def op3_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


_TABLE = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
_RULES = ", ".join(f"('{name}', '{' '.join(ids)}', {len(ids)})" for name, ids in RULES)
OP3_SQL = rf"""
WITH RECURSIVE known(id, sentence) AS (VALUES {_TABLE}),
rules(name, ids, k) AS (VALUES {_RULES}),
base AS (SELECT row_number() OVER () AS n, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
cut AS (SELECT n, string_split_regex(t, '\n[^a-z0-9\n]*\n|[.!?;:]+[\x20\x09-\x0D]+') AS s FROM base),
stretches AS (SELECT n, unnest(s) AS s, unnest(range(len(s))) AS i FROM cut),
lined AS (
  SELECT n, i, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS w
  FROM stretches WHERE regexp_matches(s, '{SIGNS}')),
lines AS (SELECT n, i, w, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS j FROM lined),
tails AS (
  SELECT n, i, j, id, row_number() OVER (PARTITION BY n, i ORDER BY j) AS first
  FROM (SELECT n, i, j, array_to_string(w[j:], ' ') AS tail FROM lines WHERE j > len(w) - {MOST_WORDS}) JOIN known ON tail = sentence),
ended AS (SELECT n, i, j, id FROM tails WHERE first = 1),
found AS (
  SELECT n, i, j, id FROM ended
  UNION ALL
  SELECT l.n, l.i, l.j, k.id FROM lines l JOIN known k ON l.line = k.sentence LEFT JOIN ended e ON e.n = l.n AND e.i = l.i WHERE e.j IS NULL OR l.j < e.j),
joined AS (SELECT n, list(id ORDER BY i, j) AS ids FROM found GROUP BY n),
-- from the left, the longest rule that begins at each sentence takes its sentences
walk(n, ids, pos, name) AS (
  SELECT n, ids, 1, CAST(NULL AS VARCHAR) FROM joined
  UNION ALL
  SELECT w.n, w.ids, w.pos + coalesce(r.k, 1), r.name
  FROM walk w LEFT JOIN LATERAL (
    SELECT name, k FROM rules WHERE array_to_string(w.ids[w.pos : w.pos + k - 1], ' ') = rules.ids ORDER BY k DESC LIMIT 1) r ON true
  WHERE w.pos <= len(w.ids)),
named AS (SELECT n, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM walk GROUP BY n)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentences, coalesce(licenses, '') AS licenses
FROM base LEFT JOIN joined USING (n) LEFT JOIN named USING (n)
"""
