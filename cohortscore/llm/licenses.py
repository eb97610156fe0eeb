"""Licence scans by sentence rules.

A text is read twice: line by line, and with its lines joined into paragraphs (a line end and the next
line's comment mark are a blank there; an empty line still ends a sentence), since licences are usually
wrapped.  Each reading is cut into sentences, normalised to lower-case ASCII letters and digits with
single blanks; list numbers are no sentences.  Sentences that are known become one-character
identifiers, others a gap.  Ordered rules, longer first, are then found in the string of identifiers and
consumed.  DataFrame functions only; nothing is shuffled: the known sentences and the rules are literals
of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices.
SENTENCES = {
    "a": "Licensed under the Apache License, Version 2.0",
    "b": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "c": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "d": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "e": "See the License for the specific language governing permissions and limitations under the License",
    "f": "Released under the MIT License",
    "g": "Licensed under the MIT License",
    "h": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "i": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "j": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "k": "This work is licensed under the GNU General Public License, version 3",
    "l": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "m": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "n": "See the GNU General Public License for more details",
    "o": "Licensed under CC BY-NC 4.0",
    "p": "Licensed under CC BY 4.0",
    "q": "Licensed under CC BY-SA 4.0",
    "r": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "s": "All rights reserved",
    "t": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "u": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "v": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "w": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "x": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "y": "This is free and unencumbered software released into the public domain",
    "A": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "B": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "C": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "D": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "E": "This software is provided 'as-is', without any express or implied warranty",
    "F": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "G": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "H": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "I": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "J": "Distributed under the Boost Software License, Version 1.0",
    "K": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "L": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "M": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "N": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "O": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "P": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "Q": "Apache License Version 2.0, January 2004",
    "R": "Mozilla Public License Version 2.0",
    "S": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "T": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "U": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
}
#: Identifiers of the SPDX list that a tag may name.
TAG = "SPDX-License-Identifier"
TAGGED = """
0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0
CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later
LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 OpenSSL PHP-3.01 PostgreSQL Python-2.0 UPL-1.0 Unlicense Vim W3C WTFPL X11 Zlib
""".split()
#: Licence and the sequence of sentence identifiers that states it.
RULES = [
    ("Apache-2.0", "bcde"),
    ("BSD-3-Clause", "tuvwBC"),
    ("BSD-2-Clause", "tuvBC"),
    ("MIT", "hijA"),
    ("BSD-3-Clause", "tuvw"),
    ("MIT", "hij"),
    ("BSD-2-Clause", "tuv"),
    ("GPL-3.0-or-later", "lmn"),
    ("Apache-2.0", "bc"),
    ("MIT", "hi"),
    ("GPL-3.0-or-later", "l"),
    ("Apache-2.0", "b"),
    ("Apache-2.0", "a"),
    ("MIT", "h"),
    ("MIT", "f"),
    ("MIT", "g"),
    ("GPL-3.0-only", "k"),
    ("CC-BY-NC-4.0", "o"),
    ("CC-BY-SA-4.0", "q"),
    ("CC-BY-4.0", "p"),
    ("CC-BY-4.0", "r"),
    ("MPL-2.0", "x"),
    ("Unlicense", "y"),
    ("Proprietary", "s"),
    ("ISC", "D"),
    ("Zlib", "EF"),
    ("Zlib", "F"),
    ("GPL-2.0-or-later", "Gmn"),
    ("GPL-2.0-or-later", "G"),
    ("LGPL-2.1-or-later", "H"),
    ("AGPL-3.0-or-later", "I"),
    ("BSL-1.0", "J"),
    ("CC0-1.0", "K"),
    ("WTFPL", "L"),
    ("EPL-2.0", "M"),
    ("OFL-1.1", "N"),
    ("GPL-2.0-only", "O"),
    ("GPL-3.0-only", "P"),
    ("Apache-2.0", "Q"),
    ("MPL-2.0", "R"),
    ("LGPL-3.0-only", "S"),
    ("AGPL-3.0-only", "T"),
    ("LGPL-2.1-only", "U"),
]
BREAK = r"[.!?;:]+(?:[ \t\r\n]+|$)|[\r\n]+"
WRAP = r"""\r?\n[ \t]*(?:(?://+|[#*;%]+|--+)[ \t]*)?([A-Za-z0-9"'(<\[])"""
NUMBER = r"^(?:[0-9]{1,3}|[a-z]|[ivx]{1,4})$"
LIST = r"^[0-9]{1,2} "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\x01"


def paragraphs(text: Column) -> Column:
    """Lines joined; an empty line still parts them."""
    return F.regexp_replace(text, WRAP, " $1")


def normalised(text: Column) -> Column:
    """Array of normalised sentences; empty ones and list numbers left out."""
    one = F.regexp_replace(F.translate(F.regexp_replace(text, BREAK, MARK), UPPER, LOWER), f"[^a-z0-9{MARK}]+", " ")
    return F.filter(F.transform(F.split(one, MARK), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike(NUMBER))


def _norm(sentence: str) -> list[str]:
    import re

    parts = re.split(MARK, re.sub(BREAK.replace("$", r"\Z"), MARK, sentence))
    found = [re.sub("[^a-z0-9]+", " ", p.translate(str.maketrans(UPPER, LOWER))).strip() for p in parts]
    return [s for s in found if s and not re.search(NUMBER, s)]


def dictionary() -> tuple[dict[str, str], dict[str, str]]:
    """Normalised sentence -> character, and identifier -> its characters.

    A known sentence may hold a break of its own (";", "v. 2.0"), so an identifier stands for one
    or more normalised sentences, each with a character.
    """
    chars: dict[str, str] = {}
    spelled = {}
    for key, sentence in [*SENTENCES.items(), *((f"{TAG}: {x}", f"{TAG}: {x}") for x in TAGGED)]:
        spelled[key] = "".join(chars.setdefault(s, chr(0x4E00 + len(chars))) for s in _norm(sentence))
    return chars, spelled


def rules() -> list[tuple[str, str]]:
    """The ordered rules, spelled in characters; longer first, else as listed."""
    _, spelled = dictionary()
    found = [(name, "".join(spelled[k] for k in ids)) for name, ids in RULES] + [(x, spelled[f"{TAG}: {x}"]) for x in TAGGED]
    return sorted(found, key=lambda r: -len(r[1]))


def _read(text: Column) -> tuple[Column, Column]:
    """Number of sentences, and their identifiers as a string (a gap: a dot)."""
    chars, _ = dictionary()
    known = F.create_map(*[F.lit(x) for kv in chars.items() for x in kv])
    longest = max(map(len, chars)) + 3
    sentences = normalised(text)
    one = lambda s: F.coalesce(F.try_element_at(known, s), F.try_element_at(known, F.regexp_replace(s, LIST, "")), F.lit("."))
    ids = F.transform(sentences, lambda s: F.when(F.length(s) <= longest, one(s)).otherwise(F.lit(".")))
    return F.size(ids).cast("long"), F.array_join(ids, "")


def _apply(ids: Column) -> Column:
    """``left, n, names``: what the rules leave, how many matches they had and of which licences."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern")) for name, pattern in rules()])
    none = F.struct(ids.alias("left"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        cut = F.replace(acc["left"], rule["pattern"], F.lit(""))
        n = ((F.length(acc["left"]) - F.length(cut)) / F.length(rule["pattern"])).cast("long")
        names = F.when(n > 0, F.array_union(acc["names"], F.array(rule["name"]))).otherwise(acc["names"])
        return F.struct(F.replace(acc["left"], rule["pattern"], F.lit("#")).alias("left"), (acc["n"] + n).alias("n"), names.alias("names"))

    return F.aggregate(table, none, step)


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, n_sentences, known_sentences, licenses, n_matches``.

    ``n_sentences`` counts by lines; ``known_sentences`` and ``n_matches`` are those of the reading (lines or
    paragraphs) that has more; ``licenses`` the distinct licences that either states, in order, joined
    by " AND " (null if none).
    Null text is the empty text: no sentences.  Very long texts are read whole, a document at a time.
    Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    n, by_line = _read(F.col("t"))
    _, joined = _read(paragraphs(F.col("t")))
    d = d.select("doc_id", n.alias("n_sentences"), by_line.alias("a"), joined.alias("b"))
    count = lambda c: F.length(F.translate(c, ".", "")).cast("long")
    d = d.withColumn("known_sentences", F.greatest(count("a"), count("b")))
    got = lambda c: F.when(F.col("known_sentences") > 0, _apply(F.col(c)))
    d = d.select("doc_id", "n_sentences", "known_sentences", got("a").alias("x"), got("b").alias("y"))
    names = F.array_join(F.array_sort(F.array_union("x.names", "y.names")), " AND ")
    matches = F.coalesce(F.greatest("x.n", "y.n"), F.lit(0).cast("long"))
    return d.select("doc_id", "n_sentences", "known_sentences", F.when(names != "", names).alias("licenses"), matches.alias("n_matches"))


def oracle_sql() -> str:
    """The same in DuckDB: both readings as rows, one step for each rule."""
    chars, _ = dictionary()
    known = "MAP {" + ", ".join(f"'{s}': '{c}'" for s, c in chars.items()) + "}"
    brk, wrap = BREAK.replace("'", "''"), WRAP.replace("'", "''")
    steps, names = [], {}
    for i, (name, pattern) in enumerate(rules()):
        steps.append(f"r{i} AS (SELECT * EXCLUDE (lft), (length(lft) - length(replace(lft, '{pattern}', ''))) // {len(pattern)} AS n{i}, replace(lft, '{pattern}', '#') AS lft FROM {f'r{i - 1}' if i else 'ids'})")
        names.setdefault(name, []).append(f"n{i}")
    said = ", ".join(f"CASE WHEN {' + '.join(f'sum({x})' for x in c)} > 0 THEN '{n}' END" for n, c in sorted(names.items()))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
readings AS (SELECT doc_id, 0 AS reading, t FROM t UNION ALL SELECT doc_id, 1, regexp_replace(t, '{wrap}', ' \\1', 'g') FROM t),
parts AS (
  SELECT doc_id, reading, [trim(x) for x in string_split(regexp_replace(translate(regexp_replace(t, '{brk}', chr(1), 'g'),
    '{UPPER}', '{LOWER}'), '[^a-z0-9' || chr(1) || ']+', ' ', 'g'), chr(1))] AS s FROM readings),
s AS (SELECT doc_id, reading, [x for x in s if x <> '' AND NOT regexp_matches(x, '{NUMBER}')] AS s FROM parts),
ids AS MATERIALIZED (SELECT doc_id, reading, len(s) AS n_sentences, array_to_string([coalesce({known}[x], {known}[regexp_replace(x, '{LIST}', '')], '.') for x in s], '') AS lft FROM s),
known AS (SELECT doc_id, max(n_sentences) FILTER (WHERE reading = 0) AS n_sentences, max(length(replace(lft, '.', ''))) AS known_sentences FROM ids GROUP BY doc_id),
{", ".join(steps)},
hits AS (SELECT doc_id, nullif(concat_ws(' AND ', {said}), '') AS licenses, max({" + ".join(f"n{i}" for i in range(len(rules())))}) AS n_matches FROM r{len(rules()) - 1} GROUP BY doc_id)
SELECT k.doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(known_sentences AS BIGINT) AS known_sentences, licenses, CAST(n_matches AS BIGINT) AS n_matches
FROM known k JOIN hits h ON h.doc_id = k.doc_id"""
