"""License scans: canonical digests of whole texts looked up among digests of known licences.

Only DataFrame expressions. A text is lower-cased, loses its copyright lines, has every run of characters other than
letters and digits made one gap, and has equivalent spellings made one; the SHA-256 of what is left is joined to the
digests of the known texts. The same is done with every line of a text, since a notice is often one line.

A copyright line has at most LONGEST_STATEMENT characters, so that a licence written on one line stays, and either
- begins with the word "copyright", followed by the word "c" or "by", by a word that begins with four digits, or by one of the signs © < [ before its next word,
- begins with "(c)" in brackets and then a word that begins with four digits or is "copyright" (a lettered clause "(c) you may" stays),
- has the sign © before its first word, or has no words but "all rights reserved".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings taken as one, in canonical words.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("judgement", "judgment"),
    ("https", "http"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("merchantibility", "merchantability"), ("modelled", "modeled"),
    ("non commercial", "noncommercial"), ("offence", "offense"), ("organisation", "organization"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]

LONGEST_STATEMENT = 200
_APART = r"[^\p{L}\p{N}\n]"
#: A copyright line in lower case, by the rules above.
COPYRIGHT_LINE = (
    rf"(?md)^(?=[^\n]{{0,{LONGEST_STATEMENT}}}$){_APART}*(?:copyright{_APART}*(?:(?:c|by)(?:{_APART}[^\n]*)?|[0-9]{{4}}[^\n]*|[©<\[][^\n]*)"
    rf"|\(c\){_APART}*(?:[0-9]{{4}}[^\n]*|copyright(?:{_APART}[^\n]*)?)|©[^\n]*|all{_APART}+rights{_APART}+reserved{_APART}*)$"
)
#: One of these is in every text that has a copyright line.
SIGNS = ["copyright", "©", "(c)", "rights"]
NOT_WORD = r"[^\p{L}\p{N}\n]+"
BREAK = r" *\n[ \n]*"

_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
)
_MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at https://mozilla.org/MPL/2.0/."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, "
    "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
    "all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included "
    "in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
    'generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_0 = _MIT.replace(", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "")


def _gnu(name: str, version: str, warranty: str = "") -> str:
    """The notice that the GNU licences ask for at the head of a file."""
    return (
        f"This {warranty or 'program'} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either "
        f"version {version} of the License, or (at your option) any later version. This {warranty or 'program'} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} "
        f"along with this {warranty or 'program'}. If not, see <https://www.gnu.org/licenses/>."
    )


#: Known texts, whole licences, headers of files, and the usual one-line notices of those that are only referred to.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT-0", _MIT_0),
    ("MIT-0", "MIT No Attribution\n" + _MIT_0),
    ("ISC", _PERMISSION + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("ISC", "ISC License\n" + _PERMISSION + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("0BSD", _PERMISSION + ".\n" + _ISC_WARRANTY),
    ("0BSD", "BSD Zero Clause License\n" + _PERMISSION + ".\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_TWO + _BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_TWO + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THIRD + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_TWO + _BSD_THIRD + _BSD_WARRANTY),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org/>"),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>"),
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MPL-2.0", _MPL_HEADER),
    ("GPL-3.0-or-later", _gnu("General Public License", "3")),
    ("GPL-2.0-or-later", _gnu("General Public License", "2")),
    ("LGPL-3.0-or-later", _gnu("Lesser General Public License", "3")),
    ("LGPL-3.0-or-later", _gnu("Lesser General Public License", "3", "library")),
    ("AGPL-3.0-or-later", _gnu("Affero General Public License", "3")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
]


def _any_old(spellings: list[tuple[str, str]]) -> str:
    """A pattern of all old spellings, by first letter."""
    by: dict[str, list[str]] = {}
    for old, _ in sorted(spellings):
        by.setdefault(old[0], []).append(old[1:].replace(" ", "  "))
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ") "


def _respelt(t: Column, spellings: list[tuple[str, str]]) -> Column:
    new_t = t
    for old, new in spellings:
        new_t = F.replace(new_t, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.when(t.rlike(_any_old(spellings)), new_t).otherwise(t)


def canonical_lines(text: Column) -> Column:
    """The canonical form with line breaks: words with a space on either side, lines without words left out. Null stays null."""
    lower = F.lower(text)
    may = F.lit(False)
    for sign in SIGNS:
        may = may | lower.contains(sign)
    t = F.when(may, F.regexp_replace(lower, COPYRIGHT_LINE, "")).otherwise(lower)
    t = F.regexp_replace(F.regexp_replace(t, NOT_WORD, "  "), BREAK, " \n ")
    return _respelt(F.concat(F.lit(" "), F.trim(t), F.lit(" ")), SPELLINGS)


def joined_lines(lines: Column) -> Column:
    """The canonical form as one line; spellings of two words may have met at a line break."""
    t = F.concat(F.lit(" "), F.trim(F.replace(lines, F.lit("\n"), F.lit(""))), F.lit(" "))
    return _respelt(t, [x for x in SPELLINGS if " " in x[0]])


def _digest(canonical: Column) -> Column:
    return F.when(F.length(F.trim(canonical)) > 0, F.sha2(canonical, 256))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null where it has no words."""
    return _digest(joined_lines(canonical_lines(text)))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """Rows (digest, license_id) of known texts, one row a digest (the smallest id where two share a form).

    known: pairs, or a table (license_id, text) of any size, such as one of whole licences; by default KNOWN. Null and wordless texts are left out.
    """
    rows = known.select("license_id", "text") if isinstance(known, DataFrame) else spark.createDataFrame(known or KNOWN, "license_id string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "license_id").where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


MOST_BROADCAST = 100_000


def _sided(known: DataFrame) -> DataFrame:
    """known, to be broadcast if it has at most MOST_BROADCAST rows (of about 100 bytes); else joined by a shuffle."""
    return F.broadcast(known) if known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else known


def scan(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, text_digest, license_id (of the whole text) and line_licenses.

    line_licenses: the licences of lines that are known texts, distinct, sorted, comma-joined; empty if none. Null and wordless texts have a null
    digest and no licence. Repeated rows give repeated results; other columns of docs play no part.

    The canonical form is made once a text. Its lines are joined one by one; of these rows only hits and one row a text go on, and are
    gathered by row, so that no group grows with the copies of a text.
    """
    known = _sided(known)
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), canonical_lines(F.coalesce(F.col(text_column), F.lit(""))).alias("c"))
    lines = own.select("row", "id", _digest(joined_lines(F.col("c"))).alias("text_digest"), F.posexplode(F.split("c", "\n")).alias("pos", "line"))
    marked = lines.select("row", "id", "pos", F.when(F.col("pos") == 0, F.col("text_digest")).alias("text_digest"), _digest(F.col("line")).alias("digest")).join(known, "digest", "left")
    kept = marked.where("pos = 0 or license_id is not null")
    texts = kept.groupBy("row").agg(F.first("id", ignorenulls=True).alias("id"), F.max("text_digest").alias("text_digest"), F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("line_licenses"))
    whole = known.select(F.col("digest").alias("text_digest"), "license_id")
    return texts.join(_sided(whole), "text_digest", "left").select(F.col("id").alias(id_column), "text_digest", "license_id", "line_licenses")


def oracle(known: list[tuple[str, str]] | None = None) -> str:
    """The same by lists of lines and words. The rule for copyright lines is spelt out on words and what stands between them."""
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known or KNOWN)
    word, sign = r"[\p{L}\p{N}]+", "©"
    one = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS if " " not in a) + " ELSE w END"

    def two(x: str) -> str:
        for a, b in SPELLINGS:
            if " " in a:
                x = f"replace({x}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return x

    spelt = lambda ws: two(f"(' ' || array_to_string({ws}, '  ') || ' ')")
    return f"""
WITH texts AS (SELECT 'd' AS kind, row_number() OVER () AS id, doc_id, NULL AS license_id, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT 'k', row_number() OVER (), NULL, license_id, t FROM (VALUES {values}) k(license_id, t)),
cut AS (SELECT kind, id, pos, line, regexp_extract_all(line, '{word}') AS ws, string_split_regex(line, '{word}') AS gaps
  FROM (SELECT kind, id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT kind, id, string_split(lower(t), chr(10)) AS ls FROM texts))),
kept AS (SELECT kind, id, pos, list_transform(ws, lambda w: {one}) AS ws FROM cut WHERE len(ws) > 0 AND NOT (length(line) <= {LONGEST_STATEMENT} AND (
  (ws[1] = 'copyright' AND (coalesce(ws[2] IN ('c', 'by') OR regexp_matches(ws[2], '^[0-9]{{4}}'), false) OR gaps[2] LIKE '%{sign}%' OR gaps[2] LIKE '%<%' OR gaps[2] LIKE '%[%'))
  OR (ws[1] = 'c' AND gaps[1] LIKE '%(' AND gaps[2] LIKE ')%' AND coalesce(ws[2] = 'copyright' OR regexp_matches(ws[2], '^[0-9]{{4}}'), false))
  OR gaps[1] LIKE '%{sign}%' OR ws = ['all', 'rights', 'reserved']))),
lines AS (SELECT kind, id, pos, sha256({spelt("ws")}) AS digest FROM kept),
whole AS (SELECT kind, id, sha256({two(f"(' ' || trim(string_agg({spelt('ws')}, '' ORDER BY pos), ' ') || ' ')")}) AS digest FROM kept GROUP BY kind, id),
known AS (SELECT digest, min(license_id) AS license_id FROM whole JOIN texts USING (kind, id) WHERE kind = 'k' GROUP BY digest),
hits AS (SELECT id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses FROM lines JOIN known USING (digest) WHERE kind = 'd' GROUP BY id)
SELECT doc_id, w.digest AS text_digest, n.license_id, coalesce(line_licenses, '') AS line_licenses
FROM texts t LEFT JOIN whole w ON w.kind = 'd' AND w.id = t.id LEFT JOIN known n ON n.digest = w.digest LEFT JOIN hits h ON h.id = t.id WHERE t.kind = 'd'"""
