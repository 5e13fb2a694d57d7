"""Licence scan: digests of canonical whole texts against known licences, in DataFrame operations only."""
from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.llm.common import documents, text_or_empty

#: Short licences and grants as published, by SPDX identifier. The whole texts of license_texts are added below.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
#: Titles that publishers put above a licence whose text has none of its own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng license", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: The last line of the terms; what follows tells how to apply them and is often left out.
END = re.compile(r"(?m)^[ ]*END OF TERMS AND CONDITIONS[ ]*$")


def published(texts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The forms in which licence files carry these texts: with and without title, as wrapped and a line per paragraph, and with
    and without what follows the terms. Texts of license_texts have their titles as first paragraphs, those of TITLES have none."""
    out: dict[tuple[str, str], None] = {}
    for license, text in texts:
        bodies = [text.strip()]
        if license not in TITLES:
            bodies.append(re.split(r"\n\s*\n", bodies[0], maxsplit=1)[1])
        if END.search(text):
            bodies += [b[: END.search(b).end()] for b in bodies] + [b[: END.search(b).start()] for b in bodies]
        if license == "BSD-3-Clause":
            # the two-clause text is this one without its third condition
            out |= dict.fromkeys(published([("BSD-2-Clause", re.sub(r"(?s)\n3\. Neither.*?permission\.\n", "", bodies[0]))]))
        if license.startswith("BSD"):
            bodies += [re.sub(r"(?m)^\d\. ", "* ", b) for b in bodies]
        for body in bodies:
            for form in (body, "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", body))):
                out |= dict.fromkeys((license, f"{title}\n\n{form}" if title else form) for title in ("", *TITLES.get(license, ())))
    return list(out)


KNOWN += published(KNOWN[:3] + [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))])
#: Spellings that count as equal, after lower-casing and without punctuation.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("copyright holder", "copyright owner"), ("per cent", "percent"), ("organisation", "organization"), ("favour", "favor"), ("https", "http")]
#: Known texts that are broadcast at most: 100 bytes each.
BROADCAST_TEXTS = 100_000
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|all rights reserved)[^\n]*$"
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Lower case; lines that start with a copyright notice go; punctuation and white space become one space; spellings are made one.

    While spellings are replaced, words stand two spaces apart, so that each has its own at both ends and none is skipped.
    """
    out = F.regexp_replace(F.lower(text), "©", "(c)")
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, NOT_WORD, "  ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(apart(a)), F.lit(apart(b)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def apart(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """(digest, license): one row per known text, so its size is that of the given list."""
    rows = spark.createDataFrame(list(KNOWN if known is None else known), "license string, text string")
    return rows.select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=None) -> DataFrame:
    """One row per input row: id_col, digest of the canonical text, license (null if unknown).

    The whole canonical text has to equal a known one; a licence inside a longer text doesn't count. Null texts equal empty ones,
    which match nothing. Rows are scanned one by one, so repeated rows and null ids stay; a digest that several known texts have
    goes to the least identifier. An empty table gives an empty result; other columns are ignored. The known side has a row per
    known text; up to BROADCAST_TEXTS of them it is broadcast and nothing else is shuffled, beyond them it is joined by digest.
    """
    listed = known_digests(docs.sparkSession, known)
    few = len(KNOWN if known is None else known) <= BROADCAST_TEXTS
    digests = docs.select(F.col(id_col), F.sha2(canonical(text_or_empty(text_col)).cast("binary"), 256).alias("digest"))
    return digests.join(F.broadcast(listed) if few else listed, "digest", "left").select(id_col, "digest", "license")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _canonical_sql(col: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({col}), '©', '(c)', 'g'), '{COPYRIGHT_LINE}', ' ', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '{NOT_WORD}', '  ', 'g')) || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{apart(a)}', '{apart(b)}')"
    return f"trim(replace({out}, '  ', ' '))"


def _known_sql() -> str:
    return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)


OP6_SQL = f"""
WITH known(license, text) AS (VALUES {_known_sql()}),
digests AS (SELECT sha256({_canonical_sql('text')}) AS digest, min(license) AS license FROM known GROUP BY 1)
SELECT d.doc_id, d.digest, k.license
FROM (SELECT doc_id, sha256({_canonical_sql("coalesce(text, '')")}) AS digest FROM documents) d
LEFT JOIN digests k USING (digest)
"""


def op6_license_forms(spark, sf_dir: str) -> DataFrame:
    """The scan of known texts, one for each document by its id, as files carry them: under a copyright line, in capitals, with
    another spelling, on a single line, or with a word too many (which is no known text any more)."""
    texts = list(dict.fromkeys(KNOWN))
    known = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "k int, known string")
    d = documents(spark, sf_dir).select("doc_id", F.pmod("doc_id", F.lit(len(texts))).cast("int").alias("k"), F.pmod(F.floor(F.col("doc_id") / len(texts)), F.lit(4)).alias("form"))
    t, form = F.col("known"), F.col("form")
    text = F.when(form == 0, F.concat(F.lit("Copyright (c) 2020 Somebody\n\n"), t)).when(form == 1, F.upper(t)).when(form == 2, F.replace(t, F.lit("license"), F.lit("licence"))).otherwise(F.concat(F.lit("besides "), t))
    return license_scan(d.join(known, "k").select("doc_id", text.alias("text")))


OP6_FORMS_SQL = f"""
WITH listed(i, license, text) AS (VALUES {", ".join("({}, '{}', '{}')".format(i, k, t.replace("'", "''")) for i, (k, t) in enumerate(dict.fromkeys(KNOWN)))}),
digests AS (SELECT sha256({_canonical_sql('text')}) AS digest, min(license) AS license FROM listed GROUP BY 1),
made AS (
  SELECT doc_id, CASE doc_id // {len(dict.fromkeys(KNOWN))} % 4 WHEN 0 THEN 'Copyright (c) 2020 Somebody' || chr(10) || chr(10) || listed.text WHEN 1 THEN upper(listed.text) WHEN 2 THEN replace(listed.text, 'license', 'licence') ELSE 'besides ' || listed.text END AS text
  FROM documents JOIN listed ON doc_id % {len(dict.fromkeys(KNOWN))} = i)
SELECT m.doc_id, m.digest, d.license FROM (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM made) m LEFT JOIN digests d USING (digest)
"""
