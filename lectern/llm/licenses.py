"""License scans by canonical digest lookup.

Entire texts are normalised (case, copyright statements, equivalent spellings, punctuation and
white space), and their SHA-256 digests are hash-joined to the digests of known license
texts, normalised the same way. The units are whole documents and whole lines, so a bare
license document and a one-line notice are both found. Only DataFrame functions are used;
only units with the length of a known text are hashed, and only matches are shuffled. Whether
the known side is broadcast is left to Spark's own check of its size.

Defined cases. Null or empty text: no match. Of a line that begins with a copyright statement
what follows as a notice of its own stays, the rest goes; a text that is nothing but copyright
lines normalises to nothing and matches nothing. Lines end at line feeds alone. A document that matches as a whole and by lines
gets a row for each unit. Repeated rows add up in ``n_units``. Rows without id are counted
together. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public license texts and customary notices, by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = _BSD2.replace("\n\nTHIS SOFTWARE", "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE")
#: Longer texts are files, named by their identifiers.
_FILES = tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
KNOWN: tuple[tuple[str, str], ...] = (
    *_FILES,
    ("BSD-3-Clause", _BSD3),
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD2),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)
#: A line that begins so is a copyright line, and words that begin a notice after one.
COPYRIGHT = r"^[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
NOTICE = r"^[ \t]*(?:copyright|\(c\)|©)[^\n]*?\.[ \t]+((?:released|licensed|permission|redistribution|distributed|available|this (?:work|project|program|software|file|library)|spdx-license-identifier)\b[^\n]*)$"
#: Spellings that count as equal, applied in this order to lower-case text.
EQUIVALENT = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"), ("https:", "http:"), ("organisation", "organization"), ("&", " and "))


def _clean(text: Column) -> Column:
    """Normalised text that still has its line breaks."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), "(?md)" + NOTICE, "$1"), "(?md)" + COPYRIGHT, "")
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")


def _lines(clean: Column) -> Column:
    return F.filter(F.transform(F.split(clean, "\n"), lambda x: F.trim(x)), lambda x: x != "")


#: Lengths of known texts that are listed in the plan, to save hashing what cannot match.
MOST_LENGTHS = 1000


def known_digests(spark, known=KNOWN) -> DataFrame:
    rows = spark.createDataFrame([(k, t) for k, t in known], "license string, t string")
    return rows.select("license", F.array_join(_lines(_clean(F.col("t"))), " ").alias("n")).select(F.sha2("n", 256).alias("digest"), "license", F.length("n").alias("chars")).distinct()


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, unit (``document`` or ``line``), n_units, digest."""
    known = known_digests(docs.sparkSession) if known is None else known
    lens = [r["chars"] for r in known.select("chars").distinct().limit(MOST_LENGTHS + 1).collect()]
    rows = docs.select(F.col(doc_id).alias("doc_id"), _lines(_clean(F.col(text))).alias("lines"))
    unit = lambda name, value: F.struct(F.lit(name).alias("unit"), value.alias("n"))
    units = F.concat(F.array(unit("document", F.array_join("lines", " "))), F.when(F.size("lines") > 1, F.transform("lines", lambda x: unit("line", x))).otherwise(F.array().cast("array<struct<unit:string,n:string>>")))
    # a text whose length no known text has cannot have its digest either; with too many lengths to
    # list, all are hashed
    fits = F.filter(units, lambda u: F.length(u["n"]).isin(*lens)) if len(lens) <= MOST_LENGTHS else units
    found = rows.select("doc_id", F.explode(fits).alias("u")).select("doc_id", "u.unit", F.sha2("u.n", 256).alias("digest"))
    return found.join(known.select("digest", "license"), "digest").groupBy("doc_id", "license", "unit", "digest").agg(F.count("*").alias("n_units")).select("doc_id", "license", "unit", "n_units", "digest")


def oracle(known=KNOWN) -> str:
    text = rf"regexp_replace(regexp_replace(lower(@), '(?m){NOTICE}', '\1', 'g'), '(?m){COPYRIGHT}', '', 'g')"
    for a, b in EQUIVALENT:
        text = f"replace({text}, '{a}', '{b}')"
    lines = "list_filter(list_transform(string_split(regexp_replace(" + text + r", '[^\p{L}\p{N}\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in known)
    return f"""
with known as (select distinct license, sha256(array_to_string({lines.replace('@', 't')}, ' ')) as digest from (values {values}) as v(license, t)),
d as (select doc_id, {lines.replace('@', 'text')} as l from documents where text is not null),
u as (select doc_id, 'document' as unit, array_to_string(l, ' ') as n from d
      union all select doc_id, 'line', unnest(l) from d where len(l) > 1)
select doc_id, license, unit, count(*)::bigint as n_units, digest from u join known on digest = sha256(n) group by doc_id, license, unit, digest
"""
