"""Licence scans by canonical digests (operator 3), in DataFrame functions only.

A unit of text (the whole document, a paragraph between blank lines, a run of paragraphs that is less
than the document, or a line) is brought into a canonical form: lower case, copyright lines dropped
(those with a year, a sign or a place for them: a wrapped line may begin with the word alone),
equivalent spellings made one, punctuation and white space made single spaces. Its SHA-256 digest is looked up among the digests of known licence
texts and notices, so that a unit counts only if it is a licence from end to end. The table of known
digests is part of this module and so of fixed size.

A null text has no units; units without canonical text are not looked up. Repeated rows are scanned
each for itself: counts of rows with the same doc_id add up. Of several names for one text the first
is reported. Very long texts are scanned whole. Columns other than doc_id and text are not looked at,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
{0}"""
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known texts and notices, by SPDX name.
KNOWN = (
    ("MIT", _MIT),
    ("ISC", _ISC.format(_NO_WARRANTY)),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _NO_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
)
#: Lines that name who holds the rights; spellings that mean the same.
RIGHTS = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[\[<{]|[0-9]{4})|copyright[^\n]*(19|20)[0-9]{2}|\(c\)[ \t]*(copyright|[\[<{0-9])|©|all rights reserved\.?[ \t]*$)[^\n]*$"
SAME = (("licence", "license"), ("sublicence", "sublicense"), ("copyright owner", "copyright holder"), ("https://", "http://"), ("©", "(c)"), ("&", "and"), ("whilst", "while"), ("favour", "favor"))


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), RIGHTS, "")
    for a, b in SAME:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{2}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_NAMES = "{0} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
#: Title lines that short licences stand under.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT License (Expat)", "The MIT License (Expat)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License", "Modified BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Whole texts of longer licences, one file for each SPDX name.
TEXTS = Path(__file__).with_name("license_texts")
END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of whole licences that aren't in KNOWN, and of short ones under each of their titles."""
    found = list(KNOWN[:3])
    for bullets in (("1.", "2.", "3."), ("*", "*", "*"), ("(1)", "(2)", "(3)"), ("a.", "b.", "c.")):
        found.append(("BSD-2-Clause", _BSD.format(*bullets[:2], "")))
        found.append(("BSD-3-Clause", _BSD.format(*bullets[:2], _NAMES.format(bullets[2]))))
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        found.append((path.stem, text))
        if END in text:  # what follows tells how to apply it, and is often left out; so is this line
            found += [(path.stem, text[: text.index(END)]), (path.stem, text[: text.index(END)] + END)]
    return found + [(name, f"{title}\n{text}") for name, text in found for title in TITLES.get(name, ())]


def plain_canonical(text: str) -> str:
    """canonical() of a text in plain Python."""
    out = re.sub(RIGHTS, "", text.lower())
    for a, b in SAME:
        out = out.replace(a, b)
    return re.sub("[^a-z0-9]+", " ", out).strip()


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(digest, license) of the known texts (canonical text: name)."""
    known = known if known is not None else known_texts()
    rows = F.explode(F.array(*(F.struct(F.lit(hashlib.sha256(t.encode()).hexdigest()).alias("digest"), F.lit(n).alias("license")) for t, n in known.items())))
    return spark.range(1, numPartitions=1).select(rows.alias("r")).select("r.*")


def known_texts() -> dict[str, str]:
    """Names by canonical text; the first one where several have it."""
    out: dict[str, str] = {}
    for name, text in [*KNOWN, *whole_texts()]:
        out.setdefault(plain_canonical(text), name)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, unit, n): how many units of each kind in a document are a known licence."""
    known = known_texts()
    unit = lambda name, values: F.transform(values, lambda c: F.struct(F.lit(name).alias("unit"), c.alias("c")))
    text = F.col("text")
    # Runs of paragraphs: only those that begin as a known text does and have the length of one can be it.
    heads = {tuple(t.split()[:2]) for t in known}
    begins = "^(?:" + "|".join(sorted({rf"{' '.join(h)}(?: |$)" for h in heads} | {f"{h[0]}$" for h in heads})) + ")"
    lengths = sorted({len(t) for t in known})
    read = docs.where("text is not null").select(
        "doc_id", "text", F.filter(F.transform(F.split(text, "\n[ \t]*\n", -1), canonical), lambda c: c != "").alias("p")
    )
    p = F.col("p")
    some = (F.size(p) > 2) & F.exists(p, lambda c: c.rlike(begins))
    at = F.aggregate(p, F.array(F.lit(1)), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + F.length(c) + 1)))
    read = read.select("doc_id", "text", "p", F.when(some, F.array_join(p, " ")).alias("joined"), F.when(some, at).alias("at"))
    joined = F.col("joined")
    runs = F.flatten(
        F.transform(
            "at",
            lambda s, i: F.when(
                F.get(p, i).rlike(begins),
                F.transform(
                    F.filter("at", lambda e: (e - s - 1).isin(lengths) & (e - s - 1 > F.length(F.get(p, i))) & (e - s - 1 < F.length(joined))),
                    lambda e: F.substring(joined, s, e - s - 1),
                ),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    units = F.concat(
        unit("document", F.array(canonical(text))),
        # a document of one paragraph, or a paragraph of one line, is counted as the larger unit and the smaller
        unit("paragraph", p),
        unit("paragraphs", F.coalesce(runs, F.array().cast("array<string>"))),
        unit("line", F.transform(F.split(text, "\n", -1), canonical)),
    )
    rows = read.select("doc_id", F.explode(F.filter(units, lambda u: u["c"] != "")).alias("u"))
    rows = rows.select("doc_id", "u.unit", F.sha2(F.col("u.c").cast("binary"), 256).alias("digest"))
    return rows.join(F.broadcast(known_digests(docs.sparkSession, known)), "digest").groupBy("doc_id", "license", "unit").agg(F.count(F.lit(1)).alias("n"))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{RIGHTS}', '', 'g')"
    for a, b in SAME:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


#: The same as scan over documents, for DuckDB.
SQL = (
    "WITH k AS (SELECT sha256(" + _sql_canonical("t") + ") AS digest, arg_min(license, i) AS license FROM (VALUES "
    + ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(KNOWN))
    + ") v(i, license, t) GROUP BY 1), u AS (SELECT doc_id, 'document' AS unit, text AS t FROM documents WHERE text IS NOT NULL"
    " UNION ALL SELECT doc_id, 'paragraph', unnest(string_split_regex(text, '\\n[ \\t]*\\n')) FROM documents WHERE text IS NOT NULL"
    " UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL),"
    " c AS (SELECT doc_id, unit, " + _sql_canonical("t") + " AS c FROM u)"
    " SELECT doc_id, license, unit, count(*) AS n FROM c JOIN k ON k.digest = sha256(c) WHERE c <> '' GROUP BY 1, 2, 3"
)
