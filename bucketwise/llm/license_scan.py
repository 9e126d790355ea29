"""License scan by canonical digests.

A text is brought to a canonical form: lower case; lines that state a copyright or reserve all rights left out; spellings
that mean the same made equal; every run of other characters than letters and digits made one space. Digests of whole
texts, and of each of their lines, are hash-joined with the digests of known licences and notices, canonicalised by the
same expressions. Two texts match if and only if their canonical forms are equal.

Only DataFrame functions run. A line meets the known digests where it lies: the list of known texts is a parameter and
bounds what is broadcast, and Spark chooses the join by its size.

Defined cases: null text is empty; a text whose canonical form is empty matches nothing; a document's licences are counted
once per line; repeated rows are scanned one by one; ids of any kind come back as they are; other columns take no part.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bucketwise.llm.textkit import only, table

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
#: whole licence texts, a file per SPDX name
_TEXTS = Path(__file__).parent / "licenses"
_END = "END OF TERMS AND CONDITIONS"
_GNU = {"GPL": "General Public", "LGPL": "Lesser General Public", "AGPL": "Affero General Public"}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
       "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: fixed values: customary names by SPDX name
_NAMES = {
    "MIT": ("MIT License", "MIT", "Expat License"), "ISC": ("ISC License", "ISC"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License", "0BSD"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"),
    "Unlicense": ("Unlicense",), "Zlib": ("zlib License",), "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 1.0", "CC0"),
    **{f"MPL-{v}": (f"Mozilla Public License, Version {v}", f"Mozilla Public License, v. {v}", f"Mozilla Public License {v}", f"MPL {v}")
       for v in ("1.1", "2.0")},
    **{f"{k}-{v}": tuple(
        f"{name}{version}" for name, short in ((f"GNU {long} License", False), (f"GNU {k}", True), (k, True))
        for n in {v, v.removesuffix(".0")}
        for version in (f" v{n}", f" {n}", f", version {n}", f" version {n}") if not (short and "version" in version))
       for k, long in _GNU.items() for v in ("2.0", "2.1", "3.0") if (k, v) in
       {("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")}},
    **{f"CC-{k}-{v}": tuple(
        f"{name}{kind}" for name in (f"Creative Commons {long} {v}", f"CC {k} {v}")
        for kind in ("", " License", f" {'International' if v == '4.0' else 'Unported'}", f" {'International' if v == '4.0' else 'Unported'} License"))
       for k, long in _CC.items() for v in ("3.0", "4.0")},
}
_PHRASES = ("Licensed under {}", "Released under {}", "Distributed under {}", "License: {}",
            *(f"This {what} is licensed under {{}}" for what in ("work", "project", "software")))


def _notices() -> tuple[tuple[str, str, str], ...]:
    """Every customary phrase with every name, and the SPDX tags."""
    out = {}
    for license_, names in _NAMES.items():
        for name in names:
            for phrase in _PHRASES:
                for article in (("", "the ") + (("a ",) if license_.startswith("CC-") else ())) if "under" in phrase else ("",):
                    text = phrase.format(article + name) + "."
                    out.setdefault(re.sub(r"[^a-z0-9]+", " ", text.lower()), (license_, "notice", text))
        for tail in ("", "-only", "-or-later") if license_.split("-")[0] in _GNU else ("",):
            text = f"SPDX-License-Identifier: {license_}{tail}"
            out[text] = (license_, "tag", text)
    return tuple(out.values())


def _whole_texts() -> tuple[tuple[str, str, str], ...]:
    """The texts of the files, with and without what follows the end of the terms."""
    out = []
    for path in sorted(_TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, "text", text))
        if _END in text:
            out.append((path.stem, "text", text[: text.index(_END)]))
            out.append((path.stem, "text", text[: text.index(_END) + len(_END)]))
    return tuple(out)


#: fixed values: public licence texts and customary notices, by SPDX name and form
_LISTED = (
    ("MIT", "text",
     "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software.\n\n" + _WARRANTY),
    ("ISC", "text",
     "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", "text",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted.\n\n" + _ISC_WARRANTY),
    ("Apache-2.0", "header",
     'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
     "License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by "
     'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
     "governing permissions and limitations under the License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "This project is licensed under the MIT License."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "notice", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Apache-2.0", "tag", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "tag", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "tag", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "tag", "SPDX-License-Identifier: BSD-3-Clause"),
)
KNOWN = _LISTED + _whole_texts() + _notices()
#: fixed values: spellings that mean the same, by the public matching guidelines for licence texts
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("honour", "honor"), ("judgement", "judgment"), ("non-commercial", "noncommercial"), ("per cent", "percent"), ("analogue", "analog"), ("whilst", "while"),
    ("copyright owner", "copyright holder"), ("fulfilment", "fulfillment"), ("programme", "program"),
)

#: a line that states a copyright or reserves all rights, with the line break before it
_COPYRIGHT = (
    r"(?:^|\n)[ \t#*/;]*(?:(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|[<\[{])|(?:\(c\)|©)[ \t]*[0-9]{4})[^\n]*"
    r"|all rights reserved[. \t]*(?:\n|$))"
)
#: everything but ASCII letters and digits, letters of other scripts and line breaks
_OTHER = r"[^a-z0-9\n\x{C0}-\x{1FFF}\x{2C00}-\x{10FFFF}]+"


def canonical_lines(text: Column) -> Column:
    """Canonical text with its line breaks, each line still untrimmed."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT, "\n")
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return F.regexp_replace(out, _OTHER, " ")


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str, str], ...] = KNOWN) -> DataFrame:
    """digest, license: one row per canonical text of ``known``."""
    # one literal, however many texts there are
    rows = F.split(F.lit("\x01".join(f"{name}\x02{text}" for name, _, text in known)), "\x01")
    pair = F.struct(F.split("k", "\x02")[0].alias("license"), F.split("k", "\x02")[1].alias("text"))
    return (
        spark.range(1).select(F.explode(rows).alias("k")).select(pair.alias("k"))
        .select(F.sha2(whole(canonical_lines(F.col("k.text"))), 256).alias("digest"), F.col("k.license").alias("license"))
        .groupBy("digest").agg(F.min("license").alias("license"))
    )


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: tuple[tuple[str, str, str], ...] = KNOWN
) -> DataFrame:
    """id, canonical_sha256, text_license (of the whole text), n_notices (lines), licenses (of text and lines, by comma).

    Lines are exploded, joined and summed up again before anything is shuffled, so the shuffle has a row per document.
    """
    spark = docs.sparkSession
    names = sorted({name for name, _, _ in known})
    digests = known_digests(spark, known)
    bit = F.element_at(F.create_map(*[v for i, n in enumerate(names) for v in (F.lit(n), F.lit(i))]), F.col("license"))
    words = -(-len(names) // 63)
    of_line = digests.select(
        F.col("digest").alias("line"), F.lit(True).alias("hit"),
        *[
            F.when(F.floor(bit / 63) == w, F.pow(F.lit(2.0), bit % 63).cast("long")).otherwise(F.lit(0).cast("long")).alias(f"w{w}")
            for w in range(words)
        ],
    )
    of_text = digests.select(F.col("digest").alias("canonical_sha256"), F.col("license").alias("text_license"))
    lines = only(docs, id=id_col, text=text_col).select("id", canonical_lines(F.col("text")).alias("lines"))
    # the digest of the whole text is taken before the lines are exploded, once per document
    digested = lines.select("id", F.sha2(whole(F.col("lines")), 256).alias("canonical_sha256"), "lines")
    exploded = digested.select(
        "id", "canonical_sha256", F.posexplode(F.split("lines", "\n")).alias("at", "line")
    ).withColumn("line", F.sha2(F.trim("line"), 256))
    summed = exploded.join(of_line, "line", "left").groupBy("id", "canonical_sha256").agg(
        F.sum((F.col("at") == 0).cast("long")).alias("copies"), F.count("hit").alias("hits"),
        *[F.bit_or(F.coalesce(f"w{w}", F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)],
    )
    present = [
        F.when(F.col(f"w{i // 63}").bitwiseAND(F.lit(1 << (i % 63)).cast("long")) != 0, F.lit(n))
        .when(F.col("text_license") == n, F.lit(n))
        for i, n in enumerate(names)
    ]
    return (
        summed.join(of_text, "canonical_sha256", "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(
            "id", "canonical_sha256", "text_license", F.expr("hits div copies").alias("n_notices"),
            F.concat_ws(",", *present).alias("licenses"),
        )
    )


def _sql() -> str:
    quoted = lambda t: t.replace("'", "''")
    spell = f"regexp_replace(lower(coalesce(text, '')), '{_COPYRIGHT}', chr(10), 'g')"
    for one, other in SPELLINGS:
        spell = f"replace({spell}, '{one}', '{other}')"
    canonical = f"regexp_replace({spell}, '{_OTHER}', ' ', 'g')"
    of_whole = "sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g')))"
    known = ", ".join(f"('{quoted(n)}', '{quoted(t)}')" for n, _, t in KNOWN)
    return f"""
WITH k AS (SELECT {of_whole} AS digest, min(name) AS name
           FROM (SELECT name, {canonical} AS lines FROM (VALUES {known}) AS v(name, text)) GROUP BY 1),
d AS (SELECT doc_id, lines, {of_whole} AS canonical_sha256 FROM (SELECT doc_id, {canonical} AS lines FROM documents)),
l AS (SELECT doc_id, sha256(trim(unnest(string_split(lines, chr(10))))) AS digest FROM d),
h AS (SELECT doc_id, name FROM l JOIN k USING (digest)),
n AS (SELECT doc_id, count(*) AS n_notices FROM h GROUP BY 1),
a AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses
      FROM (SELECT doc_id, name FROM h UNION SELECT doc_id, name FROM d JOIN k ON k.digest = canonical_sha256) GROUP BY 1)
SELECT d.doc_id, canonical_sha256, k.name AS text_license, coalesce(n_notices, 0)::BIGINT AS n_notices,
       coalesce(licenses, '') AS licenses
FROM d LEFT JOIN k ON k.digest = canonical_sha256 LEFT JOIN n USING (doc_id) LEFT JOIN a USING (doc_id)
"""


SQL = _sql()


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
