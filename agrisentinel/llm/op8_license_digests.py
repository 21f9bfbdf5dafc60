"""Licence scan by canonical digests.

A text is brought to a canonical form - lower case; lines that state a copyright
left out; equivalent spellings unified; punctuation, markup and white space
reduced to single blanks - and its SHA-256 is hash-joined to the digests of known
licence texts.  Candidates are a document's entire text, each of its paragraphs
(between blank lines) and each of its lines, so a licence is found wherever it
stands as an entire block.

Known are the notices of ``KNOWN`` and the full texts of ``licenses/`` (one file a
licence, named by its SPDX id), these with and without title and appendix.

Only DataFrame expressions are used.  The table of known digests is of fixed
size and broadcast; documents are not shuffled.  Null or empty texts and blocks
without letters or digits match nothing; rows with repeated or null ids are
scanned row by row; extra columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import broadcast_if_small, materialise

# Known licence texts and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]

TEXTS = Path(__file__).with_name("licenses")
END = "END OF TERMS AND CONDITIONS"
# Titles that license files put above a text that has none itself.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "BSD-3-Clause": ["BSD License", "The BSD License", "BSD 3-Clause License", "The 3-Clause BSD License",
                     "BSD 3-Clause", "New BSD License", "Modified BSD License", "Revised BSD License",
                     'BSD 3-Clause "New" or "Revised" License'],
    "BSD-2-Clause": ["BSD License", "The BSD License", "BSD 2-Clause License", "The 2-Clause BSD License",
                     "BSD 2-Clause", "Simplified BSD License", "FreeBSD License", 'BSD 2-Clause "Simplified" License'],
}


def _bsd(text: str) -> list[tuple[str, str]]:
    """The Regents' text, its form for any holder, and that without the third clause; with and without numbers."""
    holder = (text.replace("the University", "the copyright holder").replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND")
                  .replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR"))
    two = re.sub(r"(?ms)^3\. .*?\n\n", "\n", holder)
    forms = [("BSD-3-Clause", text), ("BSD-3-Clause", holder), ("BSD-2-Clause", two)]
    return forms + [(name, re.sub(r"(?m)^[123]\. ", "* ", form)) for name, form in forms]


def full_texts() -> list[tuple[str, str]]:
    """``(license, text)`` of the full texts and their variants."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        if path.stem == "BSD-3-Clause":
            out += _bsd(text)
            continue
        # a filled-in copyright line falls away in the canonical form, its blank form would not
        forms = [text, re.sub(r"(?m)^ *Copyright \[yyyy\].*$", "", text)]
        if END in text:
            forms += [text[: text.index(END)], text[: text.index(END) + len(END)]]
        out += [(path.stem, form) for form in dict.fromkeys(forms)]
    bare = [("MIT", MIT), ("ISC", ISC), *out]
    return out + [(name, f"{title}\n\n{text}") for name, text in bare for title in TITLES.get(name, ())]


# Equivalent spellings, as words of the canonical form.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("organisation", "organization"),
    ("fulfil", "fulfill"), ("authorised", "authorized"), ("favour", "favor"), ("programme", "program"),
    ("centre", "center"), ("acknowledgement", "acknowledgment"), ("owner s", "owners"), ("https", "http"),
]
COPYRIGHT_LINE = r"(?m)^[\W_]*(copyright( \(c\)|:| [0-9]| ©)|\(c\) [0-9]|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, "[^a-z0-9]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null where that is empty."""
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    rows = spark.createDataFrame(known, "license string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "license").distinct()


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, whole_license, n_blocks, licenses`` per row: licence of the entire
    text, how many of its blocks are licences, and which (sorted)."""
    known = materialise(known if known is not None else known_digests(docs.sparkSession, KNOWN + full_texts()), "op8-known")
    known = broadcast_if_small(known, 128)
    text = F.col(text_col)
    blocks = F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[\x20\x09-\x0D]*\n"), F.split(text, "\n")))
    parts = (docs.where(text.isNotNull())
                 .select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("whole"),
                         F.explode(blocks).alias("block"))
                 .select("id", "tkey", (F.col("block") == F.col("whole")).alias("is_whole"), digest(F.col("block")).alias("digest")))
    hits = (parts.join(known, "digest").groupBy("id", "tkey")
                 .agg(F.max(F.when(F.col("is_whole"), F.col("license"))).alias("whole_license"),
                      F.countDistinct("digest").alias("n_blocks"),
                      F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses")))
    hits = broadcast_if_small(materialise(hits, "op8-hits"), 96)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_tkey"))
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_tkey") == F.col("tkey")), "left").select(
        "doc_id", "whole_license", F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
        F.coalesce("licenses", F.lit("")).alias("licenses"))
