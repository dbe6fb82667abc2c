"""License scans (operator 5, native): canonical digest lookup.

A text and the known licences are brought to one canonical form, and the
SHA-256 digests of the entire canonical texts are joined by hash:

* case: lower case;
* copyright lines (a line that begins with "copyright", "(c)" or the
  copyright sign, or is "all rights reserved") are dropped;
* punctuation: quotation marks, dashes, bullets and every other character
  that is neither letter nor digit become a separator;
* equivalent spellings (``SPELLINGS``) become one;
* runs of separators become one space, ends trimmed.

The known licences are a fixed table: the short texts below and the files of
``licenses/`` (named by their id), each in the forms of ``license_forms``.

Two lookups use the same function and the same digests: the entire text of a
document (``license_id``: the document is a copy of that licence) and each of
its lines (``notice_ids``: the document names a licence in a notice line).

Only built-in SQL functions run; the licence table is a small DataFrame given
by the caller or ``known_licenses`` (its size is fixed by the code), joined by
digest; Spark broadcasts it by its own size check, so a line that half of the
corpus carries is never gathered in one task.

Null and empty texts match nothing (``license_id`` null, no notices).  When
several licences share a canonical text, the smallest id is reported.
Repeated doc_ids are reported once per row for the text, and their notices
are pooled by doc_id.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.tables import read_table, with_columns_free

# Spellings that licence texts use for one word.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("sublicence", "sublicense"), ("non commercial", "noncommercial"), ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("merchantibility", "merchantability"), ("organisation", "organization"), ("whilst", "while"),
    ("ver", "version"), ("v2", "version 2"), ("v3", "version 3"),
]

# Full texts of short public licences.
LICENSE_TEXTS = {
    "MIT": (
        "MIT License\n\nCopyright (c) <year> <holder>\n\n"
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
        "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "ISC License\n\nCopyright (c) <year> <holder>\n\n"
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Copyright (c) <year>, <holder>\nAll rights reserved.\n\n"
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
        "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
        "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "zlib License\n\nCopyright (c) <year> <holder>\n\n"
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the "
        "original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required.\n\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software.\n\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
}

_MIT_CONDITION = re.compile(r", subject to the following conditions:.*?portions of the Software\.", re.S)
_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE"
)

# Licences whose words are those of another but for a paragraph.
LICENSE_TEXTS |= {
    "BSD-3-Clause": LICENSE_TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE", _ENDORSEMENT, 1),
    "0BSD": LICENSE_TEXTS["ISC"].partition("\n\n")[2].replace(
        ", provided that the above copyright notice and this permission notice appear in all copies", ""),
    "MIT-0": _MIT_CONDITION.sub(".", LICENSE_TEXTS["MIT"].partition("\n\n")[2]),
}

# Headings under which the short texts are given, or none.
LICENSE_HEADINGS = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "The BSD 2-Clause License",
                     "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "The BSD 3-Clause License",
                     "New BSD License", "BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License"],
}

# One-line notices that name a licence.
LICENSE_NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
}

_COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright\b|\(c\)|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form of a text (a single space on each side, so that
    spellings are replaced as whole words)."""
    c = F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, " ")
    c = F.concat(F.lit(" "), F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for spelling, word in SPELLINGS:
        c = F.replace(c, F.lit(f" {spelling} "), F.lit(f" {word} "))
    return F.trim(F.regexp_replace(c, " +", " "))


def license_forms() -> list[tuple[str, str]]:
    """(license_id, text) of every form of the full texts: short texts under
    each heading and none, with and without numbers before the clauses; long
    texts with and without what follows their terms; addresses with http and
    https."""
    forms = set()
    for name, text in LICENSE_TEXTS.items():
        heading, _, body = text.partition("\n\n")
        if heading not in LICENSE_HEADINGS[name]:
            body = text
        for clauses in (body, re.sub(r"(?m)^\d\. ", "", body)):
            forms |= {(name, f"{h}\n\n{clauses}") for h in ["", *LICENSE_HEADINGS[name]]}
    for file in (files("loanscope.llm") / "licenses").iterdir():
        text = file.read_text("utf-8")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        for t in (text, terms + end, terms):
            forms |= {(file.name.removesuffix(".txt"), t.replace(a, b))
                      for a, b in (("http://", "https://"), ("https://", "http://"))}
    return sorted(forms)


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id, text: full texts and notices."""
    rows = license_forms() + [(k, n) for k, ns in LICENSE_NOTICES.items() for n in ns]
    return spark.createDataFrame(rows, "license_id string, text string")


def license_digests(licenses: DataFrame) -> DataFrame:
    """license_id per digest of the canonical text."""
    c = canonical(F.col("text"))
    return (
        licenses.select("license_id", c.alias("c")).filter("c <> ''")
        .groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    )


def license_scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, license_id (the licence whose entire
    text the document is, or null), notice_ids (licences named by a line,
    sorted), canonical_sha256 (null without canonical text)."""
    rows = with_columns_free(docs, id_col, text_col)
    known = license_digests(licenses)
    whole = rows.select("doc_id", canonical(F.col("text")).alias("c")).select(
        "doc_id", F.when(F.col("c") != "", F.sha2("c", 256)).alias("digest")
    )
    lines = (
        rows.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
        .select("doc_id", F.sha2(canonical(F.col("line")), 256).alias("digest"))
        .join(known, "digest")
        .groupBy("doc_id").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))
    )
    return (
        whole.join(known, "digest", "left")
        .join(lines, "doc_id", "left")
        .select(
            "doc_id", "license_id",
            F.concat_ws(",", "notices").alias("notice_ids"),
            F.col("digest").alias("canonical_sha256"),
        )
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"), known_licenses(spark))


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE = {}
