"""Licence scan by canonical digest (DataFrame functions only on the main path).

A text is brought to a canonical form: lower case, copyright lines (with a year,
sign or holder), "all rights reserved" lines and title lines at the start
dropped, equivalent spellings made one, everything but letters and digits
turned to single blanks. The SHA-256 of that form is
hash-joined to the digests of known licence texts, for the whole text of every
document, and for each of its lines (where a licence notice stands alone).

Known texts come as a table (licence, text), so that digests are computed by
the same expressions on both sides. The built-in ones are KNOWN, the files of
license_texts (full texts, with and without what follows their terms), the BSD
texts, and one-line notices of NAMES; other texts are passed by the caller.

Defined cases: null text matches nothing; a text without letter or digit
(after dropping copyright lines) has an empty form and matches nothing; two
known licences with one form report the smaller name; repeated rows report
each, every one the lines of its own text; a null doc_id is a row like any other;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices of public licences, by licence identifier.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
]

# Equivalent spellings, British to American and variants.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("recognised", "recognized"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("ver", "version"),
    ("v2", "version 2"),
    ("v3", "version 3"),
    ("https", "http"),
]
# Names that one-line notices give, by licence identifier.
NAMES = {
    "MIT": ["the MIT License", "MIT", "the MIT license (MIT)", "the Expat License"],
    "ISC": ["the ISC License", "ISC"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License", "BSD-3-Clause"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0", "Apache-2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"],
} | {f"MPL-{v}": [f"the Mozilla Public License, version {v}", f"the Mozilla Public License {v}", f"MPL {v}", f"MPL-{v}"] for v in ("1.1", "2.0")} | {
    f"{p}GPL-{v}": [f"the GNU {k}General Public License, version {w}" for w in {v, v.removesuffix(".0")}] + [f"the GNU {k}General Public License v{v.removesuffix('.0')}", f"{p}GPLv{v.removesuffix('.0')}", f"{p}GPL {v}", f"{p}GPL-{v}"]
    for p, k, versions in (("", "", ("1.0", "2.0", "3.0")), ("L", "Lesser ", ("2.1", "3.0")), ("L", "Library ", ("2.0",)), ("A", "Affero ", ("3.0",))) for v in versions
} | {
    f"CC-{k}-{v}": [f"CC {k} {v}", f"CC-{k}-{v}", f"a Creative Commons {name} {v} International License", f"the Creative Commons {name} {v} International License"]
    for k, name in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items() for v in ("3.0", "4.0")
}
LEADS = ["Licensed under", "Released under", "Distributed under", *[f"This {x} is {y} under" for x in ("work", "software", "project", "program", "file", "document") for y in ("licensed", "released", "distributed")]]

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY THE {who} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {whom} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = "3. Neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_WHO = [("COPYRIGHT HOLDERS AND CONTRIBUTORS", f"COPYRIGHT {x} OR CONTRIBUTORS") for x in ("HOLDER", "OWNER", "HOLDERS")] + [("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS")]
_NAME = ["the copyright holder", "the copyright holders", "the University", "the organization"]
#: The terms of a full text end here; what follows says how to apply them.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


SALTS = 16


def built_in() -> list[tuple[str, str]]:
    """(licence, text) of all built-in texts."""
    out = KNOWN + [(k, f"{lead} {terms}{name}") for k, names in NAMES.items() for name in names for lead in LEADS for terms in ("", "the terms of ")]
    for who, whom in _WHO:
        out.append(("BSD-2-Clause", _BSD.format(third="", who=who, whom=whom)))
        out += [("BSD-3-Clause", _BSD.format(third=_THIRD.format(name=name), who=who, whom=whom)) for name in _NAME]
    for file in sorted(Path(__file__).with_name("license_texts").glob("*.txt")):
        text = file.read_text("utf-8")
        terms, mark, rest = text.partition(END_OF_TERMS)
        out += [(file.stem, t) for t in dict.fromkeys([text, terms + mark, terms])]
    return out


#: A line that only states a copyright (a sign, year or holder after the word) or "all rights reserved". What terms say of copyright stays, however wrapped.
OWNER_LINE = (
    r"(?m)^[ \t#*/;%.-]*(?:(?i:(?:copyright|\(c\))[ \t:]*(?:(?:\(c\)|©|copyright\b)[^\n]*|[<\[{(]?(?:\d{4}|yyyy|year)\b[^\n]*))|©[^\n]*"
    r"|Copyright[ \t]+(?:by[ \t]+)?(?!(?:Notices?|Holders?|Owners?|Licen[cs]es?|Laws?|Statements?|Disclaimers?|Act)\b)[A-Z][^\n]*|(?i:all rights reserved)[.!]?[ \t]*)$"
)
#: Lines at the start of a longer text that only name its licence.
TITLE = (
    r"(?i)\A(?:[\W_]*(?:the[ \t]+)?(?:(?:mit|expat|x11|mit/x11|isc|apache|mozilla public|gnu (?:(?:lesser|library|affero) )?general public|gnu free documentation"
    r"|(?:(?:new|modified|revised|simplified) )?\"?bsd(?:[ -][23][ -]clause)?\"?|[23][ -]clause bsd)[ \t]+licen[cs]e)(?:,?[ \t]+(?:version[ \t]+|v)?\d(?:\.\d)?)?[ \t]*(?:\([^)\n]*\))?[^\w\n]*\n)+(?=[\W_]*\w)"
)
#: A line that only states a copyright or "all rights reserved", as the SQL has it.
COPYRIGHT_LINE = r"(?im)^[\s#*/;%-]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"


def canonical_form(text: Column) -> Column:
    """Letters and digits of the text in lower case, one blank between words, spellings made one."""
    out = F.lower(F.regexp_replace(F.regexp_replace(text, OWNER_LINE, " "), TITLE, " "))
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  ")  # each word gets two blanks of its own
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null for an empty one."""
    form = canonical_form(text)
    return F.when(form != "", F.sha2(F.encode(form, "UTF-8"), 256))


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, licence) of the known texts, one row a digest."""
    texts = texts if texts is not None else spark.createDataFrame(built_in(), "licence string, text string")
    return texts.select(digest(F.col("text")).alias("digest"), "licence").where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("licence").alias("licence"))


def could_match(text: Column) -> Column:
    """A necessary condition, cheap to test on every line: all known texts name one of these words, or are notices."""
    return text.rlike(r"(?i)licen[cs]|permission|redistribut|(?:released|distributed) under")


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, digest of the whole text, its licence, and the licences of single lines.

    Lines are hashed at the scan and only digests are joined. What lines say of
    a text is found once a text, and reaches its rows by 128 bits of hash, dealt
    out over SALTS keys, so that rows of one text or one doc_id part. With the
    built-in texts, lines that cannot match are not hashed; with the caller's,
    all are.
    """
    spark = docs.sparkSession
    known = known_digests(spark, texts)
    if texts is None:
        known = F.broadcast(known)  # as long as the built-in list
    name = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text", F.lit("#")).alias("h2")]
    lines = docs.select(*name, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    if texts is None:
        lines = lines.where(could_match(F.col("line")))
    hits = lines.select("h1", "h2", "pos", digest(F.col("line")).alias("digest")).where(F.col("digest").isNotNull()).join(known, "digest")
    by_text = hits.groupBy("h1", "h2").agg(F.collect_set(F.struct("pos", "licence")).alias("hits"))
    salted = by_text.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = docs.select("doc_id", *name, digest(F.col("text")).alias("digest")).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    out = rows.join(known.withColumnRenamed("licence", "whole_licence"), "digest", "left").join(salted, ["h1", "h2", "salt"], "left")
    return out.select(
        "doc_id",
        "digest",
        "whole_licence",
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.col("hits.licence"))), ","), F.lit("")).alias("line_licences"),
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_licence_lines"),
    )
