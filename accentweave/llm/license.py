"""Licence scans by canonical digests.

Method. A text is made canonical: case folded, copyright lines removed, equivalent spellings replaced,
punctuation turned into spaces, spaces collapsed. The SHA-256 of what remains is joined to the digests
of known licences made canonical in the same way. Two kinds of whole text are looked up: the whole
document, and every whole line of it (a licence notice is a one-line text). A document that is no known
text is looked up once more by its body, which is the text without licence titles and "all rights reserved" on
lines of their own; known texts are reduced to bodies likewise. Only DataFrame functions are used.

Edge cases. A null text has a null digest and no notices. An empty text, or one with nothing but
copyright lines, has the digest of the empty string, which no licence has. Lines are counted with their
repeats. Rows with the same ``doc_id`` share their notices unless they are asked for by row; rows with a null ``doc_id`` are kept,
their notices are counted together. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stash

# Notice lines and short licences by SPDX name.
NOTICES = [
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
]
LICENCES = [
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n'
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
]
# Spellings that count as one, after case is folded and punctuation is gone.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
]
# Lines that are nothing but a licence's title, in canonical form.
TITLES = [
    r"(the )?(mit|mit x11|x11|expat|isc|zlib|zlib libpng|0bsd|bsd)( license)( (mit|isc|zlib|expat|0bsd))?",
    r"(the )?(new |modified |simplified |revised )?bsd( [0023])?( clause)?( simplified| new or revised| new| revised| modified)?( license)",
    r"(the )?[23] clause bsd license",
    r"(bsd )?zero clause bsd( license)?( 0bsd)?",
    r"bsd zero clause license( 0bsd)?",
    r"(the )?apache license( version 2 0)?( january 2004)?",
    r"version 2 0 january 2004",
    r"https? www apache org licenses( license 2 0)?",
    r"gnu general public license( version [23])?( (june 1991|29 june 2007))?",
    r"version (2 june 1991|3 29 june 2007)",
    r"mozilla public license( version)? 2 0",
    r"creative commons legal code",
    r"(creative commons )?cc0 1 0 universal",
    r"(creative commons )?attribution( sharealike)? 4 0 international( public license)?",
]
# One of these is in every title line, so that most texts need no search for them.
_TITLE_WORDS = ("license", "all rights reserved", "january 2004", "june 1991", "june 2007", "legal code", "cc0 1 0", "zero clause bsd", "4 0 international")
TEXTS = Path(__file__).with_name("licences")
_TERMS_END = "END OF TERMS AND CONDITIONS"

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»–—…©\t\r\x0b\x0c\xa0"
_COPYRIGHT = r"(?m)^[ \t\r]*(copyright\b(?! notice| holder| owner)|\(c\)|©)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """The text with each line canonical: words of letters and digits, one space around each."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, "")
    out = F.translate(out, _PUNCTUATION, " " * len(_PUNCTUATION))
    out = F.concat(F.lit(" "), F.regexp_replace(F.replace(out, F.lit("\n"), F.lit(" \n ")), " {2,}", " "), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return out


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def _titled(lines: Column) -> Column:
    """Whether some line may be a title."""
    out = F.lit(False)
    for words in _TITLE_WORDS:
        out = out | lines.contains(words)
    return out


def body_lines(lines: Column) -> Column:
    """Canonical lines without those that are only a licence's title or "all rights reserved"."""
    return F.when(_titled(lines), F.regexp_replace(lines, f"(?m)^ *(?:{'|'.join(TITLES)}|all rights reserved) *$", "")).otherwise(lines)


def full_texts() -> list[tuple[str, str]]:
    """Licences as they are usually laid down: with and without what follows their terms, and with bare list items."""
    out = [(path.stem, path.read_text(encoding="utf-8")) for path in sorted(TEXTS.glob("*.txt"))]
    out += [(name, text[: text.index(_TERMS_END)] + end) for name, text in out if _TERMS_END in text for end in ("", _TERMS_END)]
    return out + [(name, re.sub(r"(?m)^ *[1-9]\.", "", text)) for name, text in out + LICENCES if name.startswith("BSD-")]


def known_licences(spark: SparkSession, known: DataFrame | None = None, body: bool = False) -> DataFrame:
    """``(digest, chars, license_id)`` of ``known(license_id, text)`` or of the fixed list, one row per digest.

    With ``body`` digests are those of the bodies.
    """
    if known is None:
        known = spark.createDataFrame(NOTICES + LICENCES + full_texts(), "license_id string, text string")
    lines = canonical_lines(F.col("text"))
    canon = known.select("license_id", whole(body_lines(lines) if body else lines).alias("canon")).where("canon <> ''")
    return canon.groupBy(F.sha2("canon", 256).alias("digest"), F.length("canon").alias("chars")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, by_row: bool = False) -> DataFrame:
    """``(doc_id, digest, license_id, notices, n_notices)``, a row for each row of ``docs(doc_id, text)``.

    ``digest`` is that of the whole text and ``license_id`` the licence that the text or else its body is; ``notices`` joins by commas the distinct licences
    that whole lines of it are, ``n_notices`` counts those lines; with ``by_row`` they are each row's own, else all of the ``doc_id``'s. ``known(license_id, text)`` defaults to
    the fixed list, which is broadcast; a line is then hashed only if its length is that of some known text, as no
    other can be equal. A table that is given is joined as Spark sees fit.

    Texts are made canonical once; what is written to the shared folder and read from there on are digests.
    """
    spark = docs.sparkSession
    table = known_licences(spark, known)
    bodies = known_licences(spark, known, body=True)
    lines = F.col("lines")
    trimmed = F.transform(F.split(lines, "\n"), lambda x: F.trim(x))
    if known is None:
        table, bodies = F.broadcast(table), F.broadcast(bodies)
        lengths = [r["chars"] for r in table.select("chars").distinct().collect()]  # of the fixed list
        trimmed = F.filter(trimmed, lambda x: F.length(x).isin(lengths))
    # As row numbers are not to be worked out twice, the optimizer leaves these two steps apart, and lines are made once.
    canon = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), canonical_lines(F.col("text")).alias("lines"))
    body = F.when(_titled(lines), F.sha2(whole(body_lines(lines)), 256))
    narrow = canon.select("row", "doc_id", F.sha2(whole(lines), 256).alias("digest"), body.alias("body"), F.transform(trimmed, lambda x: F.sha2(x, 256)).alias("line_digests"))
    base, _ = stash(narrow, "licence-digests")
    key = "row" if by_row else "doc_id"
    hits = base.select(key, F.explode("line_digests").alias("digest")).join(table.select("digest", "license_id"), "digest")
    notices = hits.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"), F.count("*").alias("n_notices"))
    texts = base.select("row", "doc_id", "digest", F.coalesce("body", "digest").alias("body"))
    found = texts.join(table.select("digest", "license_id"), "digest", "left").join(bodies.select(F.col("digest").alias("body"), F.col("license_id").alias("body_id")), "body", "left")
    found = found.select("row", "doc_id", "digest", F.coalesce("license_id", "body_id").alias("license_id"))
    return (
        found.alias("d")
        .join(notices.alias("n"), F.col(f"d.{key}").eqNullSafe(F.col(f"n.{key}")), "left")
        .select("d.doc_id", "d.digest", "d.license_id", F.coalesce("n.notices", F.lit("")).alias("notices"), F.coalesce("n.n_notices", F.lit(0)).cast("long").alias("n_notices"))
    )
