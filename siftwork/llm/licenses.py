"""License scans by canonical digest.

A text is brought to one spelling: lower case, no copyright lines, equivalent
words alike, everything but letters and digits one blank.  Two texts with one
canonical form have one SHA-256 digest, so finding known licences is a hash join
of entire texts with a table of digests, whatever the number of either.  Lines
that speak of a licence are texts of their own and are joined in the same way, to
digests of known notices.

Defined results: null and empty texts, and texts of nothing but copyright lines,
have the digest of the empty form and match nothing; of two licences with one
digest the first by name is given; repeated rows keep their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.common import ascii_lower, saved, small_enough

#: Patterns and spellings of the canonical form.
COPYRIGHT_LINE = (r"(^|\n)[^a-z0-9\n]*((copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9<\[{])[^\n]*"
                  r"|all rights reserved[^a-z0-9\n]*)")
SPELLINGS = (("licence", "license"), ("organisation", "organization"), ("merchantibility", "merchantability"),
             ("non-infringement", "noninfringement"), ("copyright owner", "copyright holder"),
             ("https://", "http://"), ("&", " and "))
TYPOGRAPHIC = "‘’“”–—…«»•"
NOT_WORDS = r"[\x00-/:-`{-\x7f]+"
NOTICE = "license"


def canonical(text: Column) -> Column:
    text = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    for one, other in SPELLINGS:
        text = F.replace(text, F.lit(one), F.lit(other))
    text = F.translate(text, TYPOGRAPHIC, " " * len(TYPOGRAPHIC))
    return F.btrim(F.regexp_replace(text, NOT_WORDS, " "), F.lit(" "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


#: Whole licence texts, without title and copyright line.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
#: Titles that may stand above a licence text.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"),
          "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
          "BSD-2-Clause": ("BSD 2-Clause License", 'The 2-Clause BSD License', "Simplified BSD License")}
#: Names in notices, without article.
NAMES = {
    "MIT": ("MIT License", "MIT/Expat License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "Modified BSD License", "BSD-3-Clause"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
}
SAYINGS = ("Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}",
           "This work is licensed under {}", "This project is licensed under {}",
           "This software is released under {}", "License: {}", "SPDX-License-Identifier: {}")


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of the licences that come with the library, with and
    without a title."""
    return [(name, text) for name, body in TEXTS.items()
            for text in (body, *(f"{t}\n\n{body}" for t in TITLES[name]))]


def known_notices() -> list[tuple[str, str]]:
    """(license, notice): every saying with every name, with and without article."""
    return [(name, say.format(article + called)) for name, names in NAMES.items()
            for called in names for say in SAYINGS for article in ("", "the ")]


def digests(rows: DataFrame, text: str = "text") -> DataFrame:
    """(digest, license), one row for each digest, of a table (license, text)."""
    return rows.select("license", digest(F.col(text)).alias("digest")).where(
        F.col("digest") != F.sha2(F.lit(""), 256)).groupBy("digest").agg(F.min("license").alias("license"))


def built_in(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "license string, text string")


def scan(docs: DataFrame, texts: DataFrame, notices: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, digest, license, notices) for every row of ``docs``.

    ``texts`` and ``notices`` are tables (license, text) of known ones; ``license``
    is the licence that the entire text is, ``notices`` the licences that its lines
    name, comma-joined, each null if there is none."""
    whole, lines = saved(digests(texts)), saved(digests(notices))
    whole, lines = (F.broadcast(d) if small_enough(d.count(), 128) else d for d in (whole, lines))
    spoken = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), "\n"),
                      lambda x: F.replace(x, F.lit("licence"), F.lit(NOTICE)).contains(NOTICE))
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), id_col, digest(F.col("text")).alias("digest"),
                             spoken.alias("spoken")))
    named = rows.where(F.size("spoken") > 0).select("row", F.explode("spoken").alias("line")).select(
        "row", digest(F.col("line")).alias("digest")).join(lines, "digest").groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    return rows.select("row", id_col, "digest").join(whole, "digest", "left").join(named, "row", "left").select(
        id_col, "digest", "license", "notices")
