"""License scans by canonical digest.

A text is canonical when A-Z are in lower case, lines that begin with a copyright notice are gone, equivalent spellings
are one, and all that isn't a letter or digit is one space.  The MD5 digests of the canonical whole text, and of each of its
lines as a text of its own (a licence is often a line of notice), are hash-joined to the digests of known licences: a
table of a few hundred rows, whatever the corpus, and so broadcast.  Only hits and a hash of each row are shuffled, never
a text, and no part of a text is ever compared.

Null, empty or blank texts have no licence.  A row per row; null and repeated ids are handed through.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Spellings that licence guidelines count as equal.
SPELLINGS = (("licence", "license"), ("sublicence", "sublicense"), ("organisation", "organization"), ("authorisation", "authorization"), ("modelled", "modeled"), ("favour", "favor"), ("fulfil ", "fulfill "), ("http://", "https://"), ("&", " and "))
COPYRIGHT = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
OTHER = r"[^a-z0-9\n\x80-\x{10FFFF}]+"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known texts by licence; short notices stand for the licence that they name.
KNOWN = {
    "MIT": (MIT, "MIT License\n" + MIT, "The MIT License (MIT)\n" + MIT, "Released under the MIT License.", "Licensed under the MIT License."),
    "ISC": (ISC, "ISC License\n" + ISC, "Released under the ISC License."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."),
    "CC0-1.0": ("Released under CC0 1.0.", "This work is released under CC0 1.0."),
}

#: Canonical digests of whole licence texts, with and without what follows the terms, by licence.
WHOLE = {
    "Apache-2.0": ("b27c759862531cc87d642844b66233c5", "140fc7dd3fe13f9e3a727dc78d989884", "e6c7b7269497451001d75f3de65b402f", "09aa5ff2cdfd26b058df3b4bc7f0032f", "c5a1fc6488e58a5e875d957a11a838eb", "3e1f4d6717dd94f6954649aeed45d811",),
    "Artistic-1.0-Perl": ("7fcf35f5ad3314fa9254c4e56baaceb8",),
    "BSD-2-Clause": ("b0538ec125cafeeb58bf11083985630b", "7156097767f5afef1724228b3dfb48fe", "86f56c47a776acba8d7b43470d449555", "51d69cd7c240263ba1b74d5fd087cc2d",),
    "BSD-3-Clause": ("6989781d8e3e31bf06f590dd203d4e65", "35949a337d62edf6d4a7546132b54bb9", "313f76a76676f32d87dd2e2289f00188", "45de459068d4830f24138a97cbdec14b", "3f2317126997645362b9b82a8595ac4e",),
    "CC-BY-SA-4.0": ("b15619507300fe9fd598091d007cca1c",),
    "CC0-1.0": ("93a180096f6cfcf2c0dd24f75c2eec48",),
    "GFDL-1.2": ("6fae616a2084258d6f1635920433f2e2",),
    "GFDL-1.3": ("9715992e76e496f0c0d0a6fcfb268fed",),
    "GPL-1.0": ("738cc3b112640d95d4cd79a58967ecea", "dbf3c47f5a8f127e58d08cabc1ebb916", "21fa8693acc5194a648fe02e11f65a72",),
    "GPL-2.0": ("e374d0b43c25aed1a2b28951fe92a546", "cbb3451938de95cbb302d3c10690ede8", "95f8e6eea7034bb28698597e2a21390c", "e0b7635c5df0abca544f6e8bbe326fde",),
    "GPL-3.0": ("057f186a69ca5796ed5fd60ffc00e686", "9622e348e3655fc913d2a9a03f2362b1", "d7b2d50fa70d40ab725f812119aa2d3d", "5eaa767cc0a56c87c3852144458a3bf1",),
    "ISC": ("d4ab7844672554d3dacb33435e62566b",),
    "LGPL-2.0": ("63ac11b5b2fcfe811ff161b9e5def0c5", "1389f4e6c9257fffaaa58a4ba72e4209", "67adee7de2991bbdb3346ca63ffc6b75",),
    "LGPL-2.1": ("b0e44c745072418c0ff11407a0bc4ffc", "ea4739ccf5314c5f636f979cc03259e2", "8bafa4c612887b0b12bf68d7e5fe0527",),
    "LGPL-3.0": ("b31b7335bc37919e8cdd79154e04d88d",),
    "MPL-1.1": ("b7edc06df79bc44a04f12befb8111960",),
    "MPL-2.0": ("a27e119cd87d765a971af4667b2bf9b1",),
    "NCSA": ("a0da08a3467e8127a21d756a5ed37ea9",),
    "OFL-1.1": ("c57b0806c384ec4783e36a1f9411c8b7",),
    "Unicode-3.0": ("d326f8dc2f927ff26ec5b185e795fda5",),
}


def canonical(text: str) -> str:
    """The canonical form of a whole text, in Python."""
    t = re.sub(r"[A-Z]", lambda m: m[0].lower(), text)
    t = re.sub(COPYRIGHT, r"\1", t)
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", t).strip(" ")


def canonical_lines(text: Column) -> Column:
    """The text in canonical form, but for line ends; neither spellings nor notices run over them."""
    t = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t = F.regexp_replace(t, COPYRIGHT, "$1")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, OTHER, " ")


def known_digests() -> dict[str, str]:
    return {hashlib.md5(canonical(t).encode()).hexdigest(): name for name, texts in KNOWN.items() for t in texts}


def whole_digests() -> dict[str, str]:
    return {digest: name for name, digests in WHOLE.items() for digest in digests}


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None) -> DataFrame:
    """id, licence string (of the whole text, or null), line_licences array<string> (distinct, in order of name)."""
    got = sorted((known or known_digests() | whole_digests()).items())
    digests = F.broadcast(df.sparkSession.createDataFrame(got, "digest string, name string"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    flat = rows.where(F.length("text") > 0).select("id", "th", canonical_lines(F.col("text")).alias("flat"))
    digest = lambda t: F.md5(F.trim(t).cast("binary"))
    lines = F.array_distinct(F.transform(F.filter(F.split("flat", "\n"), lambda x: F.length(F.trim(x)) > 0), digest))
    whole = F.struct(F.lit(True).alias("whole"), digest(F.regexp_replace("flat", "[ \n]+", " ")).alias("digest"))
    texts = F.concat(F.array(whole), F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("digest"))))
    hits = flat.select("id", "th", F.explode(texts).alias("x")).select("id", "th", "x.*").join(digests, "digest")
    found = hits.groupBy(F.col("id").alias("i"), F.col("th").alias("h")).agg(F.max(F.when(F.col("whole"), F.col("name"))).alias("licence"), F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("name")))).alias("names"))
    out = rows.select("id", "th").join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left")
    return out.select(F.col("id").alias(id_col), "licence", F.coalesce("names", F.array().cast("array<string>")).alias("line_licences"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan_licences(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "licence", F.array_join("line_licences", ",").alias("line_licences"))


def _sql(x: str) -> str:
    t = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    t = f"regexp_replace({t}, '(^|\\n)[ \\t]*(copyright|\\(c\\)|©)[^\\n]*', '\\1', 'g')"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    return f"md5(trim(regexp_replace({t}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' '))"


OP10_SQL = f"""
WITH known(digest, name) AS (VALUES {", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests().items()))}),
lines AS (
  SELECT DISTINCT doc_id, k.name FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) l
  JOIN known k ON k.digest = {_sql("l.line")} WHERE length(trim(l.line, ' ')) > 0
)
SELECT d.doc_id, k.name AS licence, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM lines l WHERE l.doc_id = d.doc_id), '') AS line_licences
FROM documents d LEFT JOIN known k ON k.digest = {_sql("d.text")}
"""
