r"""Licence scans by canonical digest lookup, natively in Spark.

A text is made canonical (case, copyright claims, punctuation, white space, then spelling variants), then its SHA-256 is
hash-joined with the digests of known licence texts: a document that is a licence as a whole is found however it was
wrapped, cased or attributed. The same normal form, kept line by line, finds known licence notices that are whole lines.

Two looser forms are looked up where the first isn't known: without lines that end with `all rights reserved` or begin with
the word copyright and name a holder, and without every line that begins with that word. Both sides are made so. The
digest given is the first form's. Known are `TEXTS`, the files in `licenses`, and any table of texts given to `scan`.

Defined results: a null text counts as empty; an empty canonical text is no licence; rows without id are scanned like
any other; repeated rows give repeated results; an empty table gives an empty result. Only the id and text columns are
read, so others may have any name. Of texts known by several names that of the strictest form counts, then the least. The
known texts of this module are a fixed table, so its broadcast has a proven bound; with a table of texts the digests are counted.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import BROADCAST_DIGESTS, documents, keyed_join, written

# Licence texts, as published, without their titles and copyright lines.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

TEXTS = {
    "MIT": [_MIT, "MIT License\n" + _MIT, "The MIT License\n" + _MIT, "The MIT License (MIT)\n" + _MIT],
    "ISC": [t + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_DISCLAIMER for t in ("", "ISC License\n", "The ISC License\n")],
    "0BSD": [t + _ISC_GRANT + ".\n" + _ISC_DISCLAIMER for t in ("", "BSD Zero Clause License\n", "Zero-Clause BSD\n")],
    "BSD-2-Clause": [t + "\n".join([_BSD_GRANT, _BSD_1, _BSD_2, _BSD_DISCLAIMER]) for t in ("", "BSD 2-Clause License\n", "The 2-Clause BSD License\n")],
    "BSD-3-Clause": [t + "\n".join([_BSD_GRANT, _BSD_1, _BSD_2, _BSD_3, _BSD_DISCLAIMER]) for t in ("", "BSD 3-Clause License\n", "The 3-Clause BSD License\n")],
    "Zlib": [_ZLIB, "zlib License\n" + _ZLIB],
    "Unlicense": [_UNLICENSE, "The Unlicense\n" + _UNLICENSE],
    "Apache-2.0-notice": [_APACHE_NOTICE],
}
# Notices that stand on a line of their own.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "all-rights-reserved": ["All rights reserved."],
}
# Spellings that count as equal, in lower case without punctuation; each begins at a word.
SPELLINGS = {
    "licence": "license",
    "sub license": "sublicense",
    "organis": "organiz",
    "favour": "favor",
    "honour": "honor",
    "acknowledgement": "acknowledgment",
    "recognis": "recogniz",
    "authoris": "authoriz",
    "utilis": "utiliz",
    "merchantibility": "merchantability",
    "non infringement": "noninfringement",
    "non commercial": "noncommercial",
    "copyright owner": "copyright holder",
    "https": "http",
    "whilst": "while",
}
#: A claim of copyright at the start of a line: the word with a sign, a year or a name mark after it. It ends where a sentence of prose begins on the
#: same line (a capital and two words in lower case, kept as the second group), else with the line. A wrapped "copyright notice" isn't one.
CLAIM = (
    r"^[^\p{L}\p{N}\n]*(?:(?i:copyright)[ \t]*(?:\([cC]\)|©|:|(?i:by)\b|[<\[{(]?(?:(?i:year|yyyy)|[12][0-9]{3}))|©|\([cC]\))"
    r"(?:[^\n]*?\.[ \t]+([A-Z][a-z]+[ \t]+[a-z]+[ \t]+[a-z]+[ \t])|[^\n]*)"
)

# In lines of normal form: the end of a claim, a copyright line that names a holder (not a wrapped line of the terms), any such line.
RESERVED_LINE = r"(?m)^[^\n]*\ball rights reserved ?$"
HOLDER_LINE = r"(?m)^ ?copyright (?!(?:notices?|holders?|owners?|laws?|licenses?|interests?|statements?|disclaimers?|rights?|permission|treaty|protection|and|or|in|on|to|of|is|as|for|that|this|with|resulting) )[^\n]+$"
ANY_COPYRIGHT_LINE = r"(?m)^ ?copyright\b[^\n]*$"
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def spelled(text: Column) -> Column:
    """One spelling for each word of a normal form with single spaces."""
    out = F.concat(F.lit(" "), text)
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {old}"), F.lit(f" {new}"))
    return F.substring(out, F.lit(2), F.length(out))


def canonical_lines(text: Column) -> Column:
    """Normal form that still has its line breaks; words aren't spelled alike yet, since a break may fall between them."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, f"(?md){CLAIM}", "$1")), r"[^\p{L}\p{N}\n]+", " ")


def canonical(lines: Column) -> Column:
    """Normal form of a whole text, from `canonical_lines`."""
    return spelled(F.trim(F.regexp_replace(lines, r"\s+", " ")))


def digests(df: DataFrame) -> DataFrame:
    """`df` (with `lines`, from `canonical_lines`) and the digests of the whole text's normal form and its two looser ones."""
    of = lambda lines: F.sha2(canonical(lines).cast("binary"), 256)
    marked = F.col("lines").contains("copyright") | F.col("lines").contains("all rights reserved")
    looser = [F.regexp_replace(F.regexp_replace("lines", RESERVED_LINE, ""), pattern, "") for pattern in (HOLDER_LINE, ANY_COPYRIGHT_LINE)]
    # most texts have nothing to leave out, and their looser forms aren't made
    return df.withColumn("digest", of(F.col("lines"))).withColumns({f"digest{k}": F.when(marked, of(form)).otherwise(F.col("digest")) for k, form in enumerate(looser, 1)})


def known_texts(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the known texts; those of a file also up to the end of its terms."""
    rows = [(name, text) for name, texts in TEXTS.items() for text in texts]
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text()
        terms, end, _ = text.partition(END_OF_TERMS)
        rows += [(path.stem, own) for own in {text, terms, terms + end}]
    return spark.createDataFrame(rows, "license_id string, text string")


def known(texts: DataFrame) -> DataFrame:
    """(digest, license_id) of each form of a table (license_id, text), made canonical by the same expressions."""
    lines = texts.where(F.col("license_id").isNotNull() & F.col("text").isNotNull()).select("license_id", canonical_lines(F.col("text")).alias("lines"))
    named = digests(lines).select("license_id", F.posexplode(F.array("digest", "digest1", "digest2")).alias("form", "own")).where(F.col("own") != F.sha2(F.lit("").cast("binary"), 256))
    best = named.groupBy(F.col("own").alias("digest")).agg(F.min(F.struct("form", "license_id")).alias("best"))
    return best.select("digest", F.col("best.license_id").alias("license_id"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """(id, digest, license_id, notices): notices lists the licences named by whole lines, sorted; `texts` (license_id, text) are known, too."""
    lines = df.select(F.col(id_col).alias("id"), canonical_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    # spelled once for all lines: each begins with a space
    own = F.transform(F.split(spelled(F.replace("lines", F.lit("\n"), F.lit("\n "))), "\n"), lambda line: F.trim(line))
    # the notices' normal forms are constants of the plan
    named = [(name, canonical(canonical_lines(F.lit(text)))) for name, texts_ in NOTICES.items() for text in texts_]
    found = digests(lines).select("id", "digest", "digest1", "digest2", F.array_intersect(own, F.array(*[text for _, text in named])).alias("hits"))
    ids = F.array(*[F.when(F.array_contains("hits", text), F.lit(name)) for name, text in named])
    out = found.select("id", "digest", "digest1", "digest2", F.array_sort(F.array_distinct(F.array_compact(ids))).alias("notices"))
    keys = known(known_texts(df.sparkSession))
    if texts is None:
        keys = F.broadcast(keys)  # a fixed table of a few dozen rows
    else:
        keys = written(known(known_texts(df.sparkSession).union(texts.select("license_id", "text"))), "licenses")
    for k, name in enumerate(("digest", "digest1", "digest2")):
        one = keys.select(F.col("digest").alias(name), F.col("license_id").alias(f"license{k}"))
        out = out.join(one, name, "left") if texts is None else keyed_join(out, one, name, "left", BROADCAST_DIGESTS)
    return out.select("id", "digest", F.coalesce("license0", "license1", "license2").alias("license_id"), "notices")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents are as a whole, and those that their lines name."""
    return scan(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.col("digest").alias("canonical_sha256"), "license_id", F.array_join("notices", ",").alias("notices"))


def _sql(text: str) -> str:
    return rf"regexp_replace(lower(regexp_replace({text}, '(?m){CLAIM}', '\1', 'g')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def _spelled(text: str) -> str:
    out = f"(' ' || {text})"
    for old, new in SPELLINGS.items():
        out = f"replace({out}, ' {old}', ' {new}')"
    return f"substr({out}, 2)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    texts = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, own in TEXTS.items() for text in own)
    notices = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, own in NOTICES.items() for text in own)
    whole = _spelled(r"trim(regexp_replace({}, '\s+', ' ', 'g'))")
    return f"""
    WITH texts AS (SELECT DISTINCT license_id, sha256({whole.format(_sql("text"))}) AS digest FROM (VALUES {texts}) t(license_id, text)),
    notices AS (SELECT name, {whole.format(_sql("text"))} AS line FROM (VALUES {notices}) n(name, text)),
    lines AS (SELECT row_number() OVER () AS row, doc_id, {_sql("coalesce(text, '')")} AS lines FROM documents),
    split AS (SELECT row, {_spelled("line")} AS line FROM (SELECT row, trim(unnest(string_split(lines, chr(10)))) AS line FROM lines)),
    named AS (SELECT row, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM split JOIN notices USING (line) GROUP BY row)
    SELECT doc_id, sha256({whole.format("lines")}) AS canonical_sha256, license_id, coalesce(notices, '') AS notices
    FROM lines LEFT JOIN named USING (row) LEFT JOIN texts ON digest = sha256({whole.format("lines")})"""


ORACLE = oracle()
