"""Licence scan by canonical digests; DataFrame functions only.

A whole text is reduced to a canonical form: lines that only claim copyright or name a short licence go, as does
"all rights reserved"; case, punctuation and white space no longer count, and spellings that mean the same become
one. Texts are joined to known licences by the digest of that form, so neither wrapping nor a heading matters.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.base import OWN
from riskloom.llm.winnow import BREAKS, LOWER, UPPER

# --- fixed values: typographic signs and their plain forms, spellings that count as equal, licence texts ---
SIGNS, PLAIN = "‘’“”–—", "''\"\"--"
# A claim begins a line with the word and a sign, a year or "by" and a name, or with a sign and a year; forms to fill in,
# text about claims and the claim that is part of a licence of its own are none.
CLAIM = r"^[ \t*#;/]*(copyright[ ,]*(\(c\)|©|[12][0-9]{3}|by [^ ])|(\(c\)|©) *[12][0-9]{3})"
NO_CLAIM = r"free software|[<\[{]|yy|year|notice|holder|owner|law"
TITLES = [
    "mit license", "the mit license", "the mit license (mit)", "mit license (mit)", "mit licence", "the mit licence", "expat license", "isc license",
    "the isc license", "isc license (isc)", "bsd license", "the bsd license", "bsd 2-clause license", "bsd 3-clause license",
    "the 2-clause bsd license", "the 3-clause bsd license", "2-clause bsd license", "3-clause bsd license", 'bsd 2-clause "simplified" license',
    'bsd 3-clause "new" or "revised" license', "simplified bsd license", "new bsd license", "revised bsd license", "modified bsd license",
]
RESERVED = "all rights reserved"
TEXTS = Path(__file__).parent / "licence_texts"  # whole texts, a file each
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("cancelled", "canceled"), ("centre", "center"), ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"), ("favour", "favor"), ("fulfil", "fulfill"), ("https", "http"), ("judgement", "judgment"),
    ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("non commercial", "noncommercial"), ("organisation", "organization"),
    ("per cent", "percent"), ("sub license", "sublicense"), ("whilst", "while"), ("wilful", "willful"),
]
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
    "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
    "SOFTWARE."
)
LICENCES = {"BSD-2-Clause": _BSD + _BSD_END, "BSD-3-Clause": _BSD + _BSD_THIRD + _BSD_END, "ISC": _ISC, "MIT": _MIT}


def known_texts() -> dict[str, str]:
    """Name and text of every known licence: the short ones above and the files beside this module."""
    return LICENCES | {p.stem: p.read_text(encoding="utf-8") for p in sorted(TEXTS.glob("*.txt"))}


def canonical(text: Column) -> Column:
    """Words of the canonical form with one space between them; empty for a null."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + SIGNS, LOWER + PLAIN)

    def claims(line: Column) -> Column:
        return F.rlike(line, F.lit(CLAIM)) & ~F.rlike(line, F.lit(NO_CLAIM))

    lines = F.filter(F.split(plain, "\n"), lambda x: ~(claims(x) | F.trim(F.translate(x, "\t\r", "  ")).isin(TITLES)))
    words = F.trim(F.regexp_replace(F.array_join(lines, "\n"), BREAKS, " "))
    # Every word gets two spaces of its own, so that neighbours can both be replaced.
    padded = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in [(RESERVED, ""), *SPELLINGS]:
        padded = F.replace(padded, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} " if new else " "))
    return F.trim(F.regexp_replace(padded, " +", " "))


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence, text) of ``known_texts``: some twenty rows."""
    return spark.createDataFrame([*known_texts().items()], "licence string, text string")


def scan_licences(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``digest`` (SHA-256 of the canonical form) and ``licence`` under ``base.OWN``.

    ``known`` has ``licence`` and ``text``; of licences with one canonical form the first by name is
    told, those that are null or have no words match nothing. Texts that are no licence, null or
    empty have a null licence. Every row stays, repeated or not.
    """
    known = known_licences(docs.sparkSession) if known is None else known
    named = known.select("licence", canonical(F.col("text")).alias("c")).where("c <> '' and licence is not null")
    named = named.groupBy(F.sha2("c", 256).alias(f"{OWN}digest")).agg(F.min("licence").alias(f"{OWN}licence"))
    given = docs.withColumn(f"{OWN}digest", F.sha2(canonical(F.col(f"`{text}`")), 256)).drop(text)
    return given.join(named, f"{OWN}digest", "left")
