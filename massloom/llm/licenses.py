"""Licence scan by canonical digests of entire texts, in DataFrame operations only.

A text's normal form is lower-case, without copyright lines, with punctuation and white space as single spaces
and equivalent spellings as one; its SHA-256 is looked up by a hash join among the digests of known licences. Copyright lines
are statements (the word, sign or "(c)" before a sign, year or placeholder) and lines that only reserve all rights; a wrapped
line of a licence that happens to begin with "copyright notice" stays.

A null text has no normal form: digest and license_id are null. A text without a letter or digit has an empty one and
matches nothing. Known texts with equal normal forms count once, under the smallest id. Null ids and repeated
rows are rows like others; each input row gives one, however long its text; an empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal, as in public licence-matching guidelines.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
}

#: Texts of public licences and of usual one-line notices.
KNOWN = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:MIT": "Released under the MIT License.",
}

#: Titles that may stand above a text of KNOWN.
TITLES = {
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
}

#: Whole texts of public licences in files of this package, by id.
FILES = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")

_STATEMENT = r"(?:copyright[ \t:]*(?:\(c\)|©|[<\[{(]|[0-9]{4})|(?:\(c\)|©)[ \t]*(?:copyright|[<\[{(]|[0-9]{4})|all rights reserved\.?[^a-z0-9\n]*$)"
_COPYRIGHT_LINES = rf"(?m)^[^a-z0-9(\[{{<©\n]*{_STATEMENT}[^\n]*$"
#: Known licences up to this many rows are broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 100_000


def known_texts() -> list[tuple[str, str]]:
    """Id and text of the known licences, with and without their titles."""
    out = list(KNOWN.items()) + [(k, f"{title}\n\n{KNOWN[k]}") for k, titles in TITLES.items() for title in titles]
    folder = files("massloom.llm") / "known_licenses"
    return out + [(k, (folder / f"{k}.txt").read_text("utf-8")) for k in FILES]


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id, text: about thirty rows."""
    return spark.createDataFrame(known_texts(), "license_id string, text string")


def normal_words(text: Column) -> Column:
    """The words of the normal form; null for null."""
    plain = F.regexp_replace(F.lower(text), _COPYRIGHT_LINES, " ")
    split = F.array_remove(F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "), " "), "")
    same = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))
    return F.transform(split, lambda w: F.coalesce(F.element_at(same, w), w))


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, n_words, digest (both of the normal form), license_id (null if the text is no known licence).

    known: license_id, text.
    """
    digest = F.sha2(F.array_join("words", " "), 256)
    table = known.select("license_id", normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    table = table.groupBy(digest.alias("known_digest")).agg(F.min("license_id").alias("license_id"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    own = docs.select("doc_id", normal_words(F.col("text")).alias("words"))
    own = own.select("doc_id", F.when(F.col("words").isNotNull(), F.size("words")).cast("long").alias("n_words"), digest.alias("digest"))
    return own.join(table, F.col("digest") == F.col("known_digest"), "left").select("doc_id", "n_words", "digest", "license_id")


def license_sql() -> str:
    """The same over `documents`, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known_texts())
    same = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in SPELLINGS.items())
    split = f"list_filter(string_split(regexp_replace(regexp_replace(lower(text), {quote(_COPYRIGHT_LINES)}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    words = f"list_transform({split}, lambda w: coalesce(MAP {{{same}}}[w], w))"
    return f"""
WITH known AS (SELECT * FROM (VALUES {rows}) AS k(license_id, text)),
known_words AS (SELECT license_id, {words} AS words FROM known),
digests AS (SELECT sha256(array_to_string(words, ' ')) AS digest, min(license_id) AS license_id FROM known_words WHERE len(words) > 0 GROUP BY 1),
own AS (SELECT doc_id, {words} AS words FROM documents),
named AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CASE WHEN words IS NOT NULL THEN sha256(coalesce(array_to_string(words, ' '), '')) END AS digest FROM own)
SELECT doc_id, n_words, named.digest, license_id FROM named LEFT JOIN digests ON named.digest = digests.digest
"""
