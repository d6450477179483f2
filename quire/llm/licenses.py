"""License scans by canonical digests, in DataFrame functions.

A text's canonical form has no letter case, punctuation, copyright lines or spelling variants.
Entire texts are joined by the SHA-256 of that form to a table of known licences; entire lines, for the notices that
stand on a line of their own, are looked up in the row itself, so no row moves. Known texts are a parameter: (licence, text)
pairs or rows of digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Known texts and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
KNOWN = [
    ("MIT", f"MIT License\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT}"),
    ("MIT", f"The MIT License\n{_MIT}"),
    ("MIT", _MIT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_END}"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("BSD-2-Clause", (_BSD_HEAD + _BSD_END).replace("1. ", "* ").replace("2. ", "* ")),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + (_BSD_HEAD + _BSD_END).replace("1. ", "* ").replace("2. ", "* ")),
    ("BSD-3-Clause", (_BSD_HEAD + _BSD_THIRD + _BSD_END).replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + (_BSD_HEAD + _BSD_THIRD + _BSD_END).replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
#: Digests of the canonical forms of entire licence texts, as the Free Software Foundation, Apache, Mozilla, Perl, Berkeley and
#: Creative Commons wrap them.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "58f3520265e847ed2bea7135ec15692caf13cbe4c52666e9ca5eb168408285c2"),
    ("Artistic-1.0-Perl", "d110ea672aae32808841426f3df10400a854fc5c7bfae47febc9904ecdb435c4"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "e81a397f47f5a6e2129c62da35792cfa31f42022d0de56a8dac46e152690c552"),
    ("GFDL-1.2", "6b49b9259db761fb4330d621bfe2686a6100cb6ca7aecd55ebacbaed7a069958"),
    ("GFDL-1.3", "d574aee7816c0fe8e4f77f65965a9848c7470f08ac1c212952bdad7db9e6e873"),
    ("GPL-1.0", "c07bc46ba5b79ab4f2ff3dde241cb3569f1f255d0a7bb777079d77d93e9a52cc"),
    ("GPL-2.0", "d8b3017b3cccac1b7b342bfecd2ab87713bc73465838335b12ea87801f73d2db"),
    ("GPL-3.0", "792e5588767d6a679b057d65e041e39210701763e02470e7a7c1f8981a6df89a"),
    ("LGPL-2.0", "61197a31bf69478d7b78639b347e1e84e0bdf283e4ccd88ed7baa788028effe7"),
    ("LGPL-2.1", "57ba7381c80a818fafb3131b9479d9ae4b8e6978e118244a7f70364a6af93524"),
    ("LGPL-3.0", "e349834e4a932f7700bf8d8b600e1c92aac490dfc6e663ffbbe720a42c5dee10"),
    ("MPL-1.1", "8f033b344100818c57edcb00088ed7226310a4aec4b76c1d57900f31ad710b69"),
    ("MPL-2.0", "673e2027824d8c592637c1562167062fe60ea36ab88fc4fdb3ccb76ab67691b7"),
]
#: A known text holds one of these; spelling rules are spared where none is.
SOME = r"(?i)licen[sc]|copyright|permission|redistribut|warrant|public domain"
#: Lines that go, equivalent spellings, signs; patterns and what they become, in order. They mean the same to both engines.
LINES = [
    (r"(?im)^[ \t*#/;-]*(?:copyright[ \t:]*(?:©|\(c\))|copyright[ \t:,]*(?:by |[<\[{]?(?:[12][0-9]{3}|year|yyyy))|(?:©|\(c\))[ \t]*[<\[{]?(?:[12][0-9]{3}|year|yyyy))[^\n]*", " "),
    (r"(?im)^[ \t*#/;-]*all rights reserved[.]?[ \t]*$", " "),
]
SPELLINGS = [
    (r"(?i)(licen|defen|offen)ce", "$1se"),
    (r"(?i)(organi|utili|reali|recogni|authori|initiali|maximi|optimi|categori|capitali|emphasi|analy)s(e|i|a)", "$1z$2"),
    (r"(?i)(fav|lab|hon|behavi|col)our", "$1or"),
    (r"(?i)(cancel|label|model|signal|travel)l(ed|ing)", "$1$2"),
    (r"(?i)(catalog|analog|dialog)ue", "$1"),
    (r"(?i)(cent|calib|fib)re", "$1er"),
    (r"(?i)(acknowledg|judg)ement", "$1ment"),
    (r"(?i)(fulfi|wi)l+(ful)?l*", "$1l$2"),
    (r"(?i)artefact", "artifact"),
    (r"(?i)practis", "practic"),
    (r"(?i)programme", "program"),
    (r"(?i)whilst", "while"),
    (r"(?i)per cent", "percent"),
    (r"(?i)(sub|non)[- ]+(licen|infring|commercial)", "$1$2"),
    (r"(?i)copyright([ \n]+)holder", "copyright$1owner"),
    (r"(?i)https", "http"),
    (r"&", " and "),
]
SIGNS = (r"[^\p{L}\p{N}\n]+", " ")
#: Known texts at most; they are sent to every task.
MOST = 10_000


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _form(text: Column) -> Column:
    """The canonical form line by line."""
    for pattern, to in LINES:
        text = F.regexp_replace(text, pattern, to)
    spelled = text
    for pattern, to in SPELLINGS:
        spelled = F.regexp_replace(spelled, pattern, to)
    return F.lower(F.regexp_replace(F.when(text.rlike(SOME), spelled).otherwise(text), *SIGNS))


def _joined(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"[ \n]+", " "))


def canonical(text: Column) -> Column:
    """The canonical form of an entire text; null reads as empty."""
    return _joined(_form(F.coalesce(text, F.lit(""))))


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``(digest, license)`` of known (licence, text) pairs."""
    frame = spark.createDataFrame(texts, "license string, text string")
    return frame.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").distinct()


def all_known(spark: SparkSession) -> DataFrame:
    """``(digest, license)`` of KNOWN and of DIGESTS."""
    more = spark.createDataFrame(DIGESTS, "license string, digest string")
    return known_licenses(spark).unionByName(more).distinct()


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, digest, license, notices)``, a row for each row of ``docs``.

    ``license`` is that of the entire text, ``notices`` the sorted licences of entire lines, joined by commas
    (empty: none). A null text counts as empty and matches nothing. ``known`` has a row for each digest (of several, the
    least licence counts), at most ``MOST``, which is checked; it is sent to every task. All else happens within the row, so null, repeated and
    shared ids change nothing, and a long text takes a few times its own size. Other columns play no part.
    """
    known = known.groupBy("digest").agg(F.min("license").alias("license"))
    listed = known.limit(MOST + 1).collect()
    if len(listed) > MOST:
        raise ValueError(f"more than {MOST} known texts")
    of_line = F.create_map(*[F.lit(x) for row in listed for x in (row.digest, row.license)]) if listed else F.create_map().cast("map<string,string>")
    line = lambda x: F.try_element_at(of_line, F.sha2(F.trim(x), 256))
    found = lambda form: F.filter(F.transform(F.filter(F.split(form, "\n"), lambda x: F.length(x) > 8), line), lambda x: x.isNotNull())
    told = lambda form: F.struct(F.sha2(_joined(form), 256).alias("digest"), F.array_join(F.array_sort(F.array_distinct(found(form))), ",").alias("notices"))
    own = docs.select(F.col(key).alias("doc_id"), _let(_form(F.coalesce(F.col(text), F.lit(""))), told).alias("x")).select("doc_id", "x.digest", "x.notices")
    return own.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license", "notices")


def op8(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents, as entire texts and as entire lines; nulls, repeated ids and long texts as ``scan`` states."""
    return scan(table(spark, sf_dir, "documents"), all_known(spark))


def _sql_form(text: str) -> str:
    def replaced(text: str, rules: list[tuple[str, str]]) -> str:
        for pattern, to in rules:
            to = to.replace("$", chr(92))
            text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
        return text

    lines = replaced(text, LINES)
    return f"lower({replaced(f"CASE WHEN regexp_matches({lines}, '{SOME}') THEN {replaced(lines, SPELLINGS)} ELSE {lines} END", [SIGNS])})"


def _sql_digest(form: str) -> str:
    return f"sha256(trim(regexp_replace({form}, '[ \\n]+', ' ', 'g')))"


def _rows() -> str:
    texts = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"SELECT {_sql_digest(_sql_form('t'))} AS digest, license FROM (VALUES {texts}) v(license, t) UNION SELECT digest, license FROM (VALUES {', '.join(f"('{d}', '{n}')" for n, d in DIGESTS)}) w(digest, license)"


ORACLE = f"""
WITH k AS ({_rows()}),
d AS (SELECT doc_id, {_sql_form("coalesce(text, '')")} AS form FROM documents),
l AS (SELECT doc_id, unnest(string_split(form, chr(10))) AS line FROM d),
n AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices FROM (SELECT doc_id, sha256(trim(line)) AS digest FROM l WHERE length(line) > 8) JOIN k USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license, coalesce(n.notices, '') AS notices
FROM (SELECT doc_id, {_sql_digest("form")} AS digest FROM d) w LEFT JOIN k USING (digest) LEFT JOIN n ON w.doc_id = n.doc_id"""
