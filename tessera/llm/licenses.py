"""License scans by canonical digest lookup, with DataFrame operations only.

A text is brought to a canonical form: letters become lower case, copyright notices (lines that begin
with ``copyright`` and hold a year or a sign, or with the sign and a year) go, equivalent spellings become
one, and everything but letters and digits becomes single spaces. The SHA-256 of the whole canonical
text is hash-joined to the digests of known licences, brought to the same form. The same lookup is
made for each line, which finds one-line notices and unwrapped licences inside other text; only lines
as long as some known text are hashed.

:func:`known` covers the texts and notices below and, by digest alone, longer licences (``DIGESTS``).
The table has a fixed size, so it is broadcast. Null and empty texts have the digest of nothing, which
no licence has. Repeated rows each get their row; other columns are ignored; an empty table gives an
empty result. Long texts stay whole.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that mean the same in licences (fixed values); what stands in the groups remains.
SPELLINGS = (
    "(licen|organi|merchant)[acisz](e|ation|bility)", "(favo|acknowledg|judg)[ue](r|ment)", "(sub|non|per)(?:-|-?[ \\n]+)(licen|infringement|commercial|cent)[cs]?", "(wil|http)[ls](ful|://)", "(v)ersion",
)
#: A copyright notice, in lower case: the whole line.
NOTICE_LINE = r"^[ \t#*/;-]*(?:copyright[^\n]*(?:[0-9]{4}|\(c\)|©|<year>|\[year\]|\[yyyy\])|copyright by |\(c\) ?[0-9]{4}|©|all rights reserved)[^\n]*"
#: What a known text may be headed with (fixed values).
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "MIT-0": ("MIT No Attribution",), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "Zlib": ("zlib License",), "BSL-1.0": (),
}

#: Public licence texts and usual notices (fixed values).
TEXTS = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
}
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the Apache License, Version 2.0.": "Apache-2.0",
    "This project is licensed under the Apache License 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This project is licensed under the MIT License.": "MIT",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    "Licensed under the BSD 2-Clause License.": "BSD-2-Clause",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
    "Licensed under the Mozilla Public License, version 2.0.": "MPL-2.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
    "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
}


#: Two licences whose texts follow from others.
TEXTS["MIT-0"] = TEXTS["MIT"].replace(" subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".").replace("furnished to do so,.", "furnished to do so.")
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace(
    " THIS SOFTWARE IS PROVIDED", " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED", 1
)

#: SHA-256 of the canonical forms of whole public licence texts as they are commonly shipped, with and
#: without an appendix (fixed values).
DIGESTS = {
    "94fd04618e5fd9889b5a31f22bad7bdd5d8f501bc9a13dd2179012a899fa5ca2": "Apache-2.0",
    "5179502243950e2cc0da04b585919097ca5682dccfeb647e8ea182b2456a021a": "Apache-2.0",
    "b376af04be9544b7969a9a9394619862e8216da4299744363123fd8a54e97dac": "Apache-2.0",
    "f7aace5560346464242b5da189c0f8431a4c5a61d6d683401e381e8a65436d91": "Artistic-1.0-Perl",
    "28acae585c97ae4473942c7b5d54f91a5bcf23b19ea497677d8cbc21d4498d74": "CC0-1.0",
    "f826dc93837d61d860420651a20c667d72b0d773d893936393a7b8ceeca9202a": "GFDL-1.2",
    "6de7565b43e81c60720acf5acd9a99aaa8a17db6ddf86f40dc7d39c995f67426": "GFDL-1.3",
    "64f5a6dcb1060ed894faaf0d1a8682c34c66dbd0ba88ae411dea30247d87b613": "GPL-1.0",
    "015f614b98eab8002a2aaa19930d941f2951225ff513630a5ac9954f72f96167": "GPL-2.0",
    "1316de90c847d0fba4c8a3a7bf7db28f281f9435e0ca50997ac4e43f78501ec4": "GPL-3.0",
    "8a376ea0fa7e1bf1b97cdd16ace14ed20c4b9d24088c0517054f368a05f14252": "LGPL-2.0",
    "737b557644dd6c52213dae732e820715474c8ee7ee4fad7ce108fa01fd735f31": "LGPL-2.1",
    "b510c888a9fa860bf56279312186c37d9ec3df336e1fbdff4e1d216c8810453f": "LGPL-3.0",
    "421ef3dd13bc605202fd4cb37d1dd07b9dd88f0147da7e82cf9c6ad79314e206": "MPL-1.1",
    "30d5abab47569c185fdbfeb85fbe893f46c34c8992b25c69c66ffff32f92c134": "MPL-2.0",
}

_SPELLINGS = "|".join(SPELLINGS)
_GROUPS = range(1, len(re.findall(r"\((?!\?)", _SPELLINGS)) + 1)


def _lines_of(text: str) -> str:
    out = re.sub(f"(?m){NOTICE_LINE}", "", text.lower())
    out = re.sub(_SPELLINGS, "".join(rf"\{k}" for k in _GROUPS), out)
    return re.sub("[^a-z0-9\\n\u0080-\U0010ffff]+", " ", out)


def canonical_text(text: str) -> str:
    """The canonical form of one text."""
    return re.sub("[ \n]+", " ", _lines_of(text)).strip(" ")


def _canonical_lines(text: Column) -> Column:
    """The canonical form with line ends."""
    out = F.regexp_replace(F.lower(text), f"(?md){NOTICE_LINE}", "")
    out = F.regexp_replace(out, _SPELLINGS, "".join(f"${k}" for k in _GROUPS))
    return F.regexp_replace(out, r"[^a-z0-9\n\x{80}-\x{10ffff}]+", " ")


def canonical(text: Column) -> Column:
    """The same as :func:`canonical_text` for a column."""
    return F.trim(F.regexp_replace(_canonical_lines(text), "[ \n]+", " "))


def _named() -> list[tuple[str, str]]:
    forms = [(form, name) for name, text in TEXTS.items() for form in (text, re.sub(r"(?<=[:.]) [123]\. ", " ", text))]  # numbered or not
    headed = [(f"{title}\n{text}", name) for text, name in forms for title in ("", *TITLES.get(name, ()))]
    return headed + list(NOTICES.items())


def known() -> dict[str, str]:
    """Digest to licence, of texts (with and without a title), notices and ``DIGESTS``."""
    return {hashlib.sha256(canonical_text(t).encode()).hexdigest(): n for t, n in _named()} | DIGESTS


def line_lengths() -> list[int]:
    """Characters of the canonical forms that a line can equal."""
    return sorted({len(canonical_text(t)) for t, _ in _named()})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: dict[str, str] | None = None, lengths: list[int] | None = None) -> DataFrame:
    """``doc_id``, ``digest`` (of the whole canonical text), ``license`` (that it equals, or null),
    ``notices`` (licences that its lines name, sorted, joined by ``,``), ``n_notices`` (such lines).

    ``table``: digest to licence, :func:`known` by default. ``lengths``: of the canonical forms behind
    it that lines are compared with; without it and with a table of one's own, every line is hashed.
    """
    spark = docs.sparkSession
    lengths = line_lengths() if table is None and lengths is None else lengths
    table = known() if table is None else table
    licenses = F.broadcast(spark.createDataFrame(sorted(table.items()), "__digest string, __license string"))  # a fixed table
    form = _canonical_lines(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("__doc"), form.alias("__form")).select("__doc", F.sha2(F.trim(F.regexp_replace("__form", "[ \n]+", " ")), 256).alias("__own"), F.transform(F.split("__form", "\n"), lambda x: F.trim(x)).alias("__lines"))
    names = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    lines = F.filter("__lines", lambda x: x != "") if lengths is None else F.filter("__lines", lambda x: F.length(x).isin(lengths))
    found = F.filter(F.transform(lines, lambda x: F.element_at(names, F.sha2(x, 256))), lambda x: x.isNotNull())
    rows = rows.select("__doc", "__own", found.alias("__found")).join(licenses, F.col("__own") == F.col("__digest"), "left")
    return rows.select(
        F.col("__doc").alias(id_col), F.col("__own").alias("digest"), F.col("__license").alias("license"),
        F.array_join(F.array_sort(F.array_distinct("__found")), ",").alias("notices"), F.size("__found").cast("long").alias("n_notices"),
    )


def oracle_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    lines = f"regexp_replace(lower(text), {quoted('(?m)' + NOTICE_LINE)}, '', 'g')"
    lines = f"regexp_replace({lines}, {quoted(_SPELLINGS)}, {quoted(''.join(chr(92) + str(k) for k in _GROUPS))}, 'g')"
    lines = rf"regexp_replace({lines}, '[^a-z0-9\n\x{{80}}-\x{{10ffff}}]+', ' ', 'g')"
    values = ", ".join(f"({quoted(d)}, {quoted(n)})" for d, n in sorted(known().items()))
    return f"""
WITH k(d, n) AS (VALUES {values}),
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT r, doc_id, {lines} AS form FROM t),
w AS (SELECT r, doc_id, sha256(trim(regexp_replace(form, '[ \n]+', ' ', 'g'), ' ')) AS digest FROM c),
l AS (SELECT r, trim(unnest(string_split(form, chr(10))), ' ') AS line FROM c),
f AS (SELECT l.r, k.n FROM l JOIN k ON k.d = sha256(l.line)),
g AS (SELECT r, string_agg(DISTINCT n, ',' ORDER BY n) AS notices, count(*) AS c FROM f GROUP BY r)
SELECT w.doc_id, w.digest, k.n AS license, coalesce(g.notices, '') AS notices, CAST(coalesce(g.c, 0) AS BIGINT) AS n_notices
FROM w LEFT JOIN k ON k.d = w.digest LEFT JOIN g ON g.r = w.r
"""
