"""Licence scan by canonical digests.

A text is brought to a canonical form (ASCII letters in lower case, copyright statements dropped, punctuation and white
space as single spaces, equivalent spellings as one; licence prose that a line break puts at "copyright" stays) and its SHA-256 is looked up among the digests of known licences
by a hash join: whole texts that are a licence are found however they are set or spelt. The same is done with each
line of a text and the digests of known notices ("Licensed under ..."), which are a short fixed list.

Nulls: a null text is the empty text and matches nothing. Repeated rows give equal rows, empty tables empty results.
Only id and text are read.
"""

from __future__ import annotations

import hashlib
import pkgutil
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, applied in this order.
EQUIVALENT = [
    ("licence", "license"), ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"), ("initialis", "initializ"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"), ("fulfilment", "fulfillment"),
    ("judgement", "judgment"), ("wilful", "willful"), ("whilst", "while"), ("analogue", "analog"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"), ("per cent", "percent"), ("https", "http"),
]
# A copyright statement: a line with a mark behind "copyright" (the sign, a year, "by", a template's bracket), or whose paragraph begins
# with "copyright", and any statements without a mark right below it. Other lines that begin with the word are prose. First the line breaks
# before lines that may be statements become \x01 (which stands for no break else), so that the lines below a statement are one line with it.
_MARK = r"(\(c\)|©|[12][0-9]{3}|[<\[{])"
_BELOW = r"\n([ \t]*(copyright|\(c\)|©|(all[ \t]+)?rights[ \t]+reserved))"
COPYRIGHT_LINE = (r"((^|[\n\x01])[ \t]*(copyright[ \t:,]*(by[ \t]|" + _MARK + r")|\(c\)[ \t:,]*(copyright|" + _MARK + r")|©|all rights reserved)"
                  r"|(^|\n[ \t\r]*[\n\x01])[ \t]*copyright[ \t])[^\n]*")
PUNCTUATION = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F‘’“”–—•© ]+"

# Licence texts, without their copyright lines, and one-line notices.
_MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""
TEXTS = {"MIT": _MIT, "ISC": _ISC, "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL, "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "Zlib": _ZLIB}
# Longer texts, whole as their publishers set them; files of the package, read by the driver alone.
TEXTS |= {name: pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode() for name in (
    "Apache-2.0", "Artistic-1.0-Perl", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1",
    "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense")}
_TERMS_END = "END OF TERMS AND CONDITIONS"
NOTICES = {
    "AGPL-3.0": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   'Licensed under the Apache License, Version 2.0 (the "License");',
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
                   "http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0",
                "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
                "SPDX-License-Identifier: GPL-3.0-or-later"],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL-2.1": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0": ["SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": ["Licensed under the MIT License.", "Released under the MIT License.", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
                "License, v. 2.0. If a copy of the MPL was not distributed with this",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}


def canonical_text(text: str) -> str:
    """The canonical form, for the known texts."""
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    text = re.sub(_BELOW, "\x01\\1", text.replace("\x01", " "))
    text = re.sub(PUNCTUATION, " ", re.sub(COPYRIGHT_LINE, " ", text))
    for a, b in EQUIVALENT:
        text = text.replace(a, b)
    return text.strip(" ")


def canonical(text: Column) -> Column:
    """The canonical form of a column of texts."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = F.translate(F.coalesce(text, F.lit("")), f"{upper}\x01", f"{upper.lower()} ")
    out = F.regexp_replace(out, _BELOW, "\x01$1")
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, " "), PUNCTUATION, " ")
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def digest(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def variants(text: str) -> list[str]:
    """A licence text with and without its title line, with its usual titles, and with and without what stands behind its terms."""
    title, _, body = text.partition("\n")
    terms, end, _ = text.partition(_TERMS_END)
    titles = ["", f"The {title}", f"The {title} ({title.split(' ')[0]})", f"{title} ({title.split(' ')[0]})"] if title.endswith(" License") else []
    titles = titles if end == "" and len(title.split(" ")) == 2 else titles[:1]
    return [text, *(f"{t}\n{body}" for t in titles), *([terms, terms + end] if end else [])]


def known_texts(spark: SparkSession, texts: dict[str, str] = TEXTS) -> DataFrame:
    """``text_digest, license`` of licence texts; any table of this form will do instead."""
    rows = sorted({(digest(v), name) for name, t in texts.items() for v in variants(t)})
    return spark.createDataFrame(rows, "text_digest string, license string")


def notice_digests(notices: dict[str, list[str]] = NOTICES) -> dict[str, str]:
    return {digest(n): name for name, lines in notices.items() for n in lines}


def notice_words(notices: dict[str, list[str]] = NOTICES) -> list[str]:
    """Words such that a line whose canonical form is a notice's has one of them, but for the case: of each notice the longest in which
    no other spelling has a part."""
    found = set()
    for line in (n for lines in notices.values() for n in lines):
        words = [w for w in canonical_text(line).split(" ") if w.isascii() and not any(b in w for _, b in EQUIVALENT)]
        found.add(max(words, key=lambda w: (len(w), w), default=""))
    return sorted(w for w in found if not any(o != w and o in w for o in found))


def license_scan(docs: DataFrame, known: DataFrame | None = None, notices: dict[str, list[str]] = NOTICES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, text_digest, license, notices``: the licence that the whole text is (null: none known), and the licences
    that its lines name, in order and joined by commas (empty: none). ``known`` has one licence per digest."""
    known = known_texts(docs.sparkSession) if known is None else known
    known = known.groupBy("text_digest").agg(F.min("license").alias("license"))
    named = F.create_map(*[F.lit(x) for pair in sorted(notice_digests(notices).items()) for x in pair])
    # Only lines with a word of a notice can be one.
    words = notice_words(notices)
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    lines = F.filter(lines, lambda x: reduce(or_, [F.contains(F.lower(x), F.lit(w)) for w in words], F.lit(False)))
    found = F.transform(lines, lambda x: F.element_at(named, F.sha2(canonical(x), 256)))
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    src = src.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("text_digest"),
                     F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",").alias("notices"))
    return src.join(known, "text_digest", "left").select("doc_id", "text_digest", "license", "notices")


def sql_canonical(text: str) -> str:
    """DuckDB's expression for the canonical form."""
    out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(1), 'abcdefghijklmnopqrstuvwxyz ')"
    out = f"regexp_replace({out}, '{_BELOW}', chr(1) || '\\1', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '{COPYRIGHT_LINE}', ' ', 'g'), '{PUNCTUATION}', ' ', 'g')"
    for a, b in EQUIVALENT:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out}, ' ')"


def sql() -> str:
    """The scan over ``documents`` in DuckDB's SQL."""
    values = lambda rows: ", ".join(f"('{a}', '{b}')" for a, b in rows)
    known = values(sorted({(digest(v), n) for n, t in TEXTS.items() for v in variants(t)}))
    notices = values(sorted(notice_digests().items()))
    return f"""
WITH known(digest, license) AS (VALUES {known}), notice(digest, license) AS (VALUES {notices}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
named AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
          FROM lines JOIN notice ON digest = sha256({sql_canonical("line")}) GROUP BY doc_id),
texts AS (SELECT doc_id, sha256({sql_canonical("text")}) AS text_digest FROM documents)
SELECT doc_id, text_digest, license, coalesce(notices, '') AS notices
FROM texts LEFT JOIN known ON digest = text_digest LEFT JOIN named USING (doc_id)
"""
