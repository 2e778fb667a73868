"""License scans: canonical digests of entire texts, joined to known ones. DataFrame functions only.

A unit (a whole document, a block between blank lines, a line, or several lines or blocks in a row) is normalised as
a whole: lower case, equivalent spellings, copyright lines dropped, punctuation and white space run together. Its
SHA-256 digest is joined to the digests of the known texts, which are normalised by the same expressions. Of the
many rows of lines in a document only those are units that begin like a known text and have about as many words.
"""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, after lower-casing (fixed values): pattern, replacement.
SPELLINGS = (
    (r"\blicen[cs]e?(d|s|es)?\b", "license$1"),
    (r"\b(sub)licence", "$1license"),
    (r"\b(?:the )?software\b", "software"),
    (r"\bcopyright (?:owner|holder)(s?)\b", "copyright holder$1"),
    (r"\bhttps?://(?:www\.)?", ""),
    (r"\b(?:version|ver|v)\.? ?(?=\d)", "v"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bnon-?commercial\b", "noncommercial"),
    (r"&", " and "),
)
#: A line (they end at \n alone, so that time goes by length) that only claims copyright (and is not the middle of a wrapped sentence on its holders or notice).
COPYRIGHT = r"(?imd)^[^\p{L}\p{N}\n]*(?:copyright\b(?!\s+(?:(?:owner|holder)s?(?:\s+(?:and|or|be|nor)\b|\s*$)|notice,?\s+(?:and|this)\b))|\(c\)|©|all rights reserved)[^\n]*$"

#: White space, with line ends and what marks a line of a comment: spellings of two words may be wrapped.
WRAP = r"\s++(?:[#*/;%>|!-]++\s++)*+"

#: Grants in a sentence: {} takes the licence's name (fixed values).
GRANTS = (
    "licensed under {}",
    "released under {}",
    "distributed under {}",
    "available under {}",
    "this work is licensed under {}",
    "this file is licensed under {}",
    "this project is licensed under {}",
    "this software is released under {}",
)
#: SPDX identifiers and their usual names (fixed values).
NAMES = {
    "MIT": ("the MIT License", "MIT"),
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache-2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "GPL-2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "GPL-3.0"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0",),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "ISC": ("the ISC License",),
    "CC-BY-4.0": ("CC BY 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC0-1.0": ("CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"),
}
#: Whole licence texts, one file each, named by SPDX identifier.
FOLDER = Path(__file__).parent / "licences"
#: Short whole licence texts and notices (fixed values).
TEXTS = {
    "MIT": (
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "WTFPL": (
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
}


def canonical(text: Column) -> Column:
    """The canonical form of an entire text."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT, " "))
    t = F.regexp_replace(t, WRAP, " ")
    for pattern, to in SPELLINGS:
        t = F.regexp_replace(t, pattern, to)
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


#: What a rule above may make of a text's first word: the word, and its form. A text of either may be equal.
CHANGES = (
    (r"^(sub)?licen[cs]e?(d|s|es)?$", "$1license$2"),
    (r"^the$", "software"),
    (r"^(?:version|ver|v)[0-9]*$", "v"),
    (r"^merchantibility$", "merchantability"),
    (r"^non$", "noncommercial"),
)
#: Characters of a line's end in which its last word is looked for; a longer word is no known text's last.
LONGEST_LAST = 100
#: What a rule may make of a text's last word, likewise.
ENDINGS = (CHANGES[0], CHANGES[3], (r"^owner(s?)$", "holder$1"))
#: What a rule takes away: such words neither begin nor end a form.
LINK = r"(?i)\bhttps?://(?:www\.)?"
#: A line of no word, or one that only claims copyright.
_NO_WORD = r"[\p{L}\p{N}]"
_CLAIM = COPYRIGHT.replace("(?imd)", "(?id)")
#: The same of a line with the one after it, which may tell that the line is the middle of a sentence.
_CLAIM_BEFORE = COPYRIGHT.replace("(?imd)^", r"(?imd)\A")


def whole_texts(folder: Path = FOLDER) -> list[tuple[str, str]]:
    """``(SPDX identifier, text)`` of the files of a folder."""
    return [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(folder.glob("*.txt"))]


def known(spark: SparkSession, extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """``license_id, digest, first, last, least, most`` of the known texts: grants by rule, whole texts, and ``extra (id,
    text)``; ``first`` and ``last`` are the first and last word of the canonical form, ``least`` and ``most`` bound the
    number of words that an equal text has before it is normalised."""
    rows = [(i, g.format(n)) for i, names in NAMES.items() for n in names for g in GRANTS]
    rows += [(i, f"SPDX-License-Identifier: {i}") for i in NAMES] + list(TEXTS.items()) + whole_texts() + (extra or [])
    d = spark.createDataFrame(rows, "license_id string, text string").select("license_id", "text", canonical(F.col("text")).alias("form"))
    n = F.regexp_count("form", F.lit(r"[^ ]+"))
    # "&" becomes a word; "the", "version", "non" and the parts of an address before its name go
    least = n - F.regexp_count("form", F.lit(r"\band\b"))
    most = n + F.regexp_count("form", F.lit(r"\b(?:software|v[0-9]+|noncommercial)\b")) + 2 * F.regexp_count("text", F.lit(r"://|[\p{L}\p{N}]\.[\p{L}]"))
    d = d.withColumns({"least": least, "most": most})
    return d.groupBy(F.sha2("form", 256).alias("digest")).agg(
        F.min("license_id").alias("license_id"), F.min(F.substring_index("form", " ", 1)).alias("first"), F.min(F.substring_index("form", " ", -1)).alias("last"), F.min("least").alias("least"), F.max("most").alias("most")
    )


def first_word(unit: Column) -> Column:
    """The first word, lower-cased, of the first line that is more than a copyright claim or the mark of a link; null
    if none is."""
    lines = F.transform(F.filter(F.split(unit, "\n"), lambda x: x.rlike(_NO_WORD) & ~x.rlike(_CLAIM)), lambda x: F.regexp_replace(x, LINK, ""))
    return F.lower(F.regexp_extract(F.get(F.filter(lines, lambda x: x.rlike(_NO_WORD)), F.lit(0)), r"([\p{L}\p{N}]+)", 1))


def _changed(word: Column, changes) -> Column:
    out = word
    for pattern, to in changes:
        out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, to)).otherwise(out)
    return out


def _once(value: Column, f) -> Column:
    """``f(value)``, the value computed once for all its uses."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def begins(word: Column) -> Column:
    """The same for all first words that the rules may make equal."""
    return _changed(word, CHANGES)


def may_begin(text: Column, words: list[str]) -> Column:
    """Whether any line of a text begins with a word that ``begins`` makes one of ``words``: one plain search, as most
    texts have no such line, and every unit begins like one of its lines. Never false for a text with such a unit."""
    parts = list(words)
    if any("license" in w for w in words):
        parts.append(r"\p{L}*licen[cs]\p{L}*")
    parts += [p for p, to in (("the", "software"), ("merchantibility", "merchantability"), ("non", "noncommercial")) if to in words]
    if any(w.startswith("v") for w in words):
        parts.append(r"v(?:er(?:sion)?)?[0-9]*")
    return text.rlike(r"(?iudm)^[^\p{L}\p{N}\n]*+(?:https?://(?:www\.)?[^\p{L}\p{N}\n]*+)*+(?:" + "|".join(sorted(set(parts))) + r")(?![\p{L}\p{N}])")


def units(docs: DataFrame) -> DataFrame:
    """``doc_id, scope, unit``: the document, its blocks (if several) and its lines (if several), all whole."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blocks = F.split(text, r"\n[ \t\r]*\n")
    lines = F.split(text, "\n")
    one = lambda scope: lambda u: F.struct(F.lit(scope).alias("scope"), u.alias("unit"))
    none = F.filter(F.transform(F.array(text), one("document")), lambda _: F.lit(False))
    every = F.concat(
        F.transform(F.array(text), one("document")),
        F.when(F.size(blocks) > 1, F.transform(blocks, one("block"))).otherwise(none),
        F.when(F.size(lines) > 1, F.transform(lines, one("line"))).otherwise(none),
    )
    return docs.select("doc_id", F.explode(every).alias("u")).select("doc_id", "u.scope", "u.unit")


def runs(docs: DataFrame, sizes: dict[str, list[tuple[int, int]]], lasts: dict[str, list[str]]) -> DataFrame:
    """``doc_id, scope, unit``: rows of two or more lines that begin and end like a known text and have as many words.

    ``sizes`` gives by first word (as ``begins`` tells it) the ranges of numbers of words, ``lasts`` the last words of
    the forms. Lines without a word and lines that only claim copyright are in no form, so they are passed over and not
    counted. Each line is looked at once: for its number of words, its first and its last. A row does not begin or end
    with a line that is but the mark of a link, as its form is that of the row without it. Scope is ``blocks`` if the
    row consists of whole blocks, else ``lines``; rows that are the document or one block are units already.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.flatten(F.transform(F.split(text, r"\n[ \t\r]*\n"), lambda b, i: F.transform(F.split(b, "\n"), lambda x: F.struct(i.alias("block"), x.alias("line")))))
    after = lambda xs, i: F.coalesce(F.get(xs, i + 1)["line"], F.lit(""))
    kept = lambda xs: F.filter(xs, lambda x, i: x["line"].rlike(_NO_WORD) & ~(x["line"].rlike(_CLAIM) & F.concat(x["line"], F.lit("\n"), after(xs, i)).rlike(_CLAIM_BEFORE)))
    d = docs.select("doc_id", F.get(F.transform(F.array(every), kept), F.lit(0)).alias("lines")).where(F.size("lines") > 2)
    # words first, then what the rules make of them: within one expression a word would be told anew for each rule
    words = F.transform(F.transform("lines", lambda x: F.lower(F.regexp_extract(F.regexp_replace(x["line"], LINK, ""), r"([\p{L}\p{N}]+)", 1))), begins)
    per_word = lambda of, one: F.create_map(*(c for w, xs in of.items() for c in (F.lit(w), F.array(*map(one, xs)))))
    of, ends_of = per_word(sizes, lambda r: F.struct(F.lit(r[0]).alias("least"), F.lit(r[1]).alias("most"))), per_word(lasts, F.lit)
    starts = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda a: F.map_contains_key(of, a["word"]))
    d = d.select("doc_id", "lines", F.transform(starts, lambda a: F.struct(a["at"].alias("at"), F.element_at(of, a["word"]).alias("sizes"), F.element_at(ends_of, a["word"]).alias("lasts"))).alias("starts")).where(F.size("starts") > 0)
    end = lambda x: F.right(F.regexp_replace(F.regexp_replace(x["line"], LINK, ""), r"[^\p{L}\p{N}]++$", ""), F.lit(LONGEST_LAST))
    last = F.transform(F.transform("lines", lambda x: F.lower(F.regexp_extract(end(x), r"([\p{L}\p{N}]+)$", 1))), lambda w: _changed(w, ENDINGS))
    facts = F.arrays_zip(F.transform("lines", lambda x: F.regexp_count(x["line"], F.lit(r"[\p{L}\p{N}]+"))).alias("n"), last.alias("last"))
    # bound once for all starts: as a column it would be computed again wherever it is used
    lines, total = F.col("lines"), F.size("lines")

    def ends(a: Column, facts: Column) -> Column:
        """Numbers of lines of the rows that start at ``a``."""
        most = F.element_at(a["sizes"], -1)["most"]

        def add(acc: Column, x: Column) -> Column:
            n, k = acc["n"] + x["n"], acc["k"] + 1
            fits = (k > 1) & (k < total) & F.exists(a["sizes"], lambda s: n.between(s["least"], s["most"]))
            # a rule may put letters before the last word (v2, noncommercial), and a sign may stand for "and"
            fits = fits & (x["last"] != "") & F.exists(a["lasts"], lambda w: F.endswith(w, x["last"]) | (w == "and"))
            return F.when(acc["n"] > most, acc).otherwise(F.struct(n.alias("n"), k.alias("k"), F.when(fits, F.array_append(acc["found"], k)).otherwise(acc["found"]).alias("found")))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("found"))
        return F.aggregate(F.slice(facts, a["at"] + 1, most + 1), zero, add, lambda acc: acc["found"])

    def unit(a: Column, k: Column) -> Column:
        block = lambda i: F.get(lines, i)["block"]
        first, last = a["at"], a["at"] + k - 1
        whole = ~block(first).eqNullSafe(block(first - 1)) & ~block(last).eqNullSafe(block(last + 1))
        scope = F.when(whole & (block(first) == block(last)), "block").when(whole, "blocks").otherwise("lines")
        return F.struct(scope.alias("scope"), F.array_join(F.transform(F.slice(lines, first + 1, k), lambda x: x["line"]), "\n").alias("unit"))

    found = F.get(F.transform(F.array(facts), lambda f: F.flatten(F.transform("starts", lambda a: F.transform(ends(a, f), lambda k: unit(a, k))))), F.lit(0))
    return d.select("doc_id", F.explode(found).alias("u")).select("doc_id", "u.scope", "u.unit").where("scope <> 'block'")


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges in order that cover the same whole numbers."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def licenses(docs: DataFrame, known_digests: DataFrame) -> DataFrame:
    """``doc_id, license_id, scope, n_hits``: units of each document that are a known licence text.

    ``known_digests`` has one row a digest and is of fixed size here, so it is broadcast if Spark sees it to be
    small. Null and empty texts, and units without a letter or digit, match nothing; repeated rows of docs count
    again. Documents without a match give no row.
    """
    ranges: dict[str, list[tuple[int, int]]] = defaultdict(list)  # one at most for each known text
    lasts: dict[str, set[str]] = defaultdict(set)
    for r in known_digests.select(begins(F.col("first")).alias("first"), "last", "least", "most").distinct().collect():
        ranges[r["first"]].append((r["least"], r["most"]))
        lasts[r["first"]].add(r["last"])
    if not ranges:
        ranges[""], lasts[""] = [(0, 0)], {""}
    docs = docs.select("doc_id", "text").where(may_begin(F.col("text"), list(ranges)))
    # a unit whose form begins with another word than every known form cannot be equal to one
    u = units(docs).where(_once(first_word(F.col("unit")), begins).isin(*ranges))
    u = u.union(runs(docs, {w: _merged(rs) for w, rs in ranges.items()}, {w: sorted(x) for w, x in lasts.items()}))
    u = u.withColumn("form", canonical(F.col("unit"))).where("form <> ''")
    hits = u.select("doc_id", "scope", F.sha2("form", 256).alias("digest")).join(known_digests.select("digest", "license_id"), "digest")
    return hits.groupBy("doc_id", "license_id", "scope").agg(F.count("*").alias("n_hits"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = known(spark)  # a fixed list of a few hundred rows, not a table that grows
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.broadcast(digests))
