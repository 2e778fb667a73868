"""Rows of lines in license scans: the same as all rows without any filter, and in linear time."""

import random
import re
import textwrap
import time

from pyspark.sql import functions as F

from procflow.llm import license_scan as S

EXTRA = [("X-1", "http://www.example.org/terms apply to this noncommercial"), ("X-2", "gnu terms version 2"), ("X-3", "the software of the copyright owners")]


def every_row(text):
    """All rows of two lines or more that are not the whole, of lines that are in a form at all."""
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\W_]", x) and not re.search(r"(?i)^[^\w\n]*(copyright \(c\)|\(c\))", x)]
    return ["\n".join(lines[a:z]) for a in range(len(lines)) for z in range(a + 2, len(lines) + 1) if z - a < len(lines)]


def documents():
    rng = random.Random(0)
    parts = [
        *textwrap.wrap(S.TEXTS["ISC"].split("\n\n")[0], 60), "released under the MIT", "License", "https://", "http://www.", "http://www.apache.org/x", "https://www.example.org/terms apply", "HTTP://example.org/terms apply to", "to this non-commercial", "this noncommercial",
        "This work is licenced under the Apache Licence,", "version 2.0", "GNU terms v.2", "gnu terms", "version 2", "The", "software of the", "copyright holders", "copyright owners", "# distributed under the", "/* GNU General Public License, ver. 3 */", "(c) 2020 me", "", "words", "available under MIT & more",
    ]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(120)]
    for k in range(0, 120, 4):  # wrapped texts that are known, between other lines
        known = rng.choice([x for _, x in EXTRA] + [S.GRANTS[0].format("the MIT License"), S.GRANTS[4].format("the GNU General Public License, version 3")])
        cuts = textwrap.wrap(known, rng.choice([12, 20, 33]))
        texts[k] = "\n".join([*rng.choices(parts, k=2), *cuts, *rng.choices(parts, k=2)])
    return texts


def test_rows_equal_all_rows_without_filters(spark):
    texts = documents()
    known = S.known(spark, EXTRA)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license_id) for r in S.licenses(docs, known).collect()}
    rows = spark.createDataFrame([(k, u) for k, t in enumerate(texts) for u in every_row(t)], "doc_id long, unit string").unionByName(S.units(docs).select("doc_id", "unit"))
    forms = rows.select("doc_id", S.canonical(F.col("unit")).alias("form")).where("form <> ''")
    want = {tuple(r) for r in forms.join(known, F.sha2("form", 256) == F.col("digest")).select("doc_id", "license_id").distinct().collect()}
    assert got == want and {x for _, x in want} >= {"X-1", "X-2", "X-3", "MIT", "GPL-3.0"}


def test_lists_of_links_and_of_first_words_take_linear_time(spark):
    known = S.known(spark)
    lists = {
        "links": "\n".join(f"https://www.example.org/page/{k} a page" for k in range(10_000)),
        "marks": "http://\n" * 10_000,
        "this": "\n".join(f"This line is number {k} of many" for k in range(10_000)),
        "released": "\n".join(f"Released item {k}" for k in range(10_000)),
    }
    docs = spark.createDataFrame(list(lists.items()), "doc_id string, text string").coalesce(1)
    S.licenses(docs.where("false"), known).collect()
    for name in lists:
        one = spark.createDataFrame([(name, lists[name])], "doc_id string, text string").coalesce(1)
        began = time.time()
        assert S.licenses(one, known).collect() == []
        took = time.time() - began
        print(name, round(took, 2))
        assert took < (8 if name in ("links", "marks") else 30)
