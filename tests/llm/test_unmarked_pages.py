"""Pages of which none marks its article."""

import pytest
from pyspark.sql import functions as F

from procflow.llm import html_extract

PAGES = "/root/testdata/sf0.01/pages.parquet"


def test_recall_and_precision_without_any_mark(spark):
    marked = spark.read.parquet(PAGES)
    truth = {r.page_id: [(b.text, b.main) for b in html_extract.blocks(r.html)] for r in marked.collect()}
    plain = marked.withColumn("html", F.regexp_replace("html", "(?i)<(/?)article\\b", "<$1div"))
    assert plain.where(F.contains(F.lower("html"), F.lit("<article"))).count() == 0
    with pytest.warns(UserWarning, match="weak labels"):
        got = {r.page_id: r.text.split("\n\n") if r.text else [] for r in html_extract.extract(plain).collect()}
    hit = sum(len([t for t, m in bs if m]) for bs in truth.values())
    found = sum(len(x) for x in got.values())
    right = sum(sum(1 for t in got[k] if (t, True) in bs) for k, bs in truth.items())
    assert len(got) == len(truth) and right >= 0.9 * hit and right >= 0.9 * found


def test_weak_labels():
    page = (
        "<head><title>A head.</title></head><div class='menu'><p>Pick one. Or two.</p></div><h1>A head</h1><p>It begins here, with words, and has more to say than all that is set into it by others, links and stray lines alike.</p>"
        "<ul><li><a href=/>Read this. And this one.</a></li></ul><p>short</p><p>It goes on for a good while after that, with enough sentences to make up for the links and the stray line before it, and only then it ends.</p><div class=comments><p>First! I was here before all of you, and long.</p></div><div>imprint</div>"
    )
    bs = html_extract.blocks(page)
    assert [b.text for b, y in zip(bs, html_extract.weak_labels(bs)) if y] == ["A head", "It begins here, with words, and has more to say than all that is set into it by others, links and stray lines alike.", "short", "It goes on for a good while after that, with enough sentences to make up for the links and the stray line before it, and only then it ends."]
    held = html_extract.blocks("<p>One sentence outside, and it is the longest of all of them here.</p><main><p>Inside.</p></main>")
    assert html_extract.weak_labels(held) == [0, 1]
    named = html_extract.blocks("<body class=header><h2>T</h2><p>Some words. More.</p></body>")
    assert html_extract.weak_labels(named) == [1, 1]
    assert html_extract.weak_labels([]) == [] and html_extract.weak_labels(html_extract.blocks("<p>no stop</p>")) == [0]


def test_unmarked_pages_are_the_same_on_every_run(spark):
    rows = [(k, f"<p>Page {k}.</p>") for k in range(300)] + [(None, "<p>x</p>"), (400, None), (401, ""), (5, "<p>Another page 5.</p>")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    some = html_extract.unmarked_pages(pages, 20)
    assert len(some) == 20 and some == html_extract.unmarked_pages(pages.repartition(7), 20)
    assert html_extract.unmarked_pages(pages.limit(0), 20) == []


def test_end_tags_beyond_the_deepest_level_close_nothing_else():
    deep = html_extract.MAX_DEPTH + 40
    inner = "<section>" * 41 + "low" + "</section>" * 41
    page = "<article><section><p>a</p>" + "<span>" * (deep - 43) + inner + "</span>" * (deep - 43) + "<p>b</p></section><p>c</p></article><p>d</p>"
    bs = html_extract.blocks(page)
    assert [(b.text, b.main, "section" in b.above) for b in bs if b.text != "low"] == [("a", True, True), ("b", True, True), ("c", True, False), ("d", False, False)]
