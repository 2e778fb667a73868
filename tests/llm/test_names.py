"""Columns of a user that bear the names of ours, and tables of odd rows, through sharding, near copies and the pipeline."""

import pytest

from procflow.llm import sharding, simhash

CLASH = "doc_id long, text string, lang string, source string, n_chars long, __size string, shard string, __shard string, __row string, __text string, `a.b` string, slot string"


def rows(n=40):
    out = [(k, f"text number {k % 9} of some words {'x' * k}", "en", "s", k, "own", f"mine{k}", "s1", "r", "t", "dot", "z") for k in range(n)]
    nothing = (None,) * 12
    return out + [nothing, nothing, (3, "", None, None, 0, *["e"] * 7), (4, "Ü" * 50_000, "de", None, 1, *["l"] * 7), out[5], out[5]]


def test_sharding_keeps_columns_of_its_own_names(spark):
    docs = spark.createDataFrame(rows(), CLASH)
    d = sharding.shard_by_hilbert(docs, 4)
    assert d.columns == [*docs.columns, "___size", "__cell", "___shard", "__slot", "__rows"]
    got = d.collect()
    assert sorted(map(str, (tuple(r)[:12] for r in got))) == sorted(map(str, rows()))
    slots = sorted((r["___shard"], r["__slot"]) for r in got)
    sizes = [sum(1 for s, _ in slots if s == k) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1 and slots == [(k, j) for k in range(4) for j in range(sizes[k])]
    assert sharding.shard_by_hilbert(docs.where("false")).collect() == []


def test_near_copies_keep_columns_of_their_own_names(spark):
    docs = spark.createDataFrame(rows(), CLASH)
    d = simhash.deduplicate(docs)
    assert d.columns == docs.columns
    got = d.collect()
    assert {tuple(map(str, r)) for r in got} <= {tuple(map(str, r)) for r in rows()} and all(r["__text"] in ("t", "e", "l", None) for r in got)


@pytest.mark.parametrize("some", [True, False])
def test_sharding_stage_can_be_written(spark, tmp_path, some):
    import corpus_pipeline

    docs = spark.createDataFrame(rows(), CLASH)
    out = corpus_pipeline.sharding_stage(spark, docs if some else docs.where("false"), "")
    out.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*docs.columns, "_shard", "_slot"] and back.count() == (len(rows()) if some else 0)
