"""Groups of near fingerprints without all their pairs, against all pairs."""

import itertools
import random

import numpy as np
import pytest

from procflow.llm import simhash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def ball(centre, radius):
    """All fingerprints within ``radius`` bits of one."""
    return {centre ^ sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(64), r)}


def slow_roots(fps):
    """The smallest fingerprint reachable over all pairs of at most four bits."""
    fps = sorted(fps, key=signed)
    u = np.array(fps, dtype=np.uint64)
    root = np.arange(len(fps))
    moved = True
    while moved:
        moved = False
        for k in range(len(u)):
            near = np.bitwise_count(u ^ u[k]) <= 4
            low = root[near].min()
            if (root[near] != low).any():
                root[near], moved = low, True
    return {signed(x): signed(fps[root[k]]) for k, x in enumerate(fps)}


def table(spark, fps):
    return spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(4)


@pytest.mark.parametrize(("fine", "dense", "sent"), [(False, 64, 100_000), (False, 1, 100_000), (True, 3, 0)])
def test_groups_against_all_pairs(spark, monkeypatch, fine, dense, sent):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", sent)
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(25)}
    x = rng.getrandbits(64)
    for _ in range(60):  # a chain, of which only neighbours are near
        x ^= sum(1 << k for k in rng.sample(range(64), rng.randint(3, 4)))
        fps.add(x)
    fps |= {0, (1 << 64) - 1, rng.getrandbits(64)} | set(itertools.islice(ball(rng.getrandbits(64), 2), 300))
    got = {r.fp: r.root for r in simhash.groups(table(spark, fps), fine=fine).collect()}
    assert got == slow_roots(fps)


def test_a_dense_group_gives_far_fewer_rows_than_pairs(spark):
    rng = random.Random(12)
    dense = sorted(ball(rng.getrandbits(64), 2))  # 2,081, all of them near each other
    fps = dense + [rng.getrandbits(64) for _ in range(50)]
    df = table(spark, fps)
    assert simhash.stars(df, 4, False).count() < 30 * len(fps)
    assert {r.fp: r.root for r in simhash.groups(df).collect()} == slow_roots(fps)


def test_a_group_of_twenty_thousand(spark):
    rng = random.Random(13)
    centre = rng.getrandbits(64)
    fps = {centre} | set(rng.sample(sorted(ball(centre, 3)), 20_000))
    df = table(spark, fps)
    assert simhash.stars(df, 4, False).count() < 30 * len(fps)
    assert {r.root for r in simhash.groups(df).collect()} == {min(map(signed, fps))}


def test_no_groups(spark):
    none = spark.createDataFrame([], "fp long")
    assert simhash.groups(none).count() == 0
    assert [tuple(r) for r in simhash.groups(table(spark, [5])).collect()] == [(5, 5)]


def test_keys_are_not_broadcast_by_the_size_of_their_fingerprints(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        table(spark, range(1000)).write.parquet(f"{tmp_path}/fps")
        df = spark.read.parquet(f"{tmp_path}/fps")  # of files Spark knows the size
        plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
        for d in (simhash.stars(df, 4, False), simhash.links(df)):
            assert "SortMergeJoin" in plan(d) and "Broadcast" not in plan(d)
        rooted = df.select("fp", df.fp.alias("root"))
        p = plan(simhash.bridges(rooted, 4, False))
        # the few dense keys are sent, the keys of all fingerprints meet by shuffle
        assert p.count("SortMergeJoin") == 1 and p.count("BroadcastHashJoin") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
