"""Whitening, the Merkle manifest and nearest neighbours against brute force and edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from procflow.llm import ann, merkle, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, size string, tree string"
VECS = "vec_id long, embedding array<double>, label int, x string, region string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(doc_id, source, lang, n_chars, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def slow_tree(leaves):
    """Root, and for each leaf the (left, right) siblings upwards."""
    paths = [[] for _ in leaves]
    level = [(d, [i]) for i, d in enumerate(leaves)]
    while len(level) > 1:
        up = []
        for a in range(0, len(level), 16):
            run = level[a : a + 16]
            for j, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
            up.append((digest(*(d for d, _ in run)), [i for _, below in run for i in below]))
        level = up
    return level[0][0], paths


def slow_proofs(rows):
    """The rows of op12 from (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        shown = text if text is None or not hit else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        groups[source].append((doc_id, slow_leaf(doc_id, source, lang, n, text), slow_leaf(doc_id, source, lang, n, shown)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for s in order}
    made = {s: slow_tree([r[1] for r in t]) for s, t in trees.items()}
    root, tops = slow_tree([made[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (doc_id, leaf, start), path in zip(trees[s], made[s][1], strict=True):
            fold, proof = start, ""
            for left, right in path + tops[k]:
                fold, proof = digest(left, fold, right), proof + left + right
            out.append((doc_id, leaf, made[s][0], root, digest(proof), fold, fold == root))
    return out


def documents(n=700, sources=20, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = rng.choice([None, "", "Straße IN " + "x" * k, f"Text {k}", f"lower {k}"])
        source = "hot" if k % 3 else rng.choice([None, "", "r", "n", *[f"s{j}" for j in range(sources)]])
        rows.append((k, text, rng.choice(["en", None]), source, None if text is None else len(text), "a", "b", "c"))
    rows += [rows[1]] * 40 + [rows[7]]
    rows += [(None, "No id", None, "hot", 5, "a", "b", "c")] * 2 + [(9, "Other text of id 9", "en", rows[9][3], 1, "a", "b", "c")]
    rows.append((n + 5, "LONG " * 100_000, "en", "alone", 500_000, "a", "b", "c"))
    return rows


def op12(spark, rows):
    d = spark.createDataFrame(rows, DOCS)
    p = merkle.prove(d, merkle.lower_cased(d["doc_id"], d["text"]))
    return [tuple(r) for r in p.selectExpr("doc_id", "leaf", "subroot", "root", "sha2(proof, 256)", "folded_root", "verified").collect()]


def test_manifest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RUNS_PER_COPY", 1)  # so that nodes have copies
    rows = documents()
    key = lambda r: tuple(str(x) for x in r)
    want = slow_proofs([r[:5] for r in rows])
    got = op12(spark, rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(7, "T", None, None, 1, "", "", "")], [(k, "T", None, "s", 1, "", "", "") for k in range(17)], [(k, "T", None, "s", 1, "", "", "") for k in range(257)], [(k, "T", None, str(k), 1, "", "", "") for k in range(3)]])
def test_manifest_of_few_rows(spark, rows):
    want = slow_proofs([r[:5] for r in rows]) if rows else []
    assert sorted(op12(spark, rows), key=str) == sorted(want, key=str)


def test_manifest_stores_linked_nodes_and_restores_the_limit(spark):
    rows = documents(300)
    was = spark.conf.get("spark.sql.cteRecursionRowLimit")
    runs, nodes, root = merkle.build(spark.createDataFrame(rows, DOCS))
    merkle.climb(runs, nodes)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == was
    at = {(r["tree"], r["level"], r["idx"]): r for r in nodes.collect()}
    assert [r["digest"].hex() for r in at.values() if r["up_tree"] is None] == [root]
    for r in at.values():
        if r["up_tree"] is not None:
            up = at[r["up_tree"], r["up_level"], r["up_idx"]]
            assert up["children"][32 * r["slot"] :][:32] == r["digest"]


def test_inertia_counts_eigenvalues_below():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 9, 40):
        a = rng.standard_normal((n, n))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for s in (e[0] - 1, e[n // 2] + 1e-8, 0.0, e[-1] + 1):
            assert whitening.below(a, s) == (e < s).sum()
    assert whitening.below(np.array([[0.0, 1], [1, 0]]), 0) == 1  # needs a block of two
    assert whitening.below(np.zeros((3, 3)), 0) == 0


@pytest.mark.parametrize("e", [[5.0, 4, 3, 2, 1], [3.0] * 20, [1.0] * 3 + [0.5] * 17 + [0.0] * 4, [1e6, 1, 1e-6, 0], [2.0], [0.0, 0.0], [7, *np.linspace(1, 1.001, 30)]])
def test_components_by_contours_equal_a_dense_solver(e):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((len(e), len(e))))[0]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    got, x = whitening.principal(v)
    want = sorted((t for t in e if t > 1e-13 * max(e)), reverse=True)[:16]
    assert np.allclose(got, want, rtol=1e-9)
    assert np.allclose(x.T @ x, np.eye(len(got)), atol=1e-9) and np.allclose(v @ x, x * got, atol=1e-12 * max(e))


def test_missed_eigenvalues_are_an_error_not_a_result():
    with pytest.raises(RuntimeError):
        whitening.feast(np.diag([1.0, 2.0, 9.0]), 0.5, 2.5, 3, 9.0)


def vectors(seed=0, n=400, dim=6):
    rng = np.random.default_rng(seed)
    v = (rng.standard_normal((n, dim)) * [3, 2, 1, 1, 0.5, 0.1]).tolist()
    v += [v[3]] * 200  # a hot copy
    rows = [(k, x, 0, "clash", "clash") for k, x in enumerate(v)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0] * 5, [1.0, None, 0.0, 0.0, 0.0, 0.0], [nan] + [1.0] * 5, [1.0] * 5 + [inf]]
    return rows + [(10_000 + k, x, 0, "", "") for k, x in enumerate(bad)] + [rows[7], (None, v[8], 0, "", "")], v


def test_whitening_equals_a_dense_solver(spark):
    rows, v = vectors()
    got = whitening.whiten(spark.createDataFrame(rows, VECS)).toPandas()
    x = np.floor(np.array(v) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    cov = np.cov((fit - 1_000_000).T.astype(float), bias=True)
    e, p = np.linalg.eigh(cov)
    e, p = e[::-1], p[:, ::-1]
    assert len(got) == 6 * (len(v) + 2) and set(got["component"]) == set(range(1, 7)) and (got["n"] == n).all()
    want = (x * n - s) / n @ p / np.sqrt(e)
    own = got[got["vec_id"].notna() & (got["vec_id"] < 10_000)]
    at = own["vec_id"].astype(int).to_numpy()
    assert [int(t) for t in own["deviation"]] == (((n * x - s) ** 2).sum(axis=1)[at]).tolist()
    for c in range(6):
        k = (own["component"] == c + 1).to_numpy()
        a, b = own["whitened"].to_numpy()[k], want[at[k], c]
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-9
    assert np.allclose(got.groupby("component")["explained"].first(), e / e.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_large_entries_is_exact(spark):
    rows = [(k, [float(k) * 1e8, 1.0 - k % 3], 0, "", "") for k in range(9)] + [(99, [1e30, 1.0], 0, "", "")]
    got = whitening.whiten(spark.createDataFrame(rows, VECS)).toPandas()
    x = [[int(c * 64 // 1) + 1_000_000 for c in r[1]] for r in rows[:9]]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {k: sum((9 * c - t) ** 2 for c, t in zip(r, s, strict=True)) for k, r in enumerate(x)}
    assert {int(r.vec_id): int(r.deviation) for r in got.itertuples()} == want


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0, "", "")], [(k, [1.0, 2.0], 0, "", "") for k in range(5)], [(1, None, 0, "", "")]])
def test_whitening_without_spread_gives_no_rows(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, VECS)).collect() == []


def test_chi_square_law():
    assert abs(ann.chi_square_cdf(3.84145882, 1) - 0.95) < 1e-8 and abs(ann.chi_square_quantile(0.95, 8) - 15.50731306) < 1e-6


def slow_nearest(rows, queries, k=5):
    """(-score, vec_id) of the k nearest, by id, scores added from the first component on."""
    v = {}
    for vec_id, x in rows:
        v.setdefault(vec_id, []).append(x)
    cosine = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True)) / (sum(p * p for p in a) ** 0.5 * sum(q * q for q in b) ** 0.5)
    return {q: sorted((-max(cosine(a, b) for a in v[q] for b in xs), i) for i, xs in v.items() if i != q)[:k] for q in v if q in queries}


def test_nearest_equals_brute_force_on_clustered_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "PIECE_VALUES", 6 * 64)
    monkeypatch.setattr(ann, "LEAF_ROWS", 16)
    monkeypatch.setattr(ann, "VISITS_PER_COPY", 5)
    rows, v = vectors(2, n=900)
    got = ann.nearest(spark.createDataFrame(rows, VECS), "vec_id % 50 = 0").collect()
    ids = {k for k in range(0, len(v), 50)}
    want = slow_nearest(list(enumerate(v)), ids)
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == ids and all([t[0] for t in sorted(x)] == [1, 2, 3, 4, 5] for x in by.values())
    hits = sum(len({t[1] for t in by[q]} & {i for _, i in want[q]}) for q in ids)
    assert hits >= 0.9 * 5 * len(ids)
    for q in ids:
        for _, i, score in by[q]:
            a, b = np.array(v[q]), np.array(v[i])
            assert abs(score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_nearest_breaks_ties_by_id_among_many_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "PIECE_VALUES", 3 * 32)
    rng = np.random.default_rng(5)
    copy = rng.standard_normal(3).tolist()
    rows = [(k, copy if k % 3 else (rng.standard_normal(3)).tolist(), 0, "", "") for k in range(0, 3000)]
    got = ann.nearest(spark.createDataFrame(rows, VECS), "vec_id % 50 = 0").collect()
    mine = {}
    for r in got:
        mine.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q, x in mine.items():
        if q % 3:
            assert [i for _, i in sorted(x)] == [i for i in range(20) if i % 3 and i != q][:5]


def test_nearest_of_few_rows_and_of_odd_rows(spark):
    near = lambda rows: sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, VECS), "vec_id % 50 = 0").collect())
    assert near([]) == [] and near([(0, None, 0, "", "")]) == [] and near([(0, [1.0, 0.0], 0, "", "")]) == []
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 0, "", ""), (1, [1e200, 1e200], 0, "", ""), (2, [-1e-200, 0.0], 0, "", ""), (3, [0.0, 0.0], 0, "", ""), (4, [nan, 1.0], 0, "", ""), (5, [1.0, None], 0, "", ""), (6, [1.0], 0, "", ""), (None, [1.0, 0.0], 0, "", ""), (1, [1e200, 1e200], 0, "", "")]
    got = near(rows)
    assert [(r[0], r[1], r[2]) for r in got] == [(0, 1, 1), (0, 2, 2)]
    assert abs(got[0][3] - 0.5**0.5) < 1e-15 and got[1][3] == -1.0
