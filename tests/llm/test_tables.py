"""Secrets and quality rules over whole tables against slow versions; odd tables through several operators."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from procflow.llm import chat_format, decontaminate, quality_rules, secret_scan

CLASH = "doc_id long, text string, spans string, kept string, n_words string, leaf string"


def runs(text, letters, least):
    """Maximal runs of some letters, by one look at each character."""
    out, at = [], None
    for i, c in enumerate(text + "\n"):
        if c in letters:
            at = i if at is None else at
        elif at is not None:
            if i - at >= least:
                out.append((at, i))
            at = None
    return out


HEX, UPPER = set("0123456789abcdef"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def slow_base(text):
    out = [(a, b, "hex") for a, b in runs(text, HEX, 24)]
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        end = at + 4
        while end < len(text) and text[end] in UPPER:
            end += 1
        if end > at + 4:
            out += [(at, end, "access")] * (end - at >= 20)
            at = end
        else:
            at += 1
    at, low = 0, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    while at < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, at)), None)
        end = None
        if word:
            i = at + len(word)
            i += i < len(text) and text[i] in "\"'"
            while i < len(text) and text[i] == " ":
                i += 1
            if i < len(text) and text[i] in ":=":
                i += 1
                while i < len(text) and text[i] == " ":
                    i += 1
                # the quote may be there; without it the value would begin with it, which it cannot
                i += i < len(text) and text[i] in "\"'"
                z = i
                while z < len(text) and text[z] in VALUE:
                    z += 1
                if z > i:
                    end = z
                    if z - i >= 6:
                        out.append((at, z, "assign"))
        at = end if end else at + 1
    kinds = ("assign", "access", "hex")
    return sorted(out, key=lambda x: (x[0], kinds.index(x[2])))


def slow_entropy(s, window, bits):
    """Windows whose entropy is high enough, each counted by itself, joined."""
    good = [i for i in range(len(s) - window + 1) if -sum(n / window * math.log2(n / window) for n in Counter(s[i : i + window]).values()) >= bits - 1e-9]
    out = []
    for i in good:
        if out and out[-1][1] >= i:
            out[-1] = (out[-1][0], i + window)
        else:
            out.append((i, i + window))
    return out


def slow_scan(text):
    """All spans, by the classes as the module declares them, with slow windows and slow overlaps."""
    base = slow_base(text)
    more = []

    def look(candidates, kind, part, rule):
        new = []
        for x, y in candidates:
            if secret_scan.allowed(text[x:y], part):
                continue
            for a, b in slow_entropy(text[x:y], *rule(y - x)):
                a, b = a + x, b + x
                if not secret_scan.allowed(text[a:b], part) and not any(p < b and a < q for p, q, _ in base + more):
                    new.append((a, b, kind))
        more.extend(new)

    kind, run, *rule = secret_scan.HEX_CLASS
    look([m.span() for m in run.finditer(text)], kind, 3, lambda _: tuple(rule))
    wide = [m.span() for m in secret_scan.RUN.finditer(text) if not any(p.fullmatch(m[0]) for p in secret_scan.NAMED)]
    for c in secret_scan.CLASSES:
        look(wide if c.run is secret_scan.RUN else [m.span() for a, b in wide for m in c.run.finditer(text, a, b)], c.kind, c.part, c.rule)
    return base, sorted(base + more, key=lambda x: (x[0], secret_scan.KINDS.index(x[2]), x[1]))


def secret_texts():
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    pick = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    bits = [
        lambda: pick(letters, rng.randint(10, 60)), lambda: pick("0123456789abcdef", rng.randint(20, 50)), lambda: pick("0123456789ABCDEF", 32), lambda: "AKIA" + pick("ABCDEFG123", rng.choice([3, 15, 16, 20])), lambda: "AKIA é", lambda: "AKIAAKIA" + pick("XYZ", 14),
        lambda: rng.choice(["password", "PassWd", "secret", "Token", "api_key", "apikey", "api-key"]) + rng.choice(["", "'", '"']) + rng.choice([":", " = ", "=", "  :  ", " "]) + rng.choice(["", "'", '"', "''"]) + pick(letters, rng.randint(1, 12)),
        lambda: "secret=token: abcdefg", lambda: "ordinary words stand here", lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "sha256:" + pick("0123456789abcdef", 64), lambda: pick("abcdefghijklmnopqrstuvwxyz0123456789", 20), lambda: "ſecret=abcdefgh K", lambda: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 26), lambda: "Größe 😀",
    ]
    return ["".join(rng.choice(bits)() + rng.choice([" ", "\n", ",", "", "é"]) for _ in range(rng.randint(1, 12))) for _ in range(150)]


def test_secrets_over_a_table_equal_a_slow_scanner(spark):
    texts = [*secret_texts(), None, "", "x" * 200_000, "password=" + "ab1" * 30_000]
    rows = [(k, t, "s", "k", "n", "l") for k, t in enumerate(texts)] + [(3, texts[3], "s", "k", "n", "l"), (None, "token=abcdef", "s", "k", "n", "l")]
    docs = spark.createDataFrame(rows, CLASH)
    got = sorted(map(str, (tuple(r) for r in secret_scan.secrets(docs).collect())))
    want = []
    for doc_id, t, *_ in rows:
        base, every = slow_scan(t or "") if len(t or "") < 10_000 else secret_scan.scan(t)
        n = Counter(k for _, _, k in base)
        join = lambda s: ",".join(f"{k}:{a}:{b}" for a, b, k in s)
        want.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(join(base).encode()).hexdigest(), join(every)))
    assert got == sorted(map(str, want))
    assert sum(len(w[5]) > 0 for w in want) > 60 and len({k.split(":")[0] for w in want for k in w[5].split(",") if k}) == len(secret_scan.KINDS)
    assert secret_scan.secrets(docs.where("false")).collect() == []


def slow_path(forest, t, x, node=0):
    """Where a row ends in a tree, by descending it."""
    if forest.feature[t, node] < 0:
        return forest.depth[t, node]
    return slow_path(forest, t, x, 2 * node + 1 + (x[forest.feature[t, node]] > forest.split[t, node]))


def quality_texts(n=260):
    rng = random.Random(11)
    out = []
    for k in range(n):
        w = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) + ("#%$" if k % 9 == 0 else "") for _ in range(rng.choice([20, 60, 90]))]
        out.append(rng.choice([" ", "\n"]).join(w))
    return [*out, None, "", " \n", "a b c " * 40, "word " * 60, "É " * 40_000]


def test_quality_over_a_table_equals_a_slow_forest(spark):
    texts = quality_texts()
    rows = [(k, t, "s", "k", "n", "l") for k, t in enumerate(texts)] + [(5, texts[5], "s", "k", "n", "l"), (None, texts[8], "s", "k", "n", "l")]
    docs = spark.createDataFrame(rows, CLASH)
    labels = spark.createDataFrame([(k, int(k % 9 != 0), 0) for k in range(200)] + [(9, 1, 0), (10, 0, 0), (None, 1, 0), (11, None, 0)], "doc_id long, quality int, toxic int")
    forest, threshold = quality_rules.fit(docs, labels)
    got = quality_rules.quality(docs, labels).collect()
    again = quality_rules.quality(docs.repartition(7), labels.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    usual = quality_rules.IsolationForest.usual(forest.size)
    by_id = {k: t for k, t, *_ in rows}
    for r in got:
        counts, features = quality_rules.statistics(by_id[r.doc_id])
        mean = np.mean([slow_path(forest, t, features) for t in range(len(forest.feature))])
        assert [r[c] for c in quality_rules.COUNTS] == counts and abs(r.anomaly - 2 ** (-mean / usual)) < 1e-9
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r.base_failed == failed and r.kept == (not failed and r.anomaly <= threshold)
    assert quality_rules.quality(docs.where("false"), labels).collect() == [] and len(quality_rules.quality(docs, labels.where("false")).collect()) == len(rows)


def test_path_lengths_are_those_of_the_splits():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((300, 3)), [[9, 9, 9]]])
    f = quality_rules.IsolationForest(x, trees=60, subsample=64)
    s = f.score(x)
    assert s.argmax() == 300 and 0 < s.min() and s.max() < 1
    one = quality_rules.IsolationForest(np.array([[1.0, 2.0]] * 5))  # equal rows still give a forest
    assert len(set(one.score(np.array([[1.0, 2.0]] * 3)))) == 1


def test_decontamination_of_odd_rows(spark):
    item = " ".join(f"q{k}" for k in range(40))
    long = " ".join(f"w{k % 997}" for k in range(60_000))
    rows = [(1, f"before {item} after"), (1, f"before {item} after"), (2, long), (3, long + " " + item), (4, None), (5, ""), (None, item), (6, "clean text")]
    docs = spark.createDataFrame([(k, t, "s", "k", "n", "l") for k, t in rows], CLASH)
    bench = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "")], "item_id long, text string")
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(map(str, (r.doc_id for r in left.collect()))) == ["2", "4", "5", "6"]
    assert decontaminate.decontaminate(docs.where("false"), bench).collect() == [] and decontaminate.decontaminate(docs, bench.where("false")).count() == len(rows)
