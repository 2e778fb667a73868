"""Secret scans: known forms by pattern, unknown ones by sliding-window entropy.

Candidate strings are the maximal runs of a character class; a window slides over each, character counts and the
sum of n log n change by two terms a step, and windows of high Shannon entropy are joined into spans. What is high
follows from the class: the entropy that random windows of its alphabet are expected to have, less some deviations.
Spans on the allow-list (identifiers that are not secret, digests of known use, sequences, words and paths by the
shape of their parts) are suppressed, as are spans that a known form already covers.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as [0-9a-f]+ of 24 characters or more


@lru_cache
def usual_bits(alphabet: int, window: int) -> tuple[float, float]:
    """Mean and standard deviation of the entropy of ``window`` random letters of an alphabet (exact sums)."""
    f = [n * math.log2(n) if n else 0.0 for n in range(window + 1)]
    p = 1 / alphabet
    one = [math.comb(window, n) * p**n * (1 - p) ** (window - n) for n in range(window + 1)]
    mean = sum(w * x for w, x in zip(one, f))
    two = sum(
        math.comb(window, n) * math.comb(window - n, m) * p ** (n + m) * (1 - 2 * p) ** (window - n - m) * f[n] * f[m]
        for n in range(window + 1)
        for m in range(window + 1 - n)
    )
    var = alphabet * (sum(w * x * x for w, x in zip(one, f)) - mean**2) + alphabet * (alphabet - 1) * (two - mean**2)
    return math.log2(window) - alphabet * mean / window, math.sqrt(max(var, 0.0)) / window


#: Windows, longest first; a run is judged by the longest that it holds.
WINDOWS = (24, 16)
#: Standard deviations by which a random window may fall short of the mean.
DEVIATIONS = 3.0


@dataclass(frozen=True)
class EntropyClass:
    """A character class: how candidates look, the size of its alphabet, the letters in a row that make a word part."""

    kind: str
    run: re.Pattern
    alphabet: int
    part: int

    def rule(self, length: int) -> tuple[int, float]:
        """The window for runs of a length, and the bits a character it must reach."""
        window = next((w for w in WINDOWS if length >= w), WINDOWS[-1])
        mean, deviation = usual_bits(self.alphabet, window)
        return window, mean - DEVIATIONS * deviation


#: Runs of hex digits: the window, and the bits a character it must reach.
HEX_CLASS = ("entropy_hex", re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{24,}(?![0-9A-Za-z])"), 24, 3.0)
#: Runs that the other classes look into.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CLASSES = (
    EntropyClass("entropy_base32", re.compile(r"(?<![0-9A-Za-z])(?=[A-Z]*[2-7])[A-Z2-7]{16,}(?![0-9A-Za-z])"), 32, 6),
    EntropyClass("entropy_lower", re.compile(r"(?<![0-9A-Za-z])(?=[a-z]*[0-9])(?![0-9a-f]+(?![a-z]))[a-z0-9]{16,}(?![0-9A-Za-z])"), 36, 6),
    EntropyClass("entropy_upper", re.compile(r"(?<![0-9A-Za-z])(?=[A-Z]*[0-9])(?![0-9A-F]+(?![A-Z]))[A-Z0-9]{16,}(?![0-9A-Za-z])"), 36, 6),
    EntropyClass("entropy_base64", RUN, 64, 3),
)
#: Order of kinds at one start.
KINDS = ("assign", "access", "hex", "entropy_hex", *(c.kind for c in CLASSES))
#: Strings that look random and are no secrets, nor is any part of them.
NAMED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"(?i)(sha(1|256|384|512)|md5)[-_:=].*"),  # a digest that says so
)
ALLOW = (
    *NAMED,
    re.compile(r"[a-z]+|[A-Z]+|[A-Z][a-z]+"),  # a word, or words run together
    re.compile(r"[0-9_/=+-]+"),  # numbers and rules
)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOWEL = re.compile(r"[aeiouy]", re.I)
_HARD = re.compile(r"[^aeiouy]{5}", re.I)
#: Share of the letters and digits that stand in word parts, from which a string is words or a path.
WORDS_SHARE = 0.7
_SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef", "qwertyuiop", "asdfghjkl")

_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, 4096)]


def entropy_spans(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Maximal joins of windows of ``s`` with at least ``bits`` bits a character, by incremental counts.

    H = log2(w) - sum(n log2 n) / w, so a step changes the sum by the terms of the character that leaves and the
    one that enters.
    """
    if len(s) < window:
        return []
    most = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += _NLOGN[n + 1] - _NLOGN[n]
        counts[c] = n + 1
        if i >= window:
            old = s[i - window]
            n = counts[old]
            total += _NLOGN[n - 1] - _NLOGN[n]
            counts[old] = n - 1
        if i >= window - 1 and total <= most:
            if spans and spans[-1][1] >= i - window + 1:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - window + 1, i + 1))
    return spans


def worded(s: str, part: int) -> bool:
    """True if most letters and digits stand in parts of ``part`` letters or more that look like words: enough
    vowels, and no more than four consonants in a row."""
    n = sum(map(str.isalnum, s))
    fine = (p for p in _PART.findall(s) if len(p) >= part and 4 * len(_VOWEL.findall(p)) >= len(p) and not _HARD.search(p))
    return sum(map(len, fine)) >= WORDS_SHARE * n


def allowed(s: str, part: int = 3) -> bool:
    """True if the string is on the allow-list."""
    low = s.lower()
    return any(p.fullmatch(s) for p in ALLOW) or any(low in q * 4 for q in _SEQUENCES) or worded(s, part)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _merged(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint intervals that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans (start, end, kind) of one whole text, in order; offsets are code points."""
    text = text or ""
    base = base_spans(text)
    more: list[tuple[int, int, str]] = []

    def look(candidates: list[tuple[int, int]], kind: str, part: int, rule: Callable[[int], tuple[int, float]]) -> None:
        if not candidates:
            return
        starts, ends = _merged(base + more)
        for x, y in candidates:
            if allowed(text[x:y], part):
                continue
            for a, b in entropy_spans(text[x:y], *rule(y - x)):
                a, b = a + x, b + x
                k = bisect.bisect_left(starts, b)  # intervals before k start before b; the last of them ends last
                if not allowed(text[a:b], part) and not (k and ends[k - 1] > a):
                    more.append((a, b, kind))

    kind, run, *rule = HEX_CLASS
    look([m.span() for m in run.finditer(text)], kind, 3, lambda _: tuple(rule))
    runs = [m.span() for m in RUN.finditer(text) if not any(p.fullmatch(m[0]) for p in NAMED)]
    for c in CLASSES:
        look(runs if c.run is RUN else [m.span() for a, b in runs for m in c.run.finditer(text, a, b)], c.kind, c.part, c.rule)
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: dict[str, list[int]] = {"assign": [], "access": [], "hex": []}
        digest, spans = [], []
        for t in b.column(1):
            base, every = scan(t.as_py())
            for k, v in n.items():
                v.append(sum(x[2] == k for x in base))
            digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            spans.append(_joined(every))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(v, pa.int64()) for v in n.values()), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs (doc_id, text, ...)``.

    A null or empty text has no spans (the digest is that of the empty string). Rows are judged one by one, so
    repeated rows give repeated results, and nothing is shuffled.
    """
    return docs.select("doc_id", "text").mapInArrow(_rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span replaced."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in scan(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
