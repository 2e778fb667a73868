"""Column functions on text: trimming, compression, significance, expectations, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from procflow.functions import patterns as P

CHARS_PER_TOKEN = 3.5
#: All white space of Unicode: what ``\s`` stands for in a pattern with ``(?U)``.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end (all of it, not spaces alone)."""
    return F.trim(c, F.lit(SPACE))


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends. Printable ASCII without two spaces in a row is what it
    should be already."""
    return strip(F.when(F.contains(c, F.lit("  ")) | c.rlike("[^ -~]"), _single(c)).otherwise(c))


def _single(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{SPACE}]{{2,}}|[{SPACE.replace(' ', '')}]", " ")


def compress(c: Column) -> Column:
    """Filler phrases removed or replaced, in order; white space collapsed; none before punctuation. Most lines have no
    filler, which one look for all of them tells."""
    bare = reduce(lambda x, f: F.regexp_replace(x, "(?i)" + f[0], f[1]), P.FILLERS, c)
    some = r"(?i)\b(?:" + "|".join(p.removeprefix(r"\b") for p, _ in P.FILLERS) + ")"
    return F.regexp_replace(F.when(c.rlike(some), strip(_single(bare))).otherwise(squeeze(c)), r"\s+([,.:;])", "$1")


def truncate(c: Column, most: int = 120) -> Column:
    """At most ``most`` characters, cut at the last space if that keeps over three quarters, then an ellipsis."""
    head = F.substring(c, 1, most)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (space > most * 0.75), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("…")))


def significance(c: Column) -> Column:
    """How much in a paragraph looks actionable: capped counts of eight signs."""
    return reduce(lambda a, b: a + b, [F.least(F.lit(n), F.regexp_count(c, F.lit(p))) for n, p in P.SIGNIFICANCE])


def is_significant(c: Column) -> Column:
    """Whether a paragraph has a sign at all, that is significance() of 1 at least; the first sign found will do. Signs
    that hold a digit or a colon are only looked for where there is one."""
    words = [c.rlike(p) for _, p in P.SIGNIFICANCE if p not in P.SIGNS_WITH_DIGITS]
    marked = [c.rlike(p) for p in P.SIGNS_WITH_DIGITS]
    either = lambda xs: reduce(lambda a, b: a | b, xs)
    return F.coalesce(either(words) | (c.rlike("[0-9:]") & either(marked)), F.lit(True))


def expectation(c: Column) -> Column:
    """The first expected output of five characters or more that a phrase announces; null if none. Each phrase has one
    of a few words, so a text without them is done after one look."""

    def one(pattern: str, group: int) -> Column:
        value = F.rtrim(strip(F.regexp_extract(c, pattern, group)), F.lit("."))
        return F.when(F.length(value) >= 5, F.substring(value, 1, 120))

    return F.when(c.rlike(P.EXPECTATION_WORDS), F.coalesce(*[one(p, g) for p, g in P.EXPECTATIONS]))


def tokens(c: Column) -> Column:
    """Estimated tokens of a text, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / CHARS_PER_TOKEN).cast("int"))


def file_key(c: Column) -> Column:
    """A safe file name from a title."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\-]", "_"), "^_+|_+$", "")


def stem_title(path: Column) -> Column:
    """A title from a path: the file's stem with spaces, in title case."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.initcap(F.translate(stem, "_-", "  "))


def is_boilerplate(c: Column) -> Column:
    """Empty, a page mark, a lone number, or under three characters."""
    return (F.length(c) < 3) | c.rlike(P.BOILERPLATE)
