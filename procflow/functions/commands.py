"""Column functions that classify a line as a device command."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from procflow.functions import patterns as P
from procflow.functions.text import squeeze, strip


def strip_prompt(line: Column, prompts: tuple[str, ...] = P.PROMPTS) -> Column:
    """The line without device prompts; each pattern is taken once, in order. All of them need one of the characters
    that a prompt ends with, so most lines are done after one plain look."""
    bare = reduce(lambda c, p: F.regexp_replace(c, "(?U)" + p, ""), prompts, line)
    return strip(F.when(line.rlike(r"[>#\]]"), bare).otherwise(line))


def normalize(text: Column) -> Column:
    return squeeze(F.lower(text))


def vendor_mode(text: Column, vendors: dict = P.VENDORS) -> Column:
    """``vendor/mode`` of the first vendor that matches, exec before config; null if none does."""
    found = F.when(F.lit(False), F.lit(""))
    for vendor, modes in vendors.items():
        for mode in ("exec", "config"):
            if modes[mode]:
                found = found.when(text.rlike(P.anchored(modes[mode])), F.lit(f"{vendor}/{mode}"))
    return found


def is_generic(text: Column, indicators: tuple[str, ...] = P.GENERIC) -> Column:
    return text.rlike(P.anchored(indicators))


def protocol(text: Column, protocols: dict = P.PROTOCOLS) -> Column:
    """The protocol of the first command prefix that matches, else of the first keyword; null if none."""
    low = F.lower(text)
    found = F.when(F.lit(False), F.lit(""))
    for name, p in protocols.items():
        found = found.when(low.rlike("^(?:" + "|".join(p["commands"]) + ")"), F.lit(name))
    for name, p in protocols.items():
        found = found.when(low.rlike(P.keyword(p["keywords"])), F.lit(name))
    return found


def confidence(vendor_: Column, protocol_: Column) -> Column:
    """0.5 for an indicator alone, 0.7 plus the vendor's boost else, 0.1 more with a protocol, 1 at most."""
    base = F.when(vendor_.isNull(), 0.5).when(vendor_ == "generic", 0.7 + P.GENERIC_BOOST).otherwise(0.7 + P.VENDOR_BOOST)
    return F.round(F.least(F.lit(1.0), base + F.when(protocol_.isNotNull(), 0.1).otherwise(0.0)), 2)


def is_command(line: Column) -> Column:
    """True if the line looks like a command of any kind."""
    text = strip_prompt(strip(line))
    some = P.anchored(tuple(p for m in P.VENDORS.values() for k in ("exec", "config") for p in m[k]) + P.GENERIC)
    return F.coalesce((F.length(strip(line)) >= 3) & text.rlike(some), F.lit(False))


def is_non_idempotent(command: Column) -> Column:
    """True if running the command twice is not the same as running it once."""
    return F.lower(strip(command)).rlike("^(?:" + "|".join(P.NON_IDEMPOTENT) + ")")
