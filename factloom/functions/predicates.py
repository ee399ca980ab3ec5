"""Column predicates and scalar helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.errors import InvalidArgument


def scope_matches(name: Column, pattern: str) -> Column:
    """Exact name, ``X.*`` (X and what is below it, by whole segments) or ``*``; a null name counts as empty."""
    name = F.coalesce(name, F.lit(""))
    if pattern == "*":
        return F.lit(True)
    if pattern.endswith(".*") and "*" not in pattern[:-2] and len(pattern) > 2:
        return (name == pattern[:-2]) | name.startswith(pattern[:-1])
    if "*" in pattern or not pattern:
        raise InvalidArgument(f"not a scope pattern: {pattern!r}", pattern=pattern)
    return name == pattern


def contains_ci(value: Column, part: str | None) -> Column:
    """Whether ``value`` holds ``part``, ignoring case; no part, no filter."""
    return F.lit(True) if part is None else F.lower(value).contains(part.lower())


def equals_ci(value: Column, other: str | None) -> Column:
    """Whether the two are equal, ignoring case; nothing to compare with, no filter."""
    return F.lit(True) if other is None else F.lower(value) == other.lower()


def match_rank(name: Column, query: str) -> Column:
    """0 for an exact match, 1 for a prefix, 2 for a substring, null otherwise; case is ignored."""
    low, q = F.lower(name), query.lower()
    return F.when(low == q, 0).when(low.startswith(q), 1).when(low.contains(q), 2)


def shortened(text: Column, length: int) -> Column:
    """At most ``length`` characters, then an ellipsis if something is left out."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; 100 of nothing."""
    return F.when(whole == 0, 100).otherwise(F.floor(part / whole * 100)).cast("long")


def clamped(value: Column, low: int, high: int) -> Column:
    """The value held between two bounds."""
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def glob_regex(glob: str) -> str:
    """A pattern for ``rlike`` from ``*`` and ``?``; case is ignored, and ``[`` is not allowed."""
    if "[" in glob:
        raise InvalidArgument("'[' is not allowed in a glob", glob=glob)
    special = set("\\.^$|()+{}]")
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in glob) + "$"
