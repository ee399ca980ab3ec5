"""A closure that is kept: what added and removed edges change in it, without working it out again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import reach_from_each
from .shared import cut, cut_and_count

_PAIR = ["root", "node"]


def closure(edges: DataFrame) -> DataFrame:
    """``(root, node)``: every pair that one or more of ``edges(src, dst)`` connect."""
    return reach_from_each(edges).select(*_PAIR)


def _around(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of ``pairs``, their ends included, that have one of ``edges(src, dst)`` on the way: from what reaches its source to what its target reaches."""
    before = edges.join(pairs.select(F.col("root").alias("above"), F.col("node").alias("src")), "src").select("above", "dst").unionByName(edges.select(F.col("src").alias("above"), "dst")).distinct()
    after = before.join(pairs.select(F.col("root").alias("dst"), F.col("node").alias("under")), "dst").select("above", F.col("under").alias("node"))
    return after.unionByName(before.select("above", F.col("dst").alias("node"))).select(F.col("above").alias("root"), "node").distinct()


def maintain(pairs: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The closure of ``edges`` without ``removed`` and with ``added``, from ``pairs``, the closure of ``edges``; all ``(src, dst)``, pairs ``(root, node)``.

    Removed first: every pair that may have used a removed edge is taken out, and those that another way still connects are put back,
    by rounds from their first edge. Then added ones: a round for each added edge on a way, in which only pairs that are new go on. Work grows with the pairs that
    the edges touch. An edge that is both stays; one that is removed but not there, or added but there, changes nothing.
    """
    old = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    plus = cut(added.select("src", "dst").where("src is not null and dst is not null").distinct().join(old, ["src", "dst"], "left_anti"))
    minus = cut(removed.select("src", "dst").join(added.select("src", "dst"), ["src", "dst"], "left_anti").distinct().join(old, ["src", "dst"], "left_semi"))
    rest = cut(old.join(minus, ["src", "dst"], "left_anti"))
    kept, doubt = cut(pairs.select(*_PAIR)), None
    if not minus.isEmpty():
        doubt, n = cut_and_count(_around(kept, minus))
        sure = cut(kept.join(doubt, _PAIR, "left_anti"))
        back = [sure]
        # a pair in doubt is there if its first edge leads to its end, or to what is known to reach it
        fresh, n = cut_and_count(_first_step(rest, sure, doubt).join(sure, _PAIR, "left_anti"))
        while n:
            back.append(fresh)
            more = rest.select(F.col("src").alias("root"), "dst").join(fresh.select(F.col("root").alias("dst"), "node"), "dst").select(*_PAIR).distinct()
            fresh, n = cut_and_count(more.join(doubt, _PAIR, "left_semi").join(reduce(DataFrame.unionByName, back), _PAIR, "left_anti"))
        kept = reduce(DataFrame.unionByName, back)
    if plus.isEmpty():
        return kept
    known = cut(kept)
    seen = [known]
    fresh, n = cut_and_count(_around(known, plus).join(known, _PAIR, "left_anti"))
    while n:
        seen.append(fresh)
        # from the end of a new pair over one more added edge, and on from there; what ends in a known pair was met in the first round
        on = fresh.join(plus.select(F.col("src").alias("node"), "dst"), "node").select("root", F.col("dst").alias("node")).distinct()
        more = on.unionByName(on.select("root", F.col("node").alias("through")).join(known.select(F.col("root").alias("through"), "node"), "through").select(*_PAIR))
        fresh, n = cut_and_count(more.distinct().join(reduce(DataFrame.unionByName, seen), _PAIR, "left_anti"))
    return reduce(DataFrame.unionByName, seen)


def _first_step(rest: DataFrame, sure: DataFrame, doubt: DataFrame) -> DataFrame:
    """Pairs in doubt that an edge connects, or an edge to what surely reaches the end."""
    direct = rest.select(F.col("src").alias("root"), F.col("dst").alias("node"))
    by = rest.select(F.col("src").alias("root"), "dst").join(sure.select(F.col("root").alias("dst"), "node"), "dst").select(*_PAIR)
    return direct.unionByName(by).distinct().join(doubt, _PAIR, "left_semi")
