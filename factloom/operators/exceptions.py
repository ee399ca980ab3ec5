"""Which exceptions leave a method, and where the others are caught: call chains with call sites, try spans, clauses in order.

A throw goes outward through the tries around it in its own method, then through those around the call in each method of
the chain that led there. The first clause without a filter whose type is the exception's, a base of it, or none at all catches
it; a clause with a filter may or may not, which is told.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binding import ancestors
from .shared import cut, cut_and_count


def call_chains(calls: DataFrame, root: DataFrame, max_depth: int = 3) -> DataFrame:
    """``(node, depth, chain)`` of the methods within ``max_depth`` calls of ``root(node)``: ``calls(src, dst, at)`` from an offset ``at`` of the caller.

    ``chain`` holds ``(node, at)`` of each call from the root on. A method is met once, on its shallowest arrival, and of several
    chains of that length on the smallest; one chain is kept for each method and step, so dense graphs do not multiply them.
    """
    sites = cut(calls.select("src", "dst", "at").where("src is not null and dst is not null").distinct())
    kind = sites.select(F.array(F.struct(F.col("src").alias("node"), "at")).alias("chain")).schema["chain"].dataType
    seen = [cut(root.select("node").distinct().select("node", F.lit(0).alias("depth"), F.array().cast(kind).alias("chain")))]
    for depth in range(1, max_depth + 1):
        step = seen[-1].select(F.col("node").alias("src"), "chain").join(sites, "src").select(F.col("dst").alias("node"), F.concat("chain", F.array(F.struct(F.col("src").alias("node"), "at"))).alias("chain"))
        known = reduce(DataFrame.unionByName, seen).select("node")
        fresh, n = cut_and_count(step.groupBy("node").agg(F.min("chain").alias("chain")).join(known, "node", "left_anti").select("node", F.lit(depth).alias("depth"), "chain"))
        if not n:
            break
        seen.append(fresh)
    return reduce(DataFrame.unionByName, seen)


def enclosing_clauses(places: DataFrame, tries: DataFrame, clauses: DataFrame) -> DataFrame:
    """``(node, at, span, start, stop, clause, type, filtered)``: for each distinct place ``(node, at)`` the clauses of the tries whose protected blocks hold it.

    ``tries(node, span, start, stop)`` protect from ``start`` to before ``stop``; ``clauses(node, span, clause, type, filtered)`` in order, a
    null type is a bare one. Spans may nest; what is thrown in a clause is not in its own try's span.
    """
    held = places.select("node", "at").distinct().join(tries, "node").where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop")))
    return held.join(clauses, ["node", "span"]).select("node", "at", "span", "start", "stop", "clause", "type", F.coalesce("filtered", F.lit(False)).alias("filtered"))


def exception_flow(calls: DataFrame, root: DataFrame, throws: DataFrame, tries: DataFrame, clauses: DataFrame, bases: DataFrame, max_depth: int = 3) -> DataFrame:
    """What the methods within ``max_depth`` calls of ``root(node)`` throw, and what becomes of it.

    ``throws(node, at, exception)``, ``bases(src, dst)`` of exception types; the rest as in ``call_chains`` and ``enclosing_clauses``.
    Returns ``(node, at, exception, depth, chain, escapes, caught_in, caught_span, caught_clause, has_filter)``, one row for each throw;
    ``chain`` is a text, the methods from the root to the throwing one. ``has_filter`` says that a filtered clause of a fitting type lies before the one that catches.
    """
    chains = cut(call_chains(calls, root, max_depth))
    raised = cut(throws.select("node", "at", "exception").distinct().join(chains, "node").withColumn("throw", F.monotonically_increasing_id()))
    own = F.array(F.struct("node", "at"))
    # from the outermost call to the throw itself: the larger the place, the further inside
    frames = raised.select("throw", "exception", F.posexplode(F.concat("chain", own)).alias("place", "f")).select("throw", "exception", "place", "f.node", "f.at")
    fits = ancestors(bases, raised.select(F.col("exception").alias("type")).distinct()).select(F.col("type").alias("exception"), F.col("scope").alias("type"))
    near = frames.join(enclosing_clauses(frames, tries, clauses), ["node", "at"])
    typed = near.where("type is not null").join(fits, ["exception", "type"], "left_semi")
    met = typed.unionByName(near.where("type is null"))
    # outward: the innermost frame first, in it the innermost try, in that the first clause
    order = F.struct((-F.col("place")).alias("out"), (-F.col("start")).alias("inner"), "stop", "span", "clause", "node")
    first = met.groupBy("throw").agg(F.min(F.when(~F.col("filtered"), order)).alias("catch"), F.min(F.when(F.col("filtered"), order)).alias("filter"))
    passed = F.col("filter").isNotNull() & (F.col("catch").isNull() | (F.col("filter") < F.col("catch")))
    names = F.array_join(F.concat(F.transform("chain", lambda c: c["node"].cast("string")), F.array(F.col("node").cast("string"))), ">")
    return raised.join(first, "throw", "left").select(
        "node",
        "at",
        "exception",
        "depth",
        names.alias("chain"),
        F.col("catch").isNull().alias("escapes"),
        F.col("catch.node").alias("caught_in"),
        F.col("catch.span").alias("caught_span"),
        F.col("catch.clause").alias("caught_clause"),
        passed.alias("has_filter"),
    )


def exception_summary(flow: DataFrame) -> DataFrame:
    """``(exception, escaping, caught, filtered)``: how many throws of each type."""
    return flow.groupBy("exception").agg(F.count_if("escapes").alias("escaping"), F.count_if(~F.col("escapes")).alias("caught"), F.count_if("has_filter").alias("filtered"))
