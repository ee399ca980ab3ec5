"""Data flow over control-flow graphs with branches and loops, all scopes at once.

A fact is a pair of a node and a variable. It moves along edges until a node kills it; what it reaches is worked out
to a fixed point, so loops end and each pair is met once. Liveness moves uses
backwards and is killed by writes; a path without an assignment moves forwards and is killed by writes too.

Scopes do not touch each other, so a task takes whole ones and works on sets of variables as bits. Only scopes too large for
that are walked by frontiers of new pairs, over all tasks.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import cut, cut_and_count

_PAIR = ["scope", "node", "var"]
#: Rows (edges, accesses, nodes of the region) of the largest scope that a task takes whole.
WHOLE = 200_000
#: Variables of a scope that are worked on at once, which bounds the bits of a node.
WIDE = 4096
#: Rows that leave a task at a time.
OUT = 5000
_EDGE, _ACCESS, _REGION, _ENTRY = range(4)
#: Values of these types are the same in Python where they are in Spark.
_PLAIN = {"tinyint", "smallint", "int", "bigint", "string", "binary", "boolean", "date"}
_FLAGS = ["read_inside", "written_inside", "always_assigned", "flows_in", "flows_out", "read_outside", "written_outside"]
#: Steps that a job takes; between them pairs are told apart, but not from all that are known.
STRIDE = 4
#: Up to so many pairs are sent to the nodes, which are then read but not shuffled.
SMALL = 20_000
#: The flows of a region that are walked together: reads backwards, writes inside forwards, the entry's variables without a write.
LIVE, GO, BARE = range(3)


def spread(edges: DataFrame, start: DataFrame, kill: DataFrame) -> DataFrame:
    """``(scope, node, var)`` of all pairs that ``start(scope, node, var)`` reaches over ``edges(scope, src, dst)``, itself included.

    A pair arrives at a node that kills it, as in ``kill(scope, node, var)``, but does not go on from there; one that starts there does.
    """
    ways = edges.select("scope", F.col("src").alias("node"), "dst").groupBy("scope", "node").agg(F.collect_set("dst").alias("to"))
    stops = kill.groupBy("scope", "node").agg(F.collect_set("var").alias("stops"))
    # a node's edges and kills are one row, so a step is one join
    widest = Observation()
    nodes = cut(ways.join(stops, ["scope", "node"], "left").observe(widest, F.max(F.size("to")).alias("n")))
    fan = widest.get["n"] or 1
    first, n = cut_and_count(start.select(*_PAIR).distinct())
    seen, front, starts = [first], first, True
    while n:
        found, at = [], front
        for k in range(STRIDE):
            few = F.broadcast if n * fan**k <= SMALL else (lambda df: df)  # a step makes so many pairs of one at most
            on = F.lit(starts and k == 0) | ~F.coalesce(F.array_contains("stops", F.col("var")), F.lit(False))
            at = nodes.join(few(at), ["scope", "node"]).where(on).select("scope", F.explode("to").alias("node"), "var").distinct()
            found.append(at)
        met, n = cut_and_count(reduce(DataFrame.unionByName, found).distinct())
        # a small front goes to what is known, instead of all that being shuffled
        few = F.broadcast if n <= SMALL else (lambda df: df)
        known = reduce(DataFrame.unionByName, seen).join(few(met), _PAIR, "left_semi")
        front, n = cut_and_count(met.join(few(known), _PAIR, "left_anti"))
        seen.append(front)
        starts = False
    return reduce(DataFrame.unionByName, seen)


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select("scope", F.col("dst").alias("src"), F.col("src").alias("dst"))


def live_variables(edges: DataFrame, accesses: DataFrame) -> DataFrame:
    """``(scope, node, var)``: variables whose value at the node's beginning may be read later.

    ``accesses(scope, node, var, reads, writes)``: ``reads`` before any write in the node, ``writes`` at all.
    """
    reads, writes = accesses.where("reads").select(*_PAIR), accesses.where("writes").select(*_PAIR)
    # a use arrives at a predecessor's beginning unless that writes; it goes on from the use itself even if that writes too
    arrived = spread(_turned(edges), reads, writes)
    return cut(arrived.join(writes.join(reads, _PAIR, "left_anti"), _PAIR, "left_anti").distinct())


def region_flow(edges: DataFrame, accesses: DataFrame, region: DataFrame, entry: DataFrame) -> DataFrame:
    """What the nodes ``region(scope, node)``, entered at ``entry(scope, node)``, do with each variable that they touch.

    ``(scope, var, read_inside, written_inside, always_assigned, flows_in, flows_out, read_outside, written_outside)``. A
    variable flows in if a write outside may reach the region's entry and from there a read inside without a write between; it flows out
    if a write inside may reach a read outside; it is always assigned if every way from the entry out of the region, by an edge
    or by an end of the graph within, has a write. If the region is never left, what it writes counts as assigned.
    """
    byte = lambda x: F.lit(x).cast("byte")
    how = F.when(F.coalesce("reads", F.lit(False)), 1).otherwise(0) + F.when(F.coalesce("writes", F.lit(False)), 2).otherwise(0)
    rows = [
        accesses.select("scope", byte(_ACCESS).alias("kind"), "node", F.lit(None).alias("dst"), "var", how.cast("byte").alias("how")),
        edges.select("scope", byte(_EDGE).alias("kind"), F.col("src").alias("node"), "dst", F.lit(None).alias("var"), byte(0).alias("how")).where("node is not null and dst is not null"),
        *(df.select("scope", byte(kind).alias("kind"), "node", F.lit(None).alias("dst"), F.lit(None).alias("var"), byte(0).alias("how")) for kind, df in ((_REGION, region), (_ENTRY, entry))),
    ]
    facts = reduce(DataFrame.unionByName, rows).where("scope is not null")
    if not {kind for _, kind in facts.select("scope", "node", "dst", "var").dtypes} <= _PLAIN:
        return _walked(edges, accesses, region, entry)
    facts = cut(facts)
    large, n = cut_and_count(facts.groupBy("scope").agg(F.count("*").alias("rows")).where(F.col("rows") > WHOLE).select("scope"))
    small = facts.join(large, "scope", "left_anti") if n else facts
    kinds = facts.select("scope", "var").schema
    for name in _FLAGS:
        kinds = kinds.add(name, "boolean")
    found = small.repartition("scope").sortWithinPartitions("scope").mapInArrow(_solved, kinds)
    if n:
        found = found.unionByName(_walked(*(df.join(large, "scope", "left_semi") for df in (edges, accesses, region, entry))))
    return found.withColumn("scope", F.col("scope").cast(accesses.schema["scope"].dataType))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The flows of scopes whose rows follow each other."""
    scope, rows, found, kinds = None, [], [], []

    def told() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["scope", "var", *_FLAGS])

    for batch in batches:
        kinds = [batch.schema.field("scope").type, batch.schema.field("var").type, *[pa.bool_()] * len(_FLAGS)]
        for s, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != scope:
                found += [(scope, *x) for x in _flows(rows)]
                scope, rows = s, []
                if len(found) >= OUT:
                    yield told()
            rows.append(row)
    found += [(scope, *x) for x in _flows(rows)]
    if found:
        yield told()


def _flows(rows: list) -> Iterator[tuple]:
    """``(var, read_inside, ...)`` of one scope's rows ``(kind, node, dst, var, how)``."""
    ahead, back, accesses, inside, doors = defaultdict(set), defaultdict(set), [], set(), set()
    for kind, node, dst, var, how in rows:
        if kind == _EDGE:
            ahead[node].add(dst)
            back[dst].add(node)
        elif kind == _ACCESS:
            if var is not None:
                accesses.append((node, var, how))
        elif node is not None:
            (inside if kind == _REGION else doors).add(node)
    doors &= inside
    exits = [n for n in inside if not ahead.get(n) or not ahead[n] <= inside]
    touched = list(dict.fromkeys(var for node, var, _ in accesses if node in inside))
    for k in range(0, len(touched), WIDE):
        bits = {var: 1 << i for i, var in enumerate(touched[k : k + WIDE])}
        reads, writes = defaultdict(int), defaultdict(int)
        for node, var, how in accesses:
            if bit := bits.get(var):
                if how & 1:
                    reads[node] |= bit
                if how & 2:
                    writes[node] |= bit
        union = lambda masks: reduce(int.__or__, masks, 0)
        live = _arrived({n: m for n, m in reads.items() if n in inside}, back, writes, True, inside)
        # live at the entry by reads inside, without leaving the region; then backwards to the writes before
        asked = {n: live[n] & (reads.get(n, 0) | ~writes.get(n, 0)) for n in doors if n in live}
        flows_in = union(m & writes.get(n, 0) for n, m in _arrived(asked, back, writes, True).items() if n not in inside)
        begun = defaultdict(int)
        for n, m in writes.items():
            if n in inside:
                for dst in ahead.get(n, ()):
                    begun[dst] |= m
        flows_out = union(m & reads.get(n, 0) for n, m in _arrived(begun, ahead, writes, False).items() if n not in inside)
        bare = _arrived(dict.fromkeys(doors, (1 << len(bits)) - 1), ahead, writes, False, inside)
        missed = union(bare.get(n, 0) & ~writes.get(n, 0) for n in exits)
        read_in, read_out = (union(m for n, m in reads.items() if (n in inside) is here) for here in (True, False))
        write_in, write_out = (union(m for n, m in writes.items() if (n in inside) is here) for here in (True, False))
        for var, bit in bits.items():
            yield (var, *(bool(m & bit) for m in (read_in, write_in, write_in & ~missed, flows_in, flows_out, read_out, write_out)))


def _arrived(start: dict, ways: dict, stops: dict, on: bool, within: set | None = None) -> dict:
    """The variables, as bits, that arrive at each node from ``start``; where ``stops`` has them they stay, unless they start there and go ``on``."""
    at, todo = dict(start), deque(start)
    while todo:
        n = todo.popleft()
        go = at[n] & ~stops.get(n, 0) | (start.get(n, 0) if on else 0)
        if not go:
            continue
        for m in ways.get(n, ()):
            if (within is None or m in within) and (new := go & ~at.get(m, 0)):
                at[m] = at.get(m, 0) | new
                todo.append(m)
    return at


def _walked(edges: DataFrame, accesses: DataFrame, region: DataFrame, entry: DataFrame) -> DataFrame:
    """``region_flow`` by frontiers, for scopes of any size."""
    accesses = accesses.where("var is not null")  # no join would know such a pair again, so it would go round a loop for ever
    inside = cut(region.select("scope", "node").distinct())
    steps = cut(edges.select("scope", "src", "dst").where("src is not null and dst is not null").distinct())
    mark = inside.withColumn("inside", F.lit(True))
    rows = cut(accesses.groupBy(*_PAIR).agg(F.max(F.coalesce("reads", F.lit(False))).alias("reads"), F.max(F.coalesce("writes", F.lit(False))).alias("writes")).join(mark, ["scope", "node"], "left").withColumn("inside", F.coalesce("inside", F.lit(False))))
    writes = rows.where("writes").select(*_PAIR)
    doors = entry.select("scope", "node").distinct().join(inside, ["scope", "node"], "left_semi")
    touched = cut(rows.where("inside").select("scope", "var").distinct())

    within = cut(steps.join(inside.select("scope", F.col("node").alias("src")), ["scope", "src"], "left_semi").join(inside.select("scope", F.col("node").alias("dst")), ["scope", "dst"], "left_semi"))
    # a write goes on from the node after it until the next write
    after = lambda some: rows.where(some).select("scope", F.col("node").alias("src"), "var").join(steps, ["scope", "src"]).select("scope", F.col("dst").alias("node"), "var").distinct()
    begin = {LIVE: rows.where("reads and inside").select(*_PAIR), GO: after("writes and inside"), BARE: doors.join(touched, "scope").select(*_PAIR)}
    ways = {LIVE: _turned(within), GO: steps, BARE: within}
    inner = rows.where("writes and inside").select(*_PAIR)
    # the flows are scopes of their own in one walk, which takes as many rounds as the longest of them
    start, edges, kill = (cut(reduce(DataFrame.unionByName, (_of(df, k) for k, df in x.items()))) for x in (begin, ways, {LIVE: inner, GO: writes, BARE: writes}))
    stuck = start.where(F.col("scope.flow") != LIVE).join(kill, _PAIR, "left_semi")
    arrived = cut(spread(edges, start.join(stuck, _PAIR, "left_anti"), kill).unionByName(stuck).select("scope.flow", "scope.scope", "node", "var").distinct())
    met = lambda flow: arrived.where(F.col("flow") == flow).select(*_PAIR)
    # live at the entry by reads inside, without leaving the region, and written before
    asked = cut(met(LIVE).join(inner.join(begin[LIVE], _PAIR, "left_anti"), _PAIR, "left_anti").join(doors, ["scope", "node"], "left_semi").select(*_PAIR))
    # backwards from the few that are asked for: the writes outside are many, and most lead elsewhere
    came = spread(_turned(steps), asked, writes)
    flows_in = came.join(rows.where("writes and not inside").select(*_PAIR), _PAIR, "left_semi").select("scope", "var").distinct().withColumn("flows_in", F.lit(True))
    out = met(GO).join(rows.where("reads and not inside").select(*_PAIR), _PAIR, "left_semi").select("scope", "var").distinct().withColumn("flows_out", F.lit(True))
    # ways through the region without a write
    after = met(BARE).join(writes, _PAIR, "left_anti")
    leave = steps.join(within, ["scope", "src", "dst"], "left_anti").select("scope", F.col("src").alias("node"))
    ends = inside.join(steps.select("scope", F.col("src").alias("node")), ["scope", "node"], "left_anti")
    exits = leave.unionByName(ends).distinct().join(inside, ["scope", "node"], "left_semi")
    missed = after.join(exits, ["scope", "node"], "left_semi").select("scope", "var").distinct().withColumn("missed", F.lit(True))
    seen = rows.groupBy("scope", "var").agg(*(F.coalesce(F.max(F.expr(test)), F.lit(False)).alias(name) for name, test in (("read_inside", "inside and reads"), ("written_inside", "inside and writes"), ("read_outside", "not inside and reads"), ("written_outside", "not inside and writes"))))
    every = seen.join(touched, ["scope", "var"], "left_semi")
    for found in (flows_in, out, missed):
        every = every.join(found, ["scope", "var"], "left")
    flag = lambda name: F.coalesce(name, F.lit(False))
    return every.select("scope", "var", "read_inside", "written_inside", (F.col("written_inside") & ~flag("missed")).alias("always_assigned"), flag("flows_in").alias("flows_in"), flag("flows_out").alias("flows_out"), "read_outside", "written_outside")


def _of(rows: DataFrame, flow: int) -> DataFrame:
    """Rows in a scope of the flow's own."""
    return rows.withColumn("scope", F.struct(F.lit(flow).alias("flow"), F.col("scope").alias("scope")))
