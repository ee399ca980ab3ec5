"""Walks over an edge table ``(src, dst)``: breadth first by frontier, closures, cycles, levels.

Edges are written once, so a step does not work them out again; a step is one join of the frontier with them, and a
frontier that Spark knows to be small goes to the edges instead of the other way round. Visited nodes are taken out by an
anti join, so dense graphs do not multiply paths; each frontier is written once and never again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.errors import InvalidArgument

from .shared import cut, cut_and_count


def _edges(edges: DataFrame) -> DataFrame:
    return cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Steps that a job takes from a frontier of at most ``SMALL`` nodes; from a larger one it takes one.
STRIDE, SMALL = 6, 100_000
#: Steps over edges in a round of colouring, before colours jump.
RELAXED = 2
#: Up to so many steps a walk is one plan.
UNROLLED = 4


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, depth)`` of all nodes within ``max_depth`` steps of ``seeds(node)``, seeds at 0, each at its least depth.

    From a small frontier a job takes several steps: what it finds at a step without having taken out visited nodes in between
    is visited or has been found a step before, so least depths stay right.
    """
    if max_depth is not None and max_depth <= UNROLLED:
        return _unrolled(edges, seeds, max_depth)
    return _reach(_edges(edges), seeds, max_depth)


def _unrolled(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``reach`` as one plan without a written table: a join for each step, and the least depth at the end. The edges' exchange is the same in each step, so Spark works it out once."""
    steps = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    at = seeds.select("node").distinct()
    found = [at.withColumn("depth", F.lit(0))]
    for depth in range(1, max_depth + 1):
        at = steps.join(at.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        found.append(at.withColumn("depth", F.lit(depth)))
    return _union(found).groupBy("node").agg(F.min("depth").alias("depth"))


def _reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    first, n = cut_and_count(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, frontier, depth = [first], first, 0
    while n and (max_depth is None or depth < max_depth):
        stride = 1 if n > SMALL else STRIDE if max_depth is None else min(STRIDE, max_depth - depth)
        steps, at = [], frontier.select("node")
        for k in range(1, stride + 1):
            at = edges.join(at.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
            steps.append(at.withColumn("depth", F.lit(depth + k)))
        found = _union(steps).groupBy("node").agg(F.min("depth").alias("depth")) if stride > 1 else steps[0]
        fresh = found.join(_union(seen).select("node"), "node", "left_anti")
        depth += stride
        fresh, n = cut_and_count(fresh, F.col("depth") == depth)
        frontier = fresh.where(F.col("depth") == depth)
        seen.append(fresh)
    return _union(seen)


def reach_from_each(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(root, node, depth)``: every pair within ``max_depth`` steps, a root among its own on a cycle only."""
    edges = _edges(edges)
    seen = [edges.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("depth"))]
    depth, n = 1, 1
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        step = seen[-1].select("root", F.col("node").alias("src")).join(edges, "src").select("root", F.col("dst").alias("node")).distinct()
        fresh, n = cut_and_count(step.join(_union(seen).select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if n:
            seen.append(fresh)
    return _union(seen)


def call_graph(edges: DataFrame, root: DataFrame, direction: str = "callees", max_depth: int = 3, max_nodes: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node, depth, expanded)`` around ``root(node)`` and edges ``(src, dst)`` of those that are expanded.

    ``direction`` is ``callees``, ``callers`` or ``both``. At most ``max_nodes`` nodes are kept, the nearest first and then the
    smallest; ``expanded`` is false for those at the last depth, whose own edges are not followed and not told. An edge to a node that was
    dropped is told all the same.
    """
    if direction not in ("callees", "callers", "both"):
        raise InvalidArgument("direction must be callees, callers or both", direction=direction)
    known = _edges(edges)
    back = known.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    walked = known if direction == "callees" else back if direction == "callers" else known.unionByName(back)
    nodes = cut(reach(walked, root, max_depth).orderBy("depth", "node").limit(max_nodes).withColumn("expanded", F.col("depth") < max_depth))
    expanded = nodes.where("expanded")
    ends = {"callees": ["src"], "callers": ["dst"], "both": ["src", "dst"]}[direction]
    return nodes, _union([known.join(expanded.select(F.col("node").alias(end)), end, "left_semi").select("src", "dst") for end in ends]).distinct()


def paths(edges: DataFrame, seeds: DataFrame, max_depth: int, stop: DataFrame | None = None) -> DataFrame:
    """``(node, depth, path)`` of all simple paths of 1 to ``max_depth`` edges; a path ends at a node of ``stop(node)``."""
    lazily = max_depth <= UNROLLED
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct() if lazily else _edges(edges)
    front = seeds.select("node", F.array("node").alias("path"))
    found = []
    for depth in range(1, max_depth + 1):
        front = front.select(F.col("node").alias("src"), "path").join(edges, "src").where(~F.array_contains("path", F.col("dst")))
        front, n = front.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")), 1
        if not lazily:
            front, n = cut_and_count(front)
        found.append(front.select("node", F.lit(depth).alias("depth"), "path"))
        if not n:
            break
        if stop is not None:
            front = front.join(stop, "node", "left_anti")
    return _union(found)


def shortest_chains(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``(node, depth, path)``: of the shortest paths from ``seeds(node)`` to each node within ``max_depth`` edges the smallest; seeds have depth 0.

    One path is kept for each node and step, so dense graphs do not multiply them.
    """
    edges = _edges(edges)
    seen = [cut(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.array("node").alias("path")))]
    for depth in range(1, max_depth + 1):
        step = seen[-1].select(F.col("node").alias("src"), "path").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        step = step.join(_union(seen).select("node"), "node", "left_anti")
        fresh, n = cut_and_count(step.select("node", F.lit(depth).alias("depth"), F.concat("path", F.array("node")).alias("path")))
        if not n:
            break
        seen.append(fresh)
    return _union(seen)


def _trimmed(steps: DataFrame) -> tuple[DataFrame, int]:
    """Edges that some edge leads to and some edge leads on from, written, and their number."""
    after = steps.select(F.col("dst").alias("src")).distinct()
    before = steps.select(F.col("src").alias("dst")).distinct()
    return cut_and_count(steps.join(after, "src", "left_semi").join(before, "dst", "left_semi").select("src", "dst"))


def simple_cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """``(length, cycle)``: every simple cycle of at most ``max_length`` edges once, closed, from its smallest node on.

    Edges that no cycle can hold, since nothing leads to them or on from them, are taken out first; a path goes on only to
    nodes larger than its first, so each cycle is walked once.
    """
    steps, n, before = _edges(edges), -1, None
    for _ in range(max_length):
        if n == before or not n:
            break
        before = n
        steps, n = _trimmed(steps)
    front = steps.where("src < dst").select(F.array("src", "dst").alias("cycle"), "dst")
    out = steps.where("src = dst").select(F.lit(1).alias("length"), F.array("src", "dst").alias("cycle"))
    for length in range(2, max_length + 1):
        step = cut(front.select("cycle", F.col("dst").alias("src")).join(steps, "src"))
        out = out.unionByName(step.where(F.col("dst") == F.col("cycle")[0]).select(F.lit(length).alias("length"), F.concat("cycle", F.array("dst")).alias("cycle")))
        front = step.where((F.col("dst") > F.col("cycle")[0]) & ~F.array_contains("cycle", F.col("dst"))).select(F.concat("cycle", F.array("dst")).alias("cycle"), "dst")
    return out


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: every node on a cycle of any length; ``component`` is the smallest node of its strongly connected component.

    Nodes that no cycle can hold are trimmed. First what the node of most edges reaches and is reached by is one component, most often the
    largest. Then rounds of colouring: each node takes the smallest node that reaches it as colour, by edges and by
    jumps to the colour of its colour, so that long ways take few rounds; what reaches a colour's own node within the colour is one component.
    """
    steps = _edges(edges)
    loops = cut(steps.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")))
    rest, n = _trimmed(steps.where("src <> dst"))
    found = loops.limit(0)
    if n:
        # a node with many edges both to and from it is most likely in the largest component
        ends = rest.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(rest.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        degree = ends.groupBy("node").agg(F.least(F.sum("out"), F.sum("in")).alias("n"))
        pivot = cut(degree.orderBy(F.desc("n"), "node").limit(1).select("node"))
        back = rest.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        group = cut(_reach(rest, pivot, None).select("node").join(_reach(back, pivot, None).select("node"), "node"))
        least = group.agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1").select("component")
        found = cut(group.join(F.broadcast(least)).select("node", "component"))
        rest = _outside(rest, group)
    while True:
        before = None
        rest, n = _trimmed(rest)
        while n and n != before:
            before = n
            rest, n = _trimmed(rest)
        if not n:
            return found.unionByName(loops.join(found, "node", "left_anti"))
        colours = cut(rest.select(F.col("src").alias("node")).unionByName(rest.select(F.col("dst").alias("node"))).distinct().withColumn("component", F.col("node")))
        moved = 1
        while moved:
            new = colours.withColumn("first", F.col("component"))
            for _ in range(RELAXED):
                came = rest.join(new.select(F.col("node").alias("src"), "component"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("least"))
                new = new.join(came, "node", "left").select("node", "first", F.least("component", "least").alias("component"))
            # what reaches a node's colour reaches the node
            jump = new.select(F.col("node").alias("component"), F.col("component").alias("least"))
            new = new.join(jump, "component").select("node", F.least("component", "least").alias("component"), (F.least("component", "least") < F.col("first")).alias("moved"))
            new, moved = cut_and_count(new, F.col("moved"))
            colours = new.drop("moved")
        heads = colours.select(F.col("node").alias("src"), F.col("component").alias("head"))
        tails = colours.select(F.col("node").alias("dst"), F.col("component").alias("tail"))
        inner = cut(rest.join(heads, "src").join(tails, "dst").where("head = tail").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        group = cut(colours.join(_reach(inner, colours.where("node = component"), None), "node", "left_semi"))
        several = group.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
        found = cut(found.unionByName(group.join(several, "component", "left_semi").select("node", "component")))
        rest = _outside(rest, group)


def _outside(rest: DataFrame, group: DataFrame) -> DataFrame:
    """Edges that do not touch a node of ``group``."""
    return cut(rest.join(group.select(F.col("node").alias("src")), "src", "left_anti").join(group.select(F.col("node").alias("dst")), "dst", "left_anti"))


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, level)``: the longest path down to a leaf; nodes on or above a cycle get 0."""
    edges, nodes = _edges(edges), cut(nodes.select("node").distinct())
    settled = [cut(nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti").withColumn("level", F.lit(0)))]
    open_ = edges
    level = 0
    while True:
        level += 1
        open_ = cut(open_.join(settled[-1].select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        done = _union(settled).select("node")
        ready, n = cut_and_count(nodes.join(open_.select(F.col("src").alias("node")), "node", "left_anti").join(done, "node", "left_anti").withColumn("level", F.lit(level)))
        if not n:
            rest = nodes.join(done, "node", "left_anti").withColumn("level", F.lit(0))
            return _union([*settled, rest])
        settled.append(ready)


def closure_sizes(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, n)``: how many nodes each one reaches, most first when ordered by ``n`` and then by node."""
    return reach_from_each(edges, max_depth).where("root <> node").groupBy(F.col("root").alias("node")).agg(F.count("*").alias("n"))


def override_cascade(overrides: DataFrame, members: DataFrame) -> DataFrame:
    """``(node, origin)``: all members that override, or are overridden by, one of ``members(node)``, by any number of steps of ``overrides(src, dst)``: src overrides dst."""
    edges = _edges(overrides)
    up = reach(edges, members)
    tops = up.join(edges.select(F.col("src").alias("node")), "node", "left_anti").select("node")
    down = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(down, tops).select("node", (F.col("depth") == 0).alias("origin"))
