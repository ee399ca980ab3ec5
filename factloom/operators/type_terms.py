"""Type terms as arrays of nodes, open generics matched with closed ones, and extension methods by what they match.

A term is the array of its nodes in order, each with its path from the root (``.0.1`` is the second argument of the first), its
name and its number of arguments; ``?T`` is a variable. Parsing, matching and substitution are column expressions over
these arrays. A variable stands for the part of the closed term at its path; everywhere the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, cut_and_count

NODE = "struct<path: string, name: string, arity: int>"
TERM = f"array<{NODE}>"
#: Stands for the root of a pattern that is a variable.
ANY = "*"


def _node(path: Column, name: Column, arity: Column) -> Column:
    return F.struct(path.alias("path"), name.alias("name"), arity.cast("int").alias("arity"))


def parsed(text: Column) -> Column:
    """The term of a type as written: ``Map<string, List<?T>>``, ``T[]`` and ``T?`` with any nesting; null if brackets do not match.

    An array of ``T`` is ``[]`` of one argument, a nullable ``T`` is ``?`` of one.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"\?[A-Za-z_]\w*|[A-Za-z_][\w.]*|\[\]|[<>,?]"), F.lit(0))
    # path: where the next name goes; an argument's last step counts those before it
    kind = f"struct<path: string, nodes: {TERM}, good: boolean>"
    start = F.struct(F.lit("").alias("path"), F.array().cast(TERM).alias("nodes"), F.lit(True).alias("good")).cast(kind)

    def step(state: Column, token: Column) -> Column:
        path, nodes = state["path"], state["nodes"]
        up = F.regexp_replace(path, r"\.\d+$", "")
        following = F.concat(up, F.lit("."), (F.regexp_extract(path, r"(\d+)$", 1).try_cast("int") + 1).cast("string"))
        # a suffix takes what stands at the path, and all below it, one step down under a node of its own
        inside = lambda n: (n["path"] == path) | F.startswith(n["path"], F.concat(path, F.lit(".")))
        lowered = F.transform(F.filter(nodes, inside), lambda n: _node(F.concat(path, F.lit(".0"), F.substr(n["path"], F.length(path) + 1)), n["name"], n["arity"]))
        suffix = F.concat(F.filter(nodes, lambda n: ~inside(n)), F.array(_node(path, token, F.lit(1))), lowered)
        name = F.concat(nodes, F.array(_node(path, token, F.lit(0))))
        wraps = token.isin("?", "[]")
        there = F.exists(nodes, lambda n: n["path"] == path)
        return F.struct(
            F.when(token == "<", F.concat(path, F.lit(".0"))).when(token == ",", following).when(token == ">", up).otherwise(path).alias("path"),
            F.when(token.isin("<", ",", ">"), nodes).when(wraps, suffix).otherwise(name).alias("nodes"),
            (state["good"] & F.when(token.isin(",", ">"), path != "").when((token == "<") | wraps, there).otherwise(~there)).alias("good"),
        ).cast(kind)

    found = F.aggregate(tokens, start, step)
    # the number of arguments is that of the nodes one step below
    counted = F.transform(found["nodes"], lambda n: _node(n["path"], n["name"], F.size(F.filter(found["nodes"], lambda m: F.startswith(m["path"], F.concat(n["path"], F.lit("."))) & ~F.contains(F.substr(m["path"], F.length(n["path"]) + 2), F.lit("."))))))
    return F.when(found["good"] & (found["path"] == "") & (F.size(found["nodes"]) > 0), F.array_sort(counted)).cast(TERM)


def below(term: Column, path: Column) -> Column:
    """The part of a term at a path, with paths from there."""
    return F.transform(F.filter(term, lambda n: (n["path"] == path) | F.startswith(n["path"], F.concat(path, F.lit(".")))), lambda n: _node(F.substr(n["path"], F.length(path) + 1), n["name"], n["arity"]))


def variable(node: Column) -> Column:
    return F.startswith(node["name"], F.lit("?")) & (F.length(node["name"]) > 1)


def bindings(pattern: Column, term: Column) -> Column:
    """``array<struct<name, part>>``: what each variable of a pattern stands for, each once."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(pattern, variable), lambda n: F.struct(n["name"].alias("name"), below(term, n["path"]).alias("part")))))


def matches(pattern: Column, term: Column) -> Column:
    """Whether a closed term is the pattern for some parts in place of its variables."""
    fixed = F.forall(F.filter(pattern, lambda n: ~variable(n)), lambda n: F.exists(term, lambda m: (m["path"] == n["path"]) & (m["name"] == n["name"]) & (m["arity"] == n["arity"])))
    bound = bindings(pattern, term)
    names = F.array_distinct(F.transform(F.filter(pattern, variable), lambda n: n["name"]))
    return fixed & (F.size(bound) == F.size(names)) & F.forall(bound, lambda b: F.size(b["part"]) > 0)


def substituted(pattern: Column, bound: Column) -> Column:
    """The pattern with the parts of ``bindings`` in place of its variables; a variable that is not bound stays."""
    put = lambda n, part: F.transform(part, lambda m: _node(F.concat(n["path"], m["path"]), m["name"], m["arity"]))
    each = F.transform(pattern, lambda n: F.coalesce(F.get(F.transform(F.filter(bound, lambda b: b["name"] == n["name"]), lambda b: put(n, b["part"])), F.lit(0)), F.array(n)))
    return F.array_sort(F.flatten(each)).cast(TERM)


def written(term: Column) -> Column:
    """A text that two terms share only if they are equal: names by path."""
    return F.array_join(F.transform(term, lambda n: F.concat(n["path"], F.lit(":"), n["name"])), " ")


def _root(term: Column) -> Column:
    """The name and number of arguments at the root; null for a variable, which fits all."""
    first = F.get(term, F.lit(0))
    return F.when(~variable(first), F.concat(first["name"], F.lit("`"), first["arity"].cast("string")))


def base_terms(types: DataFrame, rules: DataFrame, max_depth: int = 20) -> DataFrame:
    """``(type, term, distance)``: each of ``types(type, term)`` and all closed terms that it is also, by ``rules(of, base)``: what is ``of`` is ``base``, as patterns.

    A rule is asked only of terms whose root it names. Each term counts at its least distance. Generic rules can make
    larger and larger terms without end, which an interface must not; the walk stops with an error after ``max_depth`` steps.
    """
    # written once: parsing is a large expression, and every step would plan it again
    known = cut(rules.select(_root(F.col("of")).alias("root"), "of", "base").where("root is not null and base is not null"))
    front, n = cut_and_count(types.select("type", "term", F.lit(0).alias("distance")).where("term is not null").distinct())
    seen, distance = [front], 0
    while n:
        distance += 1
        if distance > max_depth:
            raise ValueError(f"bases go on after {max_depth} steps")
        step = front.withColumn("root", _root(F.col("term"))).join(known, "root").where(matches(F.col("of"), F.col("term")))
        step = step.select("type", substituted(F.col("base"), bindings(F.col("of"), F.col("term"))).alias("term"), F.lit(distance).alias("distance")).distinct()
        front, n = cut_and_count(step.join(reduce(DataFrame.unionByName, seen).select("type", "term"), ["type", "term"], "left_anti"))
        seen.append(front)
    return reduce(DataFrame.unionByName, seen)


def extension_methods(types: DataFrame, rules: DataFrame, methods: DataFrame, constraints: DataFrame) -> DataFrame:
    """``(type, method, distance, arguments)``: the methods that each of ``types(type, term)`` has by extension.

    ``methods(method, receiver)`` extend what their receiver, a pattern, matches: the type itself or a base by ``rules``, the nearest one. With
    ``constraints(method, name, bound)`` a variable's part must be the closed term ``bound`` or have it as a base. ``arguments`` tells what
    the variables stand for.
    """
    rules, constraints = cut(rules.select("of", "base")), cut(constraints.select("method", "name", "bound"))
    terms = base_terms(types, rules)
    known = methods.where("receiver is not null").select("method", "receiver", F.coalesce(_root(F.col("receiver")), F.lit(ANY)).alias("root"))
    # a bare variable fits every type as it stands, so it is asked of that only
    roots = F.when(F.col("distance") == 0, F.array(_root(F.col("term")), F.lit(ANY))).otherwise(F.array(_root(F.col("term"))))
    met = terms.withColumn("root", F.explode(roots)).join(known, "root")
    found, _ = cut_and_count(met.where(matches(F.col("receiver"), F.col("term"))).select("type", "method", "distance", bindings(F.col("receiver"), F.col("term")).alias("bound")))
    # parts that a constraint asks of, with their own bases
    asked = found.select("type", "method", "distance", "bound", F.explode("bound").alias("b")).join(constraints.select("method", F.col("name").alias("var"), F.col("bound").alias("least")), "method").where("b.name = var")
    parts = asked.select(F.col("b.part").alias("term")).distinct().withColumn("type", written(F.col("term")))
    fits = base_terms(parts.select("type", "term"), rules).select(F.col("type").alias("part"), F.col("term").alias("least")).distinct()
    broken = asked.withColumn("part", written(F.col("b.part"))).join(fits, ["part", "least"], "left_anti").select("type", "method", "distance", "bound").distinct()
    good = found.join(broken, ["type", "method", "distance", "bound"], "left_anti")
    arguments = F.array_join(F.transform("bound", lambda b: F.concat(b["name"], F.lit("="), written(b["part"]))), "; ")
    return good.groupBy("type", "method").agg(F.min(F.struct("distance", arguments.alias("arguments"))).alias("b")).select("type", "method", "b.distance", "b.arguments")
