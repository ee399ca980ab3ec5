"""Which declaration a name means, by the scopes that are visible where it is used, and which members a call may reach.

Scopes of a use, from the nearest on: the enclosing types from the inside out, each with its bases by distance; then the
enclosing namespaces from the inside out; then the namespaces that the file imports. The nearest scope that declares the
name wins. Several declarations there are ambiguous, but members of one name in one type (overloads) are one.

Everything is an equi-join on (kind of scope, scope, name) and partial aggregation. A use is joined with what its own type
declares; other scopes are those of many uses at once, so there a name is looked up once for them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import override_cascade, reach_from_each
from .shared import cut

OK, AMBIGUOUS, MISSING = "ok", "ambiguous", "notFound"
#: Steps of a rank: within types (enclosing type, distance of the base), namespaces (segments dropped), imports.
TYPE, NAMESPACE, IMPORT = 0, 1, 2


def ancestors(edges: DataFrame, types: DataFrame) -> DataFrame:
    """``(type, scope, depth)``: each of ``types(type)`` at depth 0 and all above it in ``edges(src, dst)``, src derives from dst, at the least depth."""
    own = types.select("type", F.col("type").alias("scope"), F.lit(0).alias("depth"))
    above = reach_from_each(edges).select(F.col("root").alias("type"), F.col("node").alias("scope"), "depth")
    return own.unionByName(above.join(types.select("type"), "type", "left_semi").where("type <> scope"))


def _groups(rows: DataFrame, key: str, of: str, group: str) -> tuple[DataFrame, DataFrame]:
    """``(key, group)`` and ``(group, of)``: keys of ``rows(key, of)`` whose sets of ``of`` are the same are one group, which is named by the smallest of them."""
    sets = cut(rows.groupBy(key).agg(F.sort_array(F.collect_set(of)).alias("_set")))
    named = cut(sets.groupBy("_set").agg(F.min(key).alias(group)))
    return sets.join(named, "_set").select(key, group), named.select(group, F.explode("_set").alias(of))


def _inner(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Those of ``edges(src, dst)`` that a walk from ``starts(src)`` or from the end of an edge can take."""
    return edges.join(starts.unionByName(edges.select(F.col("dst").alias("src"))).distinct(), "src", "left_semi")


def type_kin(types: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(type, kin)`` of each of ``types(type, container)`` and ``(kin, scope, outward, depth)``: the scopes within types that types of a kin see beyond their own; ``bases(src, dst)``.

    Types with the same bases and the same container are a kin: beyond their own they see the same. So what a name means there is asked
    once for a kin, and scopes are worked out from bases and containers on, never from each type.
    """
    edge = bases.select("src", "dst").where("src is not null and dst is not null").distinct()
    hold = types.select(F.col("type").alias("src"), F.col("container").alias("dst")).where("src is not null and dst is not null").distinct()
    known = types.select("type").where("type is not null").distinct()
    next_ = lambda rows, how: rows.select(F.col("src").alias("type"), F.struct(F.lit(how).alias("how"), F.col("dst").alias("head")).alias("next"))
    none = known.select("type", F.lit(None).cast("struct<how: string, head: string>").alias("next"))
    # a type that is a base is of its own kin: around a cycle it is no scope above itself, but it is above others
    alone = known.join(edge.select(F.col("dst").alias("type")).distinct(), "type", "left_semi").select(F.col("type").alias("src"), F.col("type").alias("dst"))
    nexts = none.unionByName(next_(edge.join(known.withColumnRenamed("type", "src"), "src", "left_semi"), "base")).unionByName(next_(hold, "container")).unionByName(next_(alone, "self"))
    kin, heads = _groups(nexts, "type", "next", "kin")
    heads = cut(heads.select("kin", "next.how", "next.head"))
    above = lambda rows, starts: _with_own(starts, reach_from_each(_inner(rows, starts.withColumnRenamed("type", "src"))))
    first = heads.where("how = 'base'").select("kin", F.col("head").alias("enclosing"), F.lit(0).alias("outward"), F.lit(1).alias("step"))
    around = heads.where("how = 'container'").select("kin", F.col("head").alias("type"))
    outer = around.join(above(hold, around.select("type").distinct()), "type").groupBy("kin", F.col("scope").alias("enclosing")).agg((F.min("depth") + 1).alias("outward"))
    outer = outer.join(known.withColumnRenamed("type", "enclosing"), "enclosing", "left_semi").select("kin", "enclosing", "outward", F.lit(0).alias("step"))
    starts = cut(first.unionByName(outer))
    met = starts.join(above(edge, starts.select(F.col("enclosing").alias("type")).distinct()).withColumnRenamed("type", "enclosing"), "enclosing")
    rank = F.min(F.struct("outward", (F.col("depth") + F.col("step")).alias("depth"))).alias("r")
    return kin, cut(met.where("step = 0 or scope <> kin").groupBy("kin", "scope").agg(rank).select("kin", "scope", "r.outward", "r.depth"))


def _with_own(types: DataFrame, reached: DataFrame) -> DataFrame:
    """``(type, scope, depth)``: each of ``types(type)`` at depth 0, and what ``reached(root, node, depth)`` has for it."""
    above = reached.select(F.col("root").alias("type"), F.col("node").alias("scope"), "depth").where("type <> scope")
    return types.select("type", F.col("type").alias("scope"), F.lit(0).alias("depth")).unionByName(above.join(types, "type", "left_semi"))


def declared(types: DataFrame, members: DataFrame) -> DataFrame:
    """``(kind, scope, name, id)`` of ``types(type, name, namespace, container)`` and ``members(member, name, type)``: what each scope declares.

    A member stands for all of its type's members of the name: the smallest id is theirs.
    """
    nested = types.where("container is not null").select(F.lit("type").alias("kind"), F.col("container").alias("scope"), "name", F.col("type").alias("id"))
    top = types.where("container is null").select(F.lit("namespace").alias("kind"), F.coalesce("namespace", F.lit("")).alias("scope"), "name", F.col("type").alias("id"))
    group = members.groupBy("type", "name").agg(F.min("member").alias("id")).select(F.lit("type").alias("kind"), F.col("type").alias("scope"), "name", "id")
    return nested.unionByName(top).unionByName(group).where("name is not null").distinct()


def _rank(tier: int, outward: Column, depth: Column) -> Column:
    return F.struct(F.lit(tier).alias("tier"), outward.cast("int").alias("outward"), depth.cast("int").alias("depth")).alias("rank")


def _namespaces(namespaces: DataFrame) -> DataFrame:
    """``(namespace, kind, scope, rank)``: the enclosing namespaces of each of ``namespaces(namespace)``, from the inside out, down to the one without a name."""
    parts = F.when(F.col("namespace") == "", F.array().cast("array<string>")).otherwise(F.split("namespace", r"\."))
    dropped = F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("dropped")
    scope = F.array_join(F.slice("parts", F.lit(1), F.size("parts") - F.col("dropped")), ".")
    return namespaces.withColumn("parts", parts).select("namespace", "parts", dropped).select("namespace", F.lit("namespace").alias("kind"), scope.alias("scope"), _rank(NAMESPACE, F.col("dropped"), F.lit(0)))


def _nearest(by: str, scopes: DataFrame, names: DataFrame, at: DataFrame) -> DataFrame:
    """``(by, name, b)``, ``b`` of ``rank``, ``n`` and ``id``: what each name means by the nearest of ``scopes(by, kind, scope, rank)`` that declare it; ``names(kind, scope, name, id)``, ``at`` how many of them each scope has.

    Where several scopes of one rank declare a name, what they declare is counted once each; elsewhere a scope's own number is right.
    """
    place = ["kind", "scope", "name"]
    met = scopes.join(at, place[:2]).groupBy(by, "name", "rank").agg(F.count("*").alias("scopes"), F.sum("n").alias("n"), F.min("id").alias("id"))
    first = cut(met.groupBy(by, "name").agg(F.min(F.struct("rank", "scopes", "n", "id")).alias("b")).select(by, "name", "b.*"))
    one = first.where("scopes = 1").select(by, "name", "rank", "n", "id")
    several = first.where("scopes > 1").select(by, "name", "rank").join(scopes, [by, "rank"]).join(names, place)
    several = several.groupBy(by, "name", "rank").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    return cut(one.unionByName(several).select(by, "name", F.struct("rank", "n", "id").alias("b")))


def _status(n: Column) -> Column:
    return F.when(n == 0, MISSING).when(n == 1, OK).otherwise(AMBIGUOUS).alias("status")


def bind(uses: DataFrame, types: DataFrame, members: DataFrame, bases: DataFrame, imports: DataFrame) -> DataFrame:
    """``(name, type, namespace, file, status, tier, outward, depth, id, n)`` of each distinct use ``(name, type, namespace, file)``.

    ``types(type, name, namespace, container)``, ``members(member, name, type)``, ``bases(src, dst)``, ``imports(file, namespace)``.
    ``id`` is null unless the status is ok, ``n`` how many declarations the nearest scope has. A use outside of any
    type has a null ``type``; a null or empty namespace is the one without a name. A type or member without a name is never meant.

    A use meets its type's own declarations only; what a name means beyond is asked once for a kin of types, a namespace and a set of imports.
    """
    names = cut(declared(types, members))
    at = names.groupBy("kind", "scope", "name").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    asked = uses.select("name", "type", "namespace", "file").where("name is not null").distinct()
    kin, scopes = type_kin(types, bases)
    wide = _nearest("kin", scopes.select("kin", F.lit("type").alias("kind"), "scope", _rank(TYPE, F.col("outward"), F.col("depth"))), names, at)
    spaces = cut(asked.select(F.coalesce("namespace", F.lit("")).alias("namespace")).distinct())
    around = _nearest("namespace", _namespaces(spaces), names, at)
    sets, of = _groups(imports.select("file", "namespace").where("file is not null and namespace is not null"), "file", "namespace", "imports")
    brought = _nearest("imports", of.select("imports", F.lit("namespace").alias("kind"), F.col("namespace").alias("scope"), _rank(IMPORT, F.lit(0), F.lit(0))), names, at)
    own = at.where("kind = 'type'").select(F.col("scope").alias("type"), "name", F.struct(_rank(TYPE, F.lit(0), F.lit(0)), "n", "id").alias("own"))
    rows = asked.join(sets, "file", "left").join(kin, "type", "left").join(own, ["type", "name"], "left")
    rows = rows.join(wide.withColumnRenamed("b", "wide"), ["kin", "name"], "left").join(brought.withColumnRenamed("b", "brought"), ["imports", "name"], "left")
    rows = rows.withColumn("_space", F.coalesce("namespace", F.lit(""))).join(around.select(F.col("namespace").alias("_space"), "name", F.col("b").alias("around")), ["_space", "name"], "left")
    b = F.coalesce(F.when(F.col("kin").isNotNull(), F.col("own")), "wide", "around", "brought")
    rows = rows.select("name", "type", "namespace", "file", b.alias("b"))
    n = F.coalesce("b.n", F.lit(0))
    return rows.select("name", "type", "namespace", "file", _status(n), "b.rank.tier", "b.rank.outward", "b.rank.depth", F.when(n == 1, F.col("b.id")).alias("id"), n.alias("n"))


def bind_qualified(uses: DataFrame, types: DataFrame, members: DataFrame, bases: DataFrame) -> DataFrame:
    """``(type, name, status, depth, id, n)`` of distinct ``uses(type, name)`` of a name on a known type: its nearest base that declares the name wins; bases at one distance are ambiguous.

    What a type does not declare itself is asked once for all types of the same bases.
    """
    names = cut(declared(types, members).where("kind = 'type'"))
    at = names.groupBy("kind", "scope", "name").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    asked = uses.select("type", "name").where("type is not null and name is not null").distinct()
    kin, scopes = type_kin(types.select("type", F.lit(None).cast("string").alias("container")), bases)
    wide = _nearest("kin", scopes.select("kin", F.lit("type").alias("kind"), "scope", _rank(TYPE, F.col("outward"), F.col("depth"))), names, at)
    own = at.select(F.col("scope").alias("type"), "name", F.struct(_rank(TYPE, F.lit(0), F.lit(0)), "n", "id").alias("own"))
    rows = asked.join(own, ["type", "name"], "left").join(kin, "type", "left").join(wide, ["kin", "name"], "left")
    rows = rows.select("type", "name", F.coalesce(F.when(F.col("kin").isNotNull(), F.col("own")), "b").alias("b"))
    n = F.coalesce("b.n", F.lit(0))
    return rows.select("type", "name", _status(n), "b.rank.depth", F.when(n == 1, F.col("b.id")).alias("id"), n.alias("n"))


def _dispatch(methods: DataFrame, bases: DataFrame, interfaces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overrides ``(src, dst)``, and what is done for interfaces by slot, that is by interface and signature: who does it ``(src, interface, signature)``, and whose it is ``(interface, signature, dst)``.

    A method's own type is asked for itself; what stands above is asked once for all types of the same bases.
    """
    every = _types(methods, bases, interfaces)
    kin, scopes = type_kin(every.select("type", F.lit(None).cast("string").alias("container")), bases)
    # of several methods of one signature in a type, which no compiler lets pass, the smallest counts
    only = cut(methods.groupBy(F.col("type").alias("scope"), "signature").agg(F.min("member").alias("base")))
    above = scopes.join(only, "scope").groupBy("kin", "signature").agg(F.min(F.struct("depth", "base")).alias("b"))
    mine = methods.where("overrides").select("member", "type", "signature").join(kin, "type").join(cut(above), ["kin", "signature"])
    overriding = mine.groupBy("member").agg(F.min("b").alias("b")).select(F.col("member").alias("src"), F.col("b.base").alias("dst"))
    # interfaces of a class: those it names, of classes above it, and what these extend
    wider = _with_own(interfaces.select(F.col("dst").alias("type")).distinct(), reach_from_each(_inner(interfaces, interfaces.select(F.col("dst").alias("src")))))
    wider = cut(wider.select(F.col("type").alias("named"), F.col("scope").alias("interface")))
    wide = lambda rows, key: rows.select(key, F.col("dst").alias("named")).distinct().join(wider, "named").select(key, "interface").distinct()
    of_kin = wide(scopes.select("kin", F.col("scope").alias("src")).join(interfaces, "src"), "kin")
    own = wide(interfaces.withColumnRenamed("src", "type"), "type")
    classes = methods.select("type").join(interfaces.select(F.col("dst").alias("type")), "type", "left_anti").unionByName(bases.select(F.col("src").alias("type"))).distinct()
    classes = classes.join(kin, "type")
    asked = classes.join(of_kin, "kin").unionByName(classes.join(own, "type").select("kin", "type", "interface")).distinct()
    homes = cut(methods.select(F.col("type").alias("interface"), "signature", F.col("member").alias("dst")).join(interfaces.select(F.col("dst").alias("interface")).distinct(), "interface", "left_semi").distinct())
    slots = cut(homes.select("interface", "signature").distinct())
    wanted = cut(asked.join(slots, "interface"))
    far = wanted.select("kin", "interface", "signature").distinct().join(scopes, "kin").where("scope <> interface").join(only, ["scope", "signature"])
    far = cut(far.groupBy("kin", "interface", "signature").agg(F.min(F.struct("depth", "base")).alias("b")).select("kin", "interface", "signature", F.col("b.base").alias("far")))
    near = only.select(F.col("scope").alias("type"), "signature", F.col("base").alias("near"))
    done = wanted.join(near, ["type", "signature"], "left").join(far, ["kin", "interface", "signature"], "left")
    src = F.coalesce(F.when(F.col("type") != F.col("interface"), F.col("near")), "far")
    return overriding, cut(done.select(src.alias("src"), "interface", "signature").where("src is not null").distinct()), homes


def override_edges(methods: DataFrame, bases: DataFrame, interfaces: DataFrame) -> DataFrame:
    """``(src, dst, how)``: the member ``src`` stands in for ``dst`` when that is called.

    ``methods(member, type, signature, overrides)``, a row for each member; ``bases(src, dst)`` are classes, ``interfaces(src, dst)`` what a class or an interface
    names. A method that overrides replaces the one of its signature in the nearest class above (``override``). For
    each class and each interface that it or a class above names, or that such an interface extends, a method of the interface is done by
    the method of its signature that is nearest to the class (``interface``); none may be.

    Pairs of an interface are as many as its methods of a signature times the methods that do them; they are made last, and not moved again.
    """
    overriding, doing, homes = _dispatch(methods, bases, interfaces)
    pairs = doing.join(homes, ["interface", "signature"]).select("src", "dst", F.lit("interface").alias("how"))
    return overriding.withColumn("how", F.lit("override")).select("src", "dst", "how").unionByName(pairs)


def override_graph(methods: DataFrame, bases: DataFrame, interfaces: DataFrame) -> DataFrame:
    """``(src, dst)``: the edges of ``override_edges``, those for an interface over a node for its slot, so that they are not multiplied; two members are connected as they are there.

    The name of such a node starts with a character of code 0 and is no member's.
    """
    overriding, doing, homes = _dispatch(methods, bases, interfaces)
    slot = F.concat(F.lit("\0"), F.col("interface"), F.lit("\0"), F.col("signature"))
    return overriding.unionByName(doing.select("src", slot.alias("dst"))).unionByName(homes.select(slot.alias("src"), "dst").join(doing.select(slot.alias("src")).distinct(), "src", "left_semi"))


def _types(methods: DataFrame, bases: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Every ``type`` that one of the tables names."""
    some = methods.select("type")
    for edges in (bases, interfaces):
        for c in ("src", "dst"):
            some = some.unionByName(edges.select(F.col(c).alias("type")))
    return some.where("type is not null").distinct()


def dispatch_targets(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``(target)``: all members a call of which may run one of ``targets(target)``, or that a call of one may run: the cascade of ``override_edges`` or ``override_graph`` to its fixed point."""
    return override_cascade(edges.select("src", "dst"), targets.select(F.col("target").alias("node"))).select(F.col("node").alias("target"))


def callers_by_dispatch(occurrences: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Places ``(file, line)`` that call one of ``targets(target)``, also through what it overrides, does for an interface or is overridden by; two calls on one line are one place, ``n`` tells how many and ``direct`` how many name a target itself."""
    named = dispatch_targets(edges, targets).join(targets.select("target", F.lit(1).alias("own")).distinct(), "target", "left")
    return occurrences.join(named, "target").groupBy("file", "line").agg(F.min("project").alias("project"), F.count("*").alias("n"), F.count("own").alias("direct"))
