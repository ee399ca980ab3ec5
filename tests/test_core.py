"""Operators, sources and plans on small literal inputs; an empty result always has a twin that is not."""

import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from factloom import errors
from factloom.functions import predicates
from factloom.functions.stack_trace import demangle, trace_rows
from factloom.operators import code_queries as Q
from factloom.operators import graph
from factloom.operators.envelope import first_by, list_result
from factloom.plans import driver_queries, snapshots
from factloom.sources import csharp, solution
from factloom.streaming import changes

SOURCE = '''
using System;
using App.Core;
namespace App.Web;

[Obsolete("old")]
public sealed class Shop<T> : Base<T>, IShop where T : class
{
    private readonly int _count = 3;
    public int Total { get; set; }
    public Shop(int a) { _count = a; }
    public int Sum(int[] xs, bool deep)
    {
        var s = 0;
        foreach (var x in xs)          // +1, +1
        {
            if (x > 0 && deep)         // +2, +2 +1
                s += x;
            else                       // cognitive +1
                s -= 1;
        }
        try { Check(s); }
        catch (InvalidOperationException e) when (deep) { }   // +1, +1
        catch { throw; }                                       // +1, +1
        return s > 3 ? s : throw new ArgumentException("x");  // +1, +1
    }
    public T Make<U>(U u) => new Thing(u).Build<T>();
    interface IInner { void Go(); }
}
enum Color { Red, Green }
'''


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (5, 6), (6, 5), (2, 4)], "src int, dst int")


def seed(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node int")


def test_scope_pattern(spark):
    names = spark.createDataFrame([("A.B",), ("A.B.C",), ("A.BC",), (None,)], "n string")
    matching = lambda p: [r.n for r in names.where(predicates.scope_matches(F.col("n"), p)).collect()]
    assert matching("A.B.*") == ["A.B", "A.B.C"] and matching("A.B") == ["A.B"] and len(matching("*")) == 4
    with pytest.raises(errors.InvalidArgument):
        predicates.scope_matches(F.col("n"), "A*")


def test_helpers(spark):
    row = spark.range(1).select(predicates.percent(F.lit(2), F.lit(3)).alias("p"), predicates.percent(F.lit(0), F.lit(0)).alias("e"), predicates.shortened(F.lit("abcdef"), 3).alias("s"), predicates.match_rank(F.lit("Abc"), "AB").alias("r")).first()
    assert tuple(row) == (66, 100, "abc...", 1)
    assert predicates.glob_regex("App.*?") == "(?i)^App\\..*.$"
    with pytest.raises(errors.InvalidArgument):
        predicates.glob_regex("[a]")
    assert '"code": "InvalidArgument"' in errors.InvalidArgument("x", a=1).to_json()


@pytest.mark.parametrize(("limit", "truncated"), [(3, False), (2, True), (0, True)])
def test_envelope(spark, limit, truncated):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, k string")
    out = list_result(rows, [F.col("id")], limit, {"byK": F.col("k")})
    assert out.items.count() == limit and tuple(out.meta.first()) == (3, truncated, limit)
    assert sorted(map(tuple, out.summary.collect())) == [("byK", "a", 2), ("byK", "b", 1)]


def test_envelope_of_nothing(spark):
    rows = spark.createDataFrame([], "id int, k string")
    out = list_result(rows, [F.col("id")], 5, {"byK": F.col("k")})
    assert tuple(out.meta.first()) == (0, False, 5) and out.summary.count() == 0


def test_first_by(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "z"), ("b", 1, None)], "k string, o int, v string")
    assert sorted(map(tuple, first_by(rows, ["k"], ["o"]).collect())) == [("a", 1, "z"), ("b", 1, None)]


def test_reach(spark, edges):
    assert sorted(map(tuple, graph.reach(edges, seed(spark, 1), 1).collect())) == [(1, 0), (2, 1)]
    assert sorted(map(tuple, graph.reach(edges, seed(spark, 1)).collect())) == [(1, 0), (2, 1), (3, 2), (4, 2)]
    assert graph.reach(edges, seed(spark, 9)).collect()[0].node == 9
    closure = {(r.root, r.node): r.depth for r in graph.reach_from_each(edges).collect()}
    assert closure[1, 1] == 3 and closure[4, 4] == 1 and (4, 1) not in closure


def test_cycles_paths_levels(spark, edges):
    assert sorted((r.length, r.cycle) for r in graph.simple_cycles(edges, 4).collect()) == [(1, [4, 4]), (2, [5, 6, 5]), (3, [1, 2, 3, 1])]
    assert graph.simple_cycles(edges.where("src < dst"), 4).count() == 0
    found = graph.paths(edges, seed(spark, 1), 3, seed(spark, 3))
    assert sorted(r.path for r in found.collect()) == [[1, 2], [1, 2, 3], [1, 2, 4]]
    tree = edges.where("src < dst and src < 5")
    assert dict(map(tuple, graph.levels(tree, seed(spark, 1, 2, 3, 4, 7)).collect())) == {1: 3, 2: 2, 3: 1, 4: 0, 7: 0}
    assert dict(map(tuple, graph.levels(edges, seed(spark, 1, 2, 3, 4)).collect()))[1] == 0


def test_references_check_kinds_first(spark):
    occ = spark.createDataFrame([(1, "f", 1, 1, "read", None), (1, "f", 1, 1, "read", None), (1, "f", 1, 2, "write", ""), (2, "f", 3, 1, "read", "p")], "target int, file string, line int, col int, kind string, project string")
    targets = occ.where("target = 1").select("target").distinct()
    assert Q.references(occ, targets, None, ["read", "write"]).count() == 2
    assert Q.references(occ, targets, ["READ"], ["read", "write"]).count() == 1
    assert Q.callers(occ, targets).count() == 1
    with pytest.raises(errors.InvalidArgument):
        Q.references(occ, targets, ["nope"], ["read"])


def test_breaking_changes(spark):
    schema = "name string, kind string, access int, seq int"
    a = spark.createDataFrame([("same", "c", 1, 1), ("gone", "c", 1, 1), ("kind", "c", 1, 1), ("narrow", "c", 1, 1), ("wide", "c", 2, 1), ("last", "c", 1, 1), ("last", "c", 2, 2)], schema)
    b = spark.createDataFrame([("same", "c", 1, 1), ("new", "c", 1, 1), ("kind", "s", 2, 1), ("narrow", "c", 2, 1), ("wide", "c", 1, 1), ("last", "c", 2, 1)], schema)
    got = {r.name: (r.change, r.severity) for r in Q.breaking_changes(a, b).collect()}
    assert got == {"gone": ("Removed", "Breaking"), "new": ("Added", "NonBreaking"), "kind": ("KindChanged", "Breaking"), "narrow": ("AccessibilityNarrowed", "Breaking"), "wide": ("AccessibilityWidened", "NonBreaking")}
    assert Q.breaking_changes(a, a).count() == 0


def test_architecture(spark):
    rows = spark.createDataFrame([("D.A", "I.B", "f", 2, "x"), ("D.A", "I.B", "f", 1, "x"), ("I.B", "D.A", "g", 1, "x"), ("D.A", "D.A", "h", 1, "x")], "source string, target string, file string, line int, tie string")
    forbid = [{"name": "r", "kind": "forbid", "from": "D.*", "to": ["I.*"]}]
    assert [tuple(r) for r in Q.architecture(rows, forbid, 1).collect()] == [("r", "D.A", "I.B", 2, 1, "f", 1)]
    assert Q.architecture(rows, [forbid[0] | {"to": ["X"]}], 1).count() == 0
    with pytest.raises(errors.InvalidArgument) as e:
        Q.architecture(rows, [*forbid, {"name": "q", "kind": "?", "from": "*", "to": []}], 1)
    assert e.value.details["ruleIndex"] == 1


def test_innermost(spark):
    points = spark.createDataFrame([(1, 5, 1), (1, 50, 2)], "scope int, at int, id int")
    spans = spark.createDataFrame([(1, 0, 10, 7), (1, 4, 6, 8), (1, 5, 5, 9)], "scope int, start int, stop int, span int")
    assert [tuple(r)[:4] for r in Q.innermost(points, spans).collect()] == [(1, 5, 1, 8)]


def test_innermost_by_brute_force(spark):
    """Nested and neighbouring spans with common borders, empty and open ones, several scopes, points at borders and twice."""
    rnd = random.Random(3)
    spans, points = [], []

    def nest(scope, low, high, depth):
        at = low
        while at < high:
            stop = rnd.randint(at, high)
            if rnd.random() < 0.7:
                spans.append((scope, at, stop, len(spans)))
                if depth and stop > at:
                    nest(scope, at, stop, depth - 1)
            at = max(stop, at + 1)

    for scope in range(5):
        nest(scope, 0, 60, 3)
        points += [(scope, rnd.randint(-2, 65), k) for k in range(60)]
    spans += [(0, 3, None, 1000), (None, 1, 5, 1001)]
    points += [points[0], (9, 1, 1)]
    want = set()
    for scope, at, i in points:
        held = [(start, -stop, span) for s, start, stop, span in spans if s == scope and stop is not None and start <= at < stop]
        if held:
            start, _, span = max(held)
            want.add((scope, at, i, span, start))
    got = Q.innermost(spark.createDataFrame(points, "scope int, at int, id int"), spark.createDataFrame(spans, "scope int, start int, stop int, span int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_call_graph(spark, edges):
    nodes, inside = graph.call_graph(edges, seed(spark, 1), "callees", 2, 500)
    assert sorted(map(tuple, nodes.collect())) == [(1, 0, True), (2, 1, True), (3, 2, False), (4, 2, False)]
    assert sorted(map(tuple, inside.collect())) == [(1, 2), (2, 3), (2, 4)]  # 3 and 4 are not expanded
    nodes, inside = graph.call_graph(edges, seed(spark, 4), "callers", 5, 2)
    assert [r.node for r in nodes.orderBy("depth", "node").collect()] == [4, 2]
    assert sorted(map(tuple, inside.collect())) == [(1, 2), (2, 4), (3, 4), (4, 4)]  # 1 and 3 are dropped, the edges from them are not
    assert {r.node for r in graph.call_graph(edges, seed(spark, 5), "both", 1)[0].collect()} == {5, 6}
    with pytest.raises(errors.InvalidArgument):
        graph.call_graph(edges, seed(spark, 1), "up")


def test_closure_sizes_and_overrides(spark, edges):
    assert dict(map(tuple, graph.closure_sizes(edges).collect())) == {1: 3, 2: 3, 3: 3, 5: 1, 6: 1}
    overrides = spark.createDataFrame([(2, 1), (3, 2), (4, 1), (6, 5)], "src int, dst int")
    assert sorted(map(tuple, graph.override_cascade(overrides, seed(spark, 3)).collect())) == [(1, True), (2, False), (3, False), (4, False)]


def test_extract():
    rows = csharp.extract(SOURCE)
    of = lambda kind: [(r[1], r[7]) for r in rows if r[0] == kind]
    assert of("using") == [("System", ""), ("App.Core", "")]
    assert of("type") == [("Shop", "class"), ("IInner", "interface"), ("Color", "enum")]
    assert of("base") == [("Base<T>", ""), ("IShop", "")]
    assert of("attribute") == [("Obsolete", '"old"')]
    assert of("member") == [("_count", "field"), ("Total", "property"), ("Shop", "constructor"), ("Sum", "method"), ("Make", "method"), ("Go", "method")]
    assert of("catch") == [("InvalidOperationException", "empty"), ("(bare catch)", "rethrows")]
    assert of("throw") == [("(rethrow)", ""), ("ArgumentException", "")]
    assert ("Check", "method") in of("call") and ("Thing", "constructor") in of("call")
    assert next(r for r in rows if r[1] == "Sum")[2] == "App.Web.Shop.Sum"


def test_complexity():
    body = next(r for r in csharp.extract(SOURCE) if r[1] == "Sum")
    assert (body[8], body[9]) == (7, 8)
    assert csharp.complexity([]) == (1, 0, 0)
    text = "do { if (a || b || c) { go(); } else if (d) { } } while (x); for (;;) { goto end; }"
    assert csharp.complexity(csharp.tokens(text))[0] == 7


def test_broken_sources_do_not_fail():
    for text in ("", "class", "class A {", "namespace", "}", "[", "class A { void M( {", "using", '"open', "class A { int x = ; }"):
        csharp.extract(text)


def test_facts(spark):
    files = spark.createDataFrame([("a.cs", "p", SOURCE), ("a.cs", "p", SOURCE), ("b.cs", "p", None)], "file string, project string, text string")
    got = csharp.facts(files)
    assert got.where("kind = 'type'").count() == 3 and {r.file for r in got.collect()} == {"a.cs"}
    assert csharp.is_generated("X.G.cs", "") and csharp.is_generated("x.cs", "// <auto-generated/>") and not csharp.is_generated("x.cs", "class A {}")


PROJECT = '<Project Sdk="Microsoft.NET.Sdk"><ItemGroup><PackageReference Include="xunit" Version="2.1" /><PackageReference Include="B"><Version>3</Version></PackageReference><PackageReference Include="C" /><ProjectReference Include="..\\L\\L.csproj" /></ItemGroup></Project>'


def test_solution(spark):
    assert solution.solution_projects("/r/a.slnx", '<Solution><Project Path="A/A.csproj" /></Solution>') == ["/r/A/A.csproj"]
    assert solution.solution_projects("/r/a.sln", 'Project("{F}") = "A", "A\\A.csproj", "{1}"\nEndProject') == ["/r/A/A.csproj"]
    assert solution.solution_projects("/r/a.slnx", "<broken") == []
    assert [solution.project_kind(x) for x in (PROJECT, None, "<x", '<Project xmlns="http://schemas.microsoft.com/developer/msbuild/2003"/>')] == ["SdkStyle", "Missing", "Unknown", "Legacy"]
    assert solution.project_facts("/r/A/A.csproj", "﻿" + PROJECT) == [("package", "xunit", "2.1"), ("package", "B", "3"), ("package", "C", "*"), ("reference", "/r/L/L.csproj", "")]
    assert solution.is_test_project(PROJECT) and not solution.is_test_project("<Project/>")
    rows = solution.packages(spark.createDataFrame([("p", PROJECT), ("q", "<broken")], "path string, text string")).collect()
    assert sorted(map(tuple, rows)) == [("p", "B", "3"), ("p", "C", "*"), ("p", "xunit", "2.1")]
    refs = spark.createDataFrame([("x/App.Api.csproj", "x/Core.csproj")], "src string, dst string")
    got = solution.filtered_projects(spark, ["x/App.Api.csproj", "x/Core.csproj", "x/Other.csproj"], refs, include=["app.*"])
    assert sorted(r.node for r in got.collect()) == ["x/App.Api.csproj", "x/Core.csproj"]
    with pytest.raises(errors.InvalidArgument):
        solution.filtered_projects(spark, ["x/A.csproj"], refs, include=["nope*"])


def test_stack_trace(spark):
    text = "System.InvalidOperationException: no\n ---> System.Exception: inner\n   at App.Shop.<BuyAsync>d__3.MoveNext() in /src/Shop.cs:line 12\n--- End of stack trace ---\n\n   at App.Shop.<>c__DisplayClass1_0.<Run>b__0(Int32 x, String y)\n   at something odd\n   at App.Shop..ctor(Int32 a)"
    got = [tuple(r)[2:] for r in trace_rows(spark.createDataFrame([(1, text)], "trace_id int, text string")).orderBy("position").collect()]
    assert got == [
        ("exception", "System.InvalidOperationException", None, None, None, None),
        ("exception", "System.Exception", None, None, None, None),
        ("frame", "App.Shop.BuyAsync", "stateMachine", 0, "/src/Shop.cs", 12),
        ("frame", "App.Shop.Run", "lambda", 2, None, None),
        ("unknown", None, None, None, None, None),
        ("frame", "App.Shop.Shop", "constructor", 1, None, None),
    ]
    assert demangle("A.B.<Run>g__Local|0_1") == ("A.B.Run.Local", "localFunction") and demangle("A.L`1[T].Go") == ("A.L.Go", "method")


def test_changes(spark, tmp_path):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, digest string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, digest string")
    found = changes.manifest_diff(before, after)
    assert sorted(map(tuple, found.collect())) == [("b", "changed"), ("c", "removed"), ("d", "added")]
    assert changes.manifest_diff(before, before).count() == 0
    files = spark.createDataFrame([("b", "core"), ("z", "other")], "path string, project string")
    refs = spark.createDataFrame([("web", "core"), ("test", "web"), ("other", "x")], "src string, dst string")
    assert sorted(r.node for r in changes.stale_projects(found, files, refs).collect()) == ["core", "test", "web"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/A.cs").write_text("class A {}")
    seen = []
    query = changes.watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda df, batch: seen.extend(r.text for r in df.collect()))
    query.awaitTermination(60)
    assert seen == ["class A {}"]


def test_snapshots(spark):
    catalog = snapshots.Catalog(spark)
    with pytest.raises(errors.NotLoaded):
        catalog.table("t")
    catalog.load("one.sln", {"t": spark.range(1)})
    catalog.load("two.sln", {"t": spark.range(2)})
    assert catalog.table("t").count() == 2 and catalog.activate("ONE") == "one.sln" and catalog.table("t").count() == 1
    with pytest.raises(errors.AmbiguousMatch):
        catalog.activate(".sln")
    with pytest.raises(errors.ProjectNotFound):
        catalog.activate("three")
    assert [tuple(r) for r in catalog.listing().collect()] == [("one.sln", True, 1, "ready", 0), ("two.sln", False, 1, "ready", 0)]
    catalog.unload("one.sln")
    assert catalog.active == "two.sln"


def test_tasks():
    tasks = snapshots.Tasks({"rebuild": lambda: 7, "fail": lambda: 1 / 0})
    ids = [tasks.start("rebuild"), tasks.start("fail")]
    for _ in range(100):
        if all(tasks.status(i)["status"] != "running" for i in ids):
            break
        time.sleep(0.05)
    assert tasks.status(ids[0])["result"] == 7 and tasks.status(ids[1])["status"] == "failed" and len(tasks.running()) == 2
    with pytest.raises(errors.InvalidArgument):
        tasks.start("other")
    with pytest.raises(errors.InvalidArgument):
        tasks.status("none")


def test_driver_queries_have_sql():
    assert set(driver_queries.QUERIES) == set(driver_queries.ORACLE_SQL) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_exception_flow(spark):
    calls = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src int, dst int")
    throws = spark.createDataFrame([(3, "A"), (4, "B"), (4, "C")], "node int, exception string")
    catches = spark.createDataFrame([(1, "A"), (3, "B"), (1, "B")], "node int, exception string")
    got = {(r.node, r.exception): (r.path, r.caught_by) for r in Q.exception_flow(calls, seed(spark, 1), throws, catches).collect()}
    assert got == {(3, "A"): ([1, 3], 1), (4, "B"): ([1, 3, 4], 3), (4, "C"): ([1, 3, 4], None)}


def test_data_flow(spark):
    rows = spark.createDataFrame([("f", "a", 1, True), ("f", "a", 5, False), ("f", "b", 5, True), ("f", "b", 6, False), ("f", "b", 9, False), ("f", "c", 9, True)], "scope string, var string, at int, writes boolean")
    got = {r["var"]: (r.flows_in, r.flows_out, r.used_outside) for r in Q.data_flow(rows, F.lit(4), F.lit(8)).collect()}
    assert got == {"a": (True, False, True), "b": (False, True, True)}


def test_rename_plan(spark):
    symbols = spark.createDataFrame([(1, "X", "T"), (2, "Y", "T"), (3, "Y", "U")], "target long, name string, container string")
    places = spark.createDataFrame([(1, 10, 1, "p"), (1, 10, 1, "p"), (2, 11, 1, "q")], "target long, file long, line int, col string")
    got = sorted((r.what, r.col) for r in Q.rename_plan(symbols, places, spark.createDataFrame([(1,)], "target long"), "Y").collect())
    assert got == [("conflict", "2"), ("edit", "p")]
    with pytest.raises(errors.InvalidArgument):
        Q.rename_plan(symbols, places, symbols.select("target"), " ")


def test_components_have_cycles_of_any_length(spark):
    rnd = random.Random(5)
    pairs = {(k, k % 9 + 1) for k in range(1, 10)} | {(9, 20), (20, 21), (21, 30), (40, 40), (50, 51), (51, 50), (50, 50), (51, 1)} | {(a, a + rnd.randint(1, 9)) for a in range(100, 120)}
    pairs |= {(rnd.randint(200, 230), rnd.randint(200, 230)) for _ in range(40)}
    reached = {a: {y for x, y in pairs if x == a} for a, _ in pairs}
    for _ in range(60):
        reached = {a: to.union(*(reached.get(b, set()) for b in to)) for a, to in reached.items()}
    want = {a: min(b for b in to if a in reached.get(b, ())) for a, to in reached.items() if a in to}
    got = [tuple(r) for r in graph.components(spark.createDataFrame(sorted(pairs), "src long, dst long")).select("node", "component").collect()]
    assert len(got) == len(want) and dict(got) == want
    assert [want[k] for k in (1, 9, 40, 51)] == [1, 1, 40, 50] and not {20, 21, 30} & set(want)
    assert graph.components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_requests_resolve_against_the_whole_table(spark, tmp_path):
    rows = [(1, "a", 1), (2, "a", 40), (3, "b", 2), (4, "c", 50), (5, None, 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.request: (r.status, r.n) for r in driver_queries.QUERIES["get_method_source"](spark, str(tmp_path)).collect()}
    assert got == {"a": ("ambiguous", 2), "b": ("ok", 1), "c": ("ok", 1), "no such part": ("notFound", 0)}
