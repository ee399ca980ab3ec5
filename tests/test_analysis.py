"""Data flow with branches and loops, type terms, kept closures, resolved frames, XML project files, cancelled tasks."""

import random
import time

import pytest
from pyspark.sql import functions as F

from factloom.functions.stack_trace import resolved_frames, top_level_count, trace_rows
from factloom.operators import closure as C
from factloom.operators import data_flow as D
from factloom.operators import graph
from factloom.operators import type_terms as T
from factloom.plans.snapshots import Tasks
from factloom.sources import project_xml


def brute_flow(edges, accesses, region, entry):
    """By walking every pair of one scope in plain Python."""
    out = {}
    succ = {}
    for s, a, b in edges:
        succ.setdefault((s, a), set()).add(b)
    use = {(s, n, v) for s, n, v, r, w in accesses if r}
    kill = {(s, n, v) for s, n, v, r, w in accesses if w}

    def arrivals(s, v, starts, inside=None):
        seen, todo = set(starts), list(starts)
        while todo:
            n = todo.pop()
            if (s, n, v) in kill:
                continue
            for m in succ.get((s, n), ()):
                if m not in seen and (inside is None or m in inside):
                    seen.add(m)
                    todo.append(m)
        return seen

    for s in {s for s, _ in region}:
        inside = {n for x, n in region if x == s}
        doors = {n for x, n in entry if x == s} & inside
        for v in {v for x, n, v, *_ in accesses if x == s and n in inside}:
            nodes = {n for x, n, w, *_ in accesses if x == s and w == v}
            after = lambda some: {m for n in some if (s, n, v) in kill for m in succ.get((s, n), ())}
            comes = arrivals(s, v, after(nodes - inside))
            goes = arrivals(s, v, after(nodes & inside))
            live = any((s, n, v) in use for n in arrivals(s, v, doors, inside)) if doors else False
            per_door = any(d in comes and any((s, n, v) in use for n in arrivals(s, v, {d}, inside)) for d in doors)
            assert len(doors) > 1 or per_door == (live and bool(doors & comes))
            leaving = {n for n in inside if not succ.get((s, n)) or any(m not in inside for m in succ[(s, n)])}
            bare = {n for n in arrivals(s, v, doors, inside) if (s, n, v) not in kill}
            written = any((s, n, v) in kill for n in inside)
            out[(s, v)] = (any((s, n, v) in use for n in inside), written, written and not (bare & leaving), per_door, any((s, n, v) in use for n in goes - inside), any((s, n, v) in use for n in nodes - inside), any((s, n, v) in kill for n in nodes - inside))
    return out


def test_region_flow_by_brute_force(spark):
    rnd = random.Random(11)
    edges, accesses, region, entry = [], [], [], []
    for s in range(25):
        n = rnd.randint(1, 12)
        edges += [(s, a, a + 1) for a in range(n - 1) if rnd.random() < 0.9] + [(s, rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(0, n))]
        accesses += [(s, a, "v%d" % rnd.randrange(4), rnd.random() < 0.5, rnd.random() < 0.5) for a in range(n) for _ in range(2)]
        low = rnd.randrange(n)
        region += [(s, a) for a in range(low, min(n, low + rnd.randint(1, 5)))]
        entry.append((s, low))
    merged = {}
    for s, a, v, r, w in accesses:
        x = merged.get((s, a, v), (False, False))
        merged[(s, a, v)] = (x[0] or r, x[1] or w)
    flat = [(*k, *x) for k, x in merged.items()]
    got = D.region_flow(
        spark.createDataFrame(edges + edges[:3] + [(None, 1, 2), (3, None, 1)], "scope int, src int, dst int"),
        spark.createDataFrame(accesses, "scope int, node int, var string, reads boolean, writes boolean"),
        spark.createDataFrame(region, "scope int, node int"),
        spark.createDataFrame(entry + [(99, 1)], "scope int, node int"),
    )
    assert {(r["scope"], r["var"]): tuple(r)[2:] for r in got.collect()} == brute_flow(edges, flat, region, entry)


def test_writes_that_lead_elsewhere_are_not_walked(spark, monkeypatch):
    met = []
    monkeypatch.setattr(D, "cut_and_count", lambda df, keep=D.cut_and_count: met.append(keep(df)) or met[-1])
    edges = [(1, a, a + 1) for a in range(120)]
    accesses = [(1, 2, "v", True, True)] + [(1, a, "v", False, True) for a in [0, *range(3, 120)]]
    got = D.region_flow(
        spark.createDataFrame(edges, "scope int, src int, dst int"),
        spark.createDataFrame(accesses, "scope int, node int, var string, reads boolean, writes boolean"),
        spark.createDataFrame([(1, 2)], "scope int, node int"),
        spark.createDataFrame([(1, 2)], "scope int, node int"),
    )
    assert [tuple(r) for r in got.collect()] == [(1, "v", True, True, True, True, False, False, True)]
    assert sum(n for _, n in met) < 40  # the 118 writes behind the region do not reach its entry


@pytest.mark.parametrize("whole,wide", [(30, 1), (200_000, 2)])
def test_scopes_of_any_size_flow_alike(spark, monkeypatch, whole, wide):
    monkeypatch.setattr(D, "WHOLE", whole)  # scopes of more rows are walked by frontiers
    monkeypatch.setattr(D, "WIDE", wide)
    monkeypatch.setattr(D, "OUT", 3)
    monkeypatch.setattr(D, "SMALL", 6)
    rnd = random.Random(12)
    edges, accesses, region, entry = [], {}, [], []
    for s in range(6):
        n = rnd.randint(2, 9)
        edges += [(s, a, a + 1) for a in range(n - 1)] + [(s, rnd.randrange(n), rnd.randrange(n)) for _ in range(3)]
        accesses |= {(s, a, f"v{v}"): (rnd.random() < 0.5, rnd.random() < 0.5) for a in range(n) for v in range(3) if rnd.random() < 0.7}
        region += [(s, a) for a in range(1, min(n, 5))]
        entry.append((s, 1))
    flat = [(*k, *x) for k, x in accesses.items()]
    got = D.region_flow(
        spark.createDataFrame(edges, "scope long, src int, dst int"),
        spark.createDataFrame([*flat, (None, 1, "v1", True, True), (0, 1, None, True, True), (7, 1, "v1", None, None)], "scope int, node int, var string, reads boolean, writes boolean"),
        spark.createDataFrame([*region, (None, 1), (2, None)], "scope int, node int"),
        spark.createDataFrame([*entry, (3, 99), (None, 1)], "scope int, node int"),
    )
    assert got.schema["scope"].dataType.simpleString() == "int"
    assert {(r["scope"], r["var"]): tuple(r)[2:] for r in got.collect()} == brute_flow(edges, flat, region, entry)


def test_a_long_flow_sends_nothing_to_the_driver(spark, monkeypatch):
    tables = []
    for name in ("cut", "cut_and_count"):
        monkeypatch.setattr(D, name, lambda df, keep=getattr(D, name): tables.append(df) or keep(df))
    edges = [(s, a, a + 1) for s in range(3) for a in range(30)]
    got = D.region_flow(
        spark.createDataFrame(edges, "scope int, src int, dst int"),
        spark.createDataFrame([(s, a, "v", a == 30, a == 1) for s in range(3) for a in (1, 30)], "scope int, node int, var string, reads boolean, writes boolean"),
        spark.createDataFrame([(s, 1) for s in range(3)], "scope int, node int"),
        spark.createDataFrame([(s, 1) for s in range(3)], "scope int, node int"),
    )
    assert sorted(map(tuple, got.collect())) == [(s, "v", False, True, True, False, True, True, False) for s in range(3)]
    assert len(tables) == 2  # the facts, and the scopes too large for a task: no frontiers, however long the way
    assert not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in [got, *tables])


@pytest.mark.parametrize(
    "text,want",
    [
        ("int", ":int/0"),
        ("List<?T>", ":List/1 .0:?T/0"),
        ("Map<string, List<?T>>", ":Map/2 .0:string/0 .1:List/1 .1.0:?T/0"),
        ("A.B<C[], D?>", ":A.B/2 .0:[]/1 .0.0:C/0 .1:?/1 .1.0:D/0"),
        ("List<int>[]?", ":?/1 .0:[]/1 .0.0:List/1 .0.0.0:int/0"),
        ("F<a,b,c,d,e,f,g,h,i,j,k[]>", ":F/11 .0:a/0 .1:b/0 .10:[]/1 .10.0:k/0 .2:c/0 .3:d/0 .4:e/0 .5:f/0 .6:g/0 .7:h/0 .8:i/0 .9:j/0"),
        ("List<int", None),
        ("int>", None),
        ("int int", None),
        ("", None),
        (None, None),
    ],
)
def test_parsed(terms, text, want):
    assert terms[text] == want


@pytest.fixture(scope="module")
def terms(spark):
    texts = ["int", "List<?T>", "Map<string, List<?T>>", "A.B<C[], D?>", "List<int>[]?", "F<a,b,c,d,e,f,g,h,i,j,k[]>", "List<int", "int>", "int int", "", None]
    shown = F.array_join(F.transform("term", lambda n: F.concat(n["path"], F.lit(":"), n["name"], F.lit("/"), n["arity"].cast("string"))), " ")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("term", T.parsed(F.col("text")))
    return {r["text"]: r["shown"] for r in rows.select("text", shown.alias("shown")).collect()}


def test_matches_and_substitutes(spark):
    cases = [
        ("?T", "List<int>", True, "Seq<?T>", "Seq<List<int>>"),
        ("List<?T>", "List<Map<a, b>>", True, "Seq<Pair<?T, ?T>>", "Seq<Pair<Map<a, b>, Map<a, b>>>"),
        ("Map<?K, ?K>", "Map<a, a>", True, "?K", "a"),
        ("Map<?K, ?K>", "Map<a, b>", False, None, None),
        ("Map<?K, List<?K>>", "Map<List<a>, List<List<a>>>", True, "?K", "List<a>"),
        ("List<?T>", "List", False, None, None),
        ("List", "List<a>", False, None, None),
        ("Map<a, ?V>", "Map<b, c>", False, None, None),
        ("Map<a, ?V>", "Map<a, c[]>", True, "Map<?V, ?U>", "Map<c[], ?U>"),
    ]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, pattern string, term string, fits boolean, base string, want string")
    for c in ("pattern", "term", "base", "want"):
        rows = rows.withColumn(c, T.parsed(F.col(c)))
    got = rows.select("k", "fits", T.matches(F.col("pattern"), F.col("term")).alias("m"), T.written(T.substituted(F.col("base"), T.bindings(F.col("pattern"), F.col("term")))).alias("s"), T.written(F.col("want")).alias("w")).orderBy("k").collect()
    assert [r["m"] for r in got] == [r["fits"] for r in got]
    assert all(r["s"] == r["w"] for r in got if r["fits"])


def test_extension_methods(spark):
    parse = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    types = parse([("List<Cat>",), ("Map<Cat, Cat>",), ("Map<Cat, Dog>",), ("Cat",), ("bad<",)], ["type"]).withColumn("term", T.parsed(F.col("type")))
    rules = parse([("List<?T>", "Seq<?T>"), ("Map<?K, ?V>", "Seq<Pair<?K, ?V>>"), ("Cat", "Animal"), ("Dog", "Animal"), ("Animal", "Any"), ("Any", "Any")], ["of", "base"]).select(T.parsed(F.col("of")).alias("of"), T.parsed(F.col("base")).alias("base"))
    methods = parse([("each", "Seq<?T>"), ("same", "Map<?K, ?K>"), ("feed", "Animal"), ("any", "?T"), ("tame", "?T"), ("broken", "Seq<")], ["method", "receiver"]).select("method", T.parsed(F.col("receiver")).alias("receiver"))
    bounds = parse([("tame", "?T", "Animal"), ("each", "?T", "Animal")], ["method", "name", "bound"]).withColumn("bound", T.parsed(F.col("bound")))
    got = {(r["type"], r["method"]): (r["distance"], r["arguments"]) for r in T.extension_methods(types, rules, methods, bounds).collect()}
    assert got == {
        ("List<Cat>", "each"): (1, "?T=:Cat"),
        ("List<Cat>", "any"): (0, "?T=:List .0:Cat"),
        ("Map<Cat, Cat>", "same"): (0, "?K=:Cat"),  # a pair is no animal, so each does not fit
        ("Map<Cat, Cat>", "any"): (0, "?T=:Map .0:Cat .1:Cat"),
        ("Map<Cat, Dog>", "any"): (0, "?T=:Map .0:Cat .1:Dog"),
        ("Cat", "feed"): (1, ""),
        ("Cat", "any"): (0, "?T=:Cat"),
        ("Cat", "tame"): (0, "?T=:Cat"),
    }
    with pytest.raises(ValueError, match="go on"):
        T.base_terms(types, parse([("Cat", "List<Cat>"), ("List<?T>", "List<List<?T>>")], ["of", "base"]).select(T.parsed(F.col("of")).alias("of"), T.parsed(F.col("base")).alias("base")), 4)


def test_maintained_closure_by_recomputation(spark):
    rnd = random.Random(4)
    make = lambda rows: spark.createDataFrame(sorted(rows), "src int, dst int")
    for _ in range(4):
        n = rnd.randint(3, 14)
        edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(2 * n)}
        removed = {e for e in edges if rnd.random() < 0.3} | {(90, 91)}
        added = {(rnd.randrange(n + 3), rnd.randrange(n + 3)) for _ in range(5)} | set(rnd.sample(sorted(edges), 2))
        before = make(edges)
        got = C.maintain(C.closure(before), before, make(added), make(removed))
        want = C.closure(make((edges - removed) | added))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    empty = make([])
    one = make([(1, 2)])
    assert C.maintain(C.closure(empty), empty, one, empty).collect() == [(1, 2)]
    assert C.maintain(C.closure(one), one, empty, one).collect() == []
    assert C.maintain(C.closure(one), one, empty, empty).collect() == [(1, 2)]


def test_bounded_walks_are_one_plan(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (3, 1), (1, 1), (None, 1)], "src int, dst int")
    seeds = spark.createDataFrame([(1,), (1,)], "node int")
    assert sorted(map(tuple, graph.reach(edges, seeds, 3).collect())) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert sorted(map(tuple, graph.reach(edges, seeds, 5).collect())) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)]  # by written steps
    assert sorted(map(tuple, graph.reach(edges, seeds, 0).collect())) == [(1, 0)]
    assert "cut-" not in graph.reach(edges, seeds, 3)._jdf.queryExecution().toString()


def test_top_level_count_however_deep(spark):
    deep = "Map`2[" * 9 + "A,B" + "]" * 9 + " x, (A, B) y"
    rows = spark.createDataFrame([(deep,), ("",), (None,), ("A a",), ("A<B,C<D,E>> a, F f",), ("], A",)], "p string")
    assert [r[0] for r in rows.select(top_level_count(F.col("p"))).collect()] == [2, 0, 0, 1, 2, 2]


def test_lines_are_matched_once(spark):
    text = "   at A.B.Go(Int32 a, List`1[A,B] b) in /s/x.cs:line 7\n   at A.B\0.Go(Int32 a) in /s/y.cs:line 8\n   at A.B..ctor()\n   at A.Plain(]a, (b, [c]))\nA.BException: no\nno\0thing"
    rows = trace_rows(spark.createDataFrame([(1, text)], "trace_id int, text string"))
    assert [tuple(r)[2:] for r in rows.orderBy("position").collect()] == [
        ("frame", "A.B.Go", "method", 2, "/s/x.cs", 7),
        ("frame", "A.B\0.Go", "method", 1, "/s/y.cs", 8),
        ("frame", "A.B.B", "constructor", 0, None, None),
        ("frame", "A.Plain", "method", 2, None, None),
        ("exception", "A.BException", None, None, None, None),
        ("unknown", None, None, None, None, None),
    ]
    # parts are cut out by one replacement; a match for each part is left to lines with a NUL
    assert "regexp_replace" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_resolved_frames(spark):
    text = "System.Exception: x\n   at A.B.Go(Int32 a)\n   at A.B.Go()\n   at A.B.Go(Int32 a, Int32 b) in /s/x.cs:line 7\n   at A.B.<RunAsync>d__1.MoveNext()\n   at Lib.Far()\n   at No.Where()\n nonsense"
    symbols = spark.createDataFrame(
        [("A.B.Go", 1, "go1", True, "b.cs", 10), ("A.B.Go", 0, "go0", True, "b.cs", 5), ("A.B.Go", 2, "lib2", False, None, None), ("A.B.RunAsync", 3, "run", True, "b.cs", 20), ("Lib.Far", 0, "far", False, None, None), ("Lib.Far", 0, "far", False, None, None), (None, 0, "none", True, "c.cs", 1)],
        "name string, parameters int, member string, source boolean, file string, line int",
    )
    frames = trace_rows(spark.createDataFrame([(1, text)], "trace_id int, text string"))
    got = [(r["member"], r["status"], r["file"], r["line"]) for r in resolved_frames(frames, symbols).orderBy("position").collect()]
    assert got == [
        ("go1", "source", "b.cs", 10),
        ("go0", "source", "b.cs", 5),
        ("go0", "source", "/s/x.cs", 7),  # source before the overload that fits; the trace's own place wins
        ("run", "source", "b.cs", 20),
        ("far", "metadata", None, None),
        (None, "unresolved", None, None),
    ]


def test_lines_are_worked_out_once_for_all_that_is_asked(spark):
    traces = spark.createDataFrame([(1, "   at A.B.Go(Int32 a)")], "trace_id int, text string")
    symbols = spark.createDataFrame([("A.B.Go", 1, "go1", True, "b.cs", 10)], "name string, parameters int, member string, source boolean, file string, line int")
    got = resolved_frames(trace_rows(traces), symbols)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert not any("regexp_replace" in line for line in plan.splitlines() if "Filter" in line)
    assert [r["member"] for r in got.collect()] == ["go1"]


def test_overloads_by_brute_force(spark):
    rnd = random.Random(6)
    pick = lambda *of: rnd.choice(of)
    symbols = [(pick("a", "b", "c", None), pick(None, 0, 1, 2), rnd.randrange(5), pick(True, False, None), pick("x", "y", None), pick(1, 2, None)) for _ in range(25)]
    asked = [(t, 0, "frame", pick("a", "b", "c", "d", None), pick(None, 0, 1, 2, 3), "method", pick(None, "own"), pick(None, 9)) for t in range(60)]

    def best(name, n):
        least = lambda x: tuple((v is not None, v) for v in x)
        return min((s for s in symbols if s[0] is not None and s[0] == name), key=lambda s: (not s[3], s[1] != n, least((s[4], s[5], s[2], bool(s[3])))), default=(None,) * 6)

    want = []
    for t, _, _, name, n, _, file, line in asked:
        s = best(name, n)
        want.append((t, s[2], "unresolved" if s[0] is None else "source" if s[3] else "metadata", file or s[4], line or s[5]))
    frames = spark.createDataFrame(asked, "trace_id int, position int, kind string, symbol string, parameters int, origin string, file string, line int")
    got = resolved_frames(frames, spark.createDataFrame(symbols, "name string, parameters int, member int, source boolean, file string, line int"))
    assert [(r["trace_id"], r["member"], r["status"], r["file"], r["line"]) for r in got.orderBy("trace_id").collect()] == want


def test_project_xml(spark, tmp_path):
    files = {
        "a/A.csproj": '﻿<?xml version="1.0"?>\n<Project Sdk="S">\n<!-- <PackageReference Include="no" Version="1"/> -->\n<PropertyGroup><X>1</X></PropertyGroup><ItemGroup>\n<PackageReference Include="P" Version="1.2" />\n<PackageReference Include=\'Q\'><Version> 3 </Version></PackageReference></ItemGroup><ItemGroup Condition="c"><PackageReference Include="R"/><PackageReference Update="S" Version="1"/><ProjectReference Include="..\\b\\B.csproj" /></ItemGroup></Project>',
        "b/B.csproj": '<Project Sdk="S"><ItemGroup><PackageReference Include="T" Version="1" /></ItemGroup></Project>',
        "c/C.csproj": '<Project Sdk="S"><ItemGroup><PackageReference Include="U" Version="1" />',
        "d/D.csproj": '<Project Sdk="S"><ItemGroup><PackageReference Include="V" Version="1"></Wrong></ItemGroup></Project>',
        "e/E.csproj": " ",
        "f/F.csproj": "<Project/>",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = sorted((r["path"][-10:], r["name"], r["version"]) for r in project_xml.packages(spark, str(tmp_path)).collect())
    assert got == [("a/A.csproj", "P", "1.2"), ("a/A.csproj", "Q", "3"), ("a/A.csproj", "R", "*"), ("b/B.csproj", "T", "1")]
    assert [(r["src"][-10:], r["dst"][-10:]) for r in project_xml.references(spark, str(tmp_path)).collect()] == [("a/A.csproj", "b/B.csproj")]
    assert sorted(r["path"][-10:] for r in project_xml.broken(spark, str(tmp_path)).collect()) == ["c/C.csproj", "d/D.csproj", "e/E.csproj"]


def test_a_running_task_is_cancelled(spark):
    def slow():
        nap = F.udf(lambda x: time.sleep(1) or x, "long")
        return spark.range(0, 120, numPartitions=2).select(F.sum(nap("id"))).collect()

    tasks = Tasks({"slow": slow, "quick": lambda: spark.range(5).count()}, spark=spark)
    task, other = tasks.start("slow"), tasks.start("quick")
    for _ in range(200):
        if tasks.jobs(task) and tasks.status(other)["ended"]:
            break
        time.sleep(0.1)
    assert "RUNNING" in tasks.jobs(task).values() and tasks.status(task)["status"] == "running"
    assert tasks.status(other)["result"] == 5 and set(tasks.jobs(other)).isdisjoint(tasks.jobs(task))
    tasks.cancel(task)
    for _ in range(200):
        if tasks.status(task)["ended"]:
            break
        time.sleep(0.1)
    assert tasks.status(task)["status"] == "cancelled" and "RUNNING" not in tasks.jobs(task).values()
    tasks.cancel(task)
    assert spark.range(3).count() == 3  # the session goes on
