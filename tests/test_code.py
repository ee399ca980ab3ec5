"""The C# extractor, the query tools over its facts, project files and traces, on small literal texts."""

import pytest
from pyspark.sql import functions as F

from factloom import errors
from factloom.functions.stack_trace import demangle, trace_rows
from factloom.operators import code_tools as T
from factloom.sources import csharp, solution

MONEY = """
using System;
namespace Shop.Core;
/// <see cref="Money"/>
public delegate void Changed<T>(object sender, T args);
[Serializable, Obsolete("x", true)]
public sealed record Money(decimal Amount, string Code = "EUR") : Base<Money>(Amount), IComparable<Money> where T : Somewhere
{
    public const int Max = 3;
    private readonly List<int> _items, _others = new();
    public event EventHandler<int> Sold;
    public static Money operator +(Money a, Money b) => new Money(a.Amount + b.Amount);
    public static bool operator ==(Money a, Money b) { return a.Equals(b); }
    public static implicit operator decimal(Money m) => m.Amount;
    public static explicit operator checked int(Money m) => (int)m.Amount;
    public int this[int i, string k] { get { return i > 0 ? 1 : 2; } set { } }
    ~Money() { Close(); }
    public Money(int a) : this(a, "x") { _items = new List<int>(); }
}
public class Somewhere2 : Somewhere { }
"""

SHOP = """
namespace Shop.Web;
internal class Hidden { public class Inner { public void Out() { } } }
public interface Payment { void Pay(); }
public class Store : IDisposable, Payment
{
    private int count;
    public int total { get; set; }
    public event EventHandler Opened;
    public Store() { }
    public Store(Clock clock, int Size) { }
    protected virtual void Pay() { throw new Core.PayException("x"); }
    public static Store Make() => new Store();
    public async Task RunAsync() { await Task.Delay(1); RunAsync(); Save(out count); Save(ref count); }
    public void Go(object o)
    {
        var a = new Store(); using var b = new Store(); var c = new Store(); var d = new Store();
        c.Dispose(); Keep(d); new Store(); RunAsync();
        Opened += OnOpened; Opened -= (s, e) => Go(o);
        var x = nameof(Store.Make); var y = typeof(Store); if (o is Store z) { count++; count = 2; }
        var w = (Store)o; List<Store> many = null; Action f = Go; var r = RunAsync().Result;
        try { Run(); } catch (Core.PayException e) when (e.Ok) { throw; } catch (Exception e) { throw e; } catch { }
        services.AddSingleton<Payment, Store>(); services.TryAddScoped<Store>(p => new Store()); services.AddTransient<Clock>();
        Activator.CreateInstance(y); typeof(Store).GetProperty("total"); other.Invoke();
    }
}
public class SubStore : Store { protected override void Pay() { base.Pay(); } }
public static class More { public static int Twice(this Store s, int n) => n; public static T Any<T>(this T t) => t; }
namespace Core2 { public class PayException : Exception { } }
"""

TESTS = """
using Xunit;
public class StoreTests
{
    [Fact] public void A() { new Store().Go(null); }
    [Theory] [InlineData(1)] [InlineData(2)] public void B(int n) { Store.Make(); }
    [Test] public void C() { }
    public async void Wrong() { }
    public async void Click(object s, EventArgs e) { }
}
"""


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([("Money.cs", "core", MONEY), ("Shop.cs", "web", SHOP), ("Tests.cs", "tests", TESTS), ("Null.cs", "web", None)], "file string, project string, text string")
    return csharp.facts(files).cache()


def ask(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "request string")


def test_declarations():
    rows = csharp.extract(MONEY)
    members = {(r[1], r[7]) for r in rows if r[0] == "member"}
    assert members == {("Max", "constant"), ("_items", "field"), ("_others", "field"), ("Sold", "event"), ("operator +", "operator"), ("operator ==", "operator"), ("implicit", "conversion"), ("explicit", "conversion"), ("this[]", "indexer"), ("~Money", "destructor"), ("Money", "constructor")}
    assert [(r[1], r[7]) for r in rows if r[0] == "type"] == [("Changed", "delegate"), ("Money", "record"), ("Somewhere2", "class")]
    assert [r[1] for r in rows if r[0] == "base"] == ["Base<Money>", "IComparable<Money>", "Somewhere"]
    assert [(r[1], r[8], r[13], r[14]) for r in rows if r[0] == "param" and r[3] == "Shop.Core.Money.Money"][:2] == [("Amount", 0, "decimal", ""), ("Code", 1, "string", '"EUR"')]
    assert ("Somewhere", "type_constraint") in {(r[1], r[7]) for r in rows if r[0] == "ref"} and ("Money", "xml_doc") in {(r[1], r[7]) for r in rows if r[0] == "ref"}
    for text in ("", "class", "class A {", "class A { operator", "class A { this[", "delegate", "class A { ~", "class A { event", "record R(", "class A<", "a<b<", "class A { public static implicit operator", "class A { void M() { x += ", "class A { int P { get {"):
        csharp.extract(text)


def test_throws_and_catches(spark, facts):
    thrown = sorted((r.exception, r.line) for r in T.throw_sites(facts, "Core.PayException").collect())
    assert [x for x, _ in thrown] == ["Core.PayException", "Core.PayException"] and len({n for _, n in thrown}) == 2
    assert [r.exception for r in T.throw_sites(facts, "Exception", derived=True).orderBy("line", "col").collect()] == ["Core.PayException", "Core.PayException", "Exception"]
    got = [(r.exception, r.has_filter, r.rethrows, r.is_empty) for r in T.catch_blocks(facts, "PayException", bases=True).collect()]
    assert sorted(got) == [("(bare catch)", False, False, True), ("Core.PayException", True, True, False), ("Exception", False, False, False)]
    assert T.catch_blocks(facts, "OtherException").count() == 0


def test_resolve(spark, facts):
    got = {(r.request, r.id) for r in T.resolve(facts, ask(spark, "Store", "Shop.Web.Store", "Store.go", "Go", "store", "Changed<int>", "nothing")).collect()}
    assert got == {("Store", "Shop.Web.Store"), ("Shop.Web.Store", "Shop.Web.Store"), ("Store.go", "Shop.Web.Store.Go(object)"), ("Go", "Shop.Web.Store.Go(object)"), ("store", "Shop.Web.Store.Store()"), ("store", "Shop.Web.Store.Store(Clock, int)"), ("Changed<int>", "Shop.Core.Changed")}
    with pytest.raises(errors.SymbolNotFound):
        T.resolve(facts, ask(spark, "Store", "nothing"), required=True)
    assert {r.line for r in T.definitions(facts, ask(spark, "Store")).collect()} == {5}


def test_reference_kinds(spark, facts):
    kinds = {(r.kind, r.enclosing.rpartition(".")[2]) for r in T.references(facts, ask(spark, "Store")).collect()}
    assert {("nameof", "Go"), ("typeof", "Go"), ("type_check", "Go"), ("cast", "Go"), ("object_creation", "Go"), ("type_argument", "Go"), ("base_type", "SubStore"), ("declaration", "Make"), ("declaration", "Twice")} <= kinds
    assert {r.kind for r in T.references(facts, ask(spark, "Store.count")).collect()} == {"write", "readwrite"}
    assert "method_group" in {r.kind for r in T.references(facts, ask(spark, "Store.Go")).collect()}
    assert {r.kind for r in T.references(facts, ask(spark, "Store"), ["CAST", "nameof"]).collect()} == {"cast", "nameof"}
    with pytest.raises(errors.InvalidArgument):
        T.references(facts, ask(spark, "Store"), ["nope"])
    assert T.references(facts, ask(spark, "Hidden")).count() == 0


def test_hierarchy_and_callers(spark, facts):
    assert sorted((r.type, r.depth) for r in T.implementations(facts, ask(spark, "Payment")).collect()) == [("Shop.Web.Store", 1), ("Shop.Web.SubStore", 2)]
    got = {(r.relation, r.type) for r in T.type_hierarchy(facts, ask(spark, "Store")).collect()}
    assert got == {("base", "IDisposable"), ("base", "Shop.Web.Payment"), ("derived", "Shop.Web.SubStore")}
    assert {r.caller for r in T.callers(facts, ask(spark, "Store.Go")).collect()} == {"StoreTests.A", "Shop.Web.Store.Go"}
    assert ("StoreTests.A", "Shop.Web.Store.Go") in {tuple(r) for r in T.call_edges(facts).collect()}


def test_types_at_a_glance(spark, facts):
    (r,) = T.symbol_context(facts, ask(spark, "Store")).collect()
    assert (r.bases, r.injected, r.members) == (["IDisposable", "Payment"], ["Clock", "int"], ["Go", "Make", "Opened", "RunAsync", "total"])
    assert [(x.place, x.signature, x.n_params) for x in T.overloads(facts, ask(spark, "Store.Store")).orderBy("place").collect()] == [(1, "Shop.Web.Store.Store()", 0), (2, "Shop.Web.Store.Store(Clock, int)", 2)]
    ops = {(x.token, x.kind, x.arity, x.checked, x.result) for x in T.operators_of(facts, ask(spark, "Money")).collect()}
    assert ops == {("+", "operator", 2, False, "Money"), ("==", "operator", 2, False, "bool"), ("implicit", "conversion", 1, False, "decimal"), ("explicit", "conversion", 1, True, "int")}
    assert {(x.how, x.member, x.params) for x in T.instantiation_options(facts, ask(spark, "Store", "SubStore")).collect()} == {("constructor", "Shop.Web.Store.Store", ""), ("constructor", "Shop.Web.Store.Store", "Clock, int"), ("factory", "Shop.Web.Store.Make", ""), ("constructor", "Shop.Web.SubStore.SubStore", "")}
    assert sorted((x.method, x.distance) for x in T.extension_methods(facts, "SubStore").collect()) == [("Shop.Web.More.Any", None), ("Shop.Web.More.Twice", 1)]
    assert T.file_overview(facts, "Tests.cs").count() == 6


def test_public_api(spark, facts):
    got = {(r.kind, r.name, r.access) for r in T.public_api(facts).where("project = 'web'").collect()}
    assert ("method", "Shop.Web.Store.Pay", "protected") in got and ("method", "Shop.Web.Payment.Pay", "public") in got and ("property", "Shop.Web.Store.total", "public") in got
    assert not any("Hidden" in n or n.endswith("count") for _, n, _ in got)


def test_events_attributes(spark, facts):
    got = sorted((r.subscribes, r.handler) for r in T.event_subscribers(facts, ask(spark, "Store.Opened")).collect())
    assert got == [(False, "<lambda at 19>"), (True, "OnOpened")]
    assert T.event_subscribers(facts, ask(spark, "Store.Go")).count() == 0
    assert [(r.target, r.arguments) for r in T.attribute_usages(facts, "obsoleteAttribute").collect()] == [("Shop.Core.Money", '"x" , true')]


def test_rules(spark, facts):
    got = sorted((r.pattern, r.severity, r.member.rpartition(".")[2]) for r in T.async_violations(facts).collect())
    assert got == [("AsyncVoid", "Error", "Wrong"), ("FireAndForget", "Warning", "Go"), ("MissingAwait", "Warning", "RunAsync"), ("SyncOverAsyncResult", "Error", "Go")]
    assert T.async_violations(facts, spark.createDataFrame([("tests",)], "project string")).where("pattern = 'AsyncVoid'").count() == 0
    assert sorted((r.pattern, r.name) for r in T.disposable_misuse(facts).collect()) == [("BareCreation", "Store"), ("LocalNotDisposed", "a")]
    assert sorted((r.service, r.implementation, r.lifetime) for r in T.di_registrations(facts).collect()) == [("Clock", "Clock", "Transient"), ("Payment", "Store", "Singleton"), ("Store", "(factory)", "Scoped")]
    assert T.di_registrations(facts, "Store").count() == 2
    assert sorted((r.kind, r.target) for r in T.reflection_usage(facts).collect()) == [("instantiation", "Activator.CreateInstance"), ("member_lookup", "typeof(Store).GetProperty")]
    names = {(r.rule, r.name.rpartition(".")[2], r.suggestion) for r in T.naming_violations(facts).collect()}
    assert names == {("InterfacePrefix", "Payment", "IPayment"), ("PrivateFieldUnderscore", "count", "_count"), ("PropertyPascalCase", "total", "Total"), ("ParameterCamelCase", "Size", "size")}


def test_tests_and_scores(spark, facts):
    got = sorted((r.project, r.framework, r.attribute, r.n_tests, r.n_rows, r.symbols) for r in T.test_summary(facts).collect())
    assert got == [("tests", "NUnit", "Test", 1, 0, 0), ("tests", "XUnit", "Fact", 1, 0, 1), ("tests", "XUnit", "Theory", 1, 2, 1)]
    assert T.majority_framework(facts).first().framework == "XUnit" and T.majority_framework(facts.limit(0)).first().framework == "XUnit"
    assert {r.member for r in T.complexity_metrics(facts, 3).collect()} == {"Shop.Web.Store.Go"}
    assert T.complexity_summary(facts.limit(0)).first().highest == 0 and T.complexity_summary(facts, 3).first().over_threshold == 1
    with pytest.raises(errors.InvalidArgument):
        T.complexity_metrics(facts, 3, "other")


def test_change_signature(spark, facts):
    rows = T.change_signature(facts, ask(spark, "More.Twice"), ["n", "s", ("log", "bool", "false")]).collect()
    assert [(r.what, r.before, r.after) for r in rows] == [("declaration", "this Store s, int n", "int n, this Store s, bool log")]
    rows = T.change_signature(facts, ask(spark, "Store.Go"), [("x", "int", "0")]).collect()
    assert {(r.what, r.before, r.after) for r in rows} == {("declaration", "object o", "int x"), ("call", "0", "0")}
    for wrong in (["n", "n"], ["nope"]):
        with pytest.raises(errors.InvalidArgument):
            T.change_signature(facts, ask(spark, "More.Twice"), wrong)


def test_skeletons(spark, facts):
    (r,) = T.test_skeletons(facts, ask(spark, "Store")).collect()
    assert r.class_name == "StoreTests" and "_sut = new Store();" in r.text and "[Fact]\n    public void Pay_ThrowsPayException()" in r.text and "Go_Works" in r.text
    (r,) = T.test_skeletons(facts, ask(spark, "SubStore"), "NUnit").collect()
    assert "[Test]" in r.text and "new SubStore()" in r.text
    with pytest.raises(errors.InvalidArgument):
        T.test_skeletons(facts, ask(spark, "Store"), "Other")


def test_scan(spark):
    rows = [("a.cs", "p", "class A {}"), ("a.cs", "o", "class A {}"), ("b.g.cs", "p", ""), ("c.cs", "p", "// <auto-generated/>"), ("/x/obj/d.cs", "q", None)]
    files = spark.createDataFrame(rows, "file string, project string, text string")
    assert sorted((r.file, r.project) for r in csharp.scan_files(files).collect()) == [("/x/obj/d.cs", "q"), ("a.cs", "o")]
    assert [(r.file, r.project) for r in csharp.scan_files(files, "P").collect()] == [("a.cs", "p")]
    assert csharp.scan_files(files, generated=True).count() == 4
    bare = spark.createDataFrame([("", "p", "class A {}"), (None, "o", "class A {}"), ("", "p", "class B {}")], "file string, project string, text string")
    assert sorted((len(r.file), r.project) for r in csharp.scan_files(bare).collect()) == [(64, "o"), (64, "p")]
    assert [r.file for r in files.where(csharp.is_build_output(F.col("file"))).collect()] == ["/x/obj/d.cs"]


def test_projects(spark, tmp_path):
    good = '<Project Sdk="X"><!-- <PackageReference Include="Old"/> --><PackageReference Include=\'A\' Version=\'1\' /><PackageReference Update="B" /><PackageReference Include="xunit"><Version>2</Version></PackageReference></Project>'
    old = '<Project xmlns="http://schemas.microsoft.com/developer/msbuild/2003"></Project>'
    rows = spark.createDataFrame([("a", good), ("b", good[:-5]), ("c", None), ("d", old)], "path string, text string")
    assert sorted(tuple(r) for r in solution.packages(rows).collect()) == [("a", "A", "1"), ("a", "xunit", "2")]
    assert sorted(tuple(r) for r in solution.project_table(rows).collect()) == [("a", "SdkStyle", True), ("b", "Unknown", True), ("c", "Missing", False), ("d", "Legacy", False)]
    (tmp_path / "x/y").mkdir(parents=True)
    for name in ("Longer.sln", "B.sln", "A.slnx"):
        (tmp_path / name).write_text("")
    assert solution.find_solution(str(tmp_path / "x/y")) == str(tmp_path / "B.sln")
    with pytest.raises(errors.FileNotFound):
        solution.require_file(str(tmp_path / "none"))
    loaded, skipped = solution.ingest(["a", "b"], lambda p: p if p == "a" else 1 / 0)
    assert loaded == ["a"] and skipped == [("b", "division by zero")]
    markup = spark.createDataFrame([("Web/Pages/Home.razor",), ("Web/Other.cshtml",), ("Web/x.txt",)], "path string")
    made = spark.createDataFrame([("obj/Pages_Home_razor.g.cs",), ("obj/Home_razor.g.cs",), ("obj/Z.g.cs",)], "path string")
    assert [tuple(r) for r in solution.markup_map(markup, made).collect()] == [("Web/Pages/Home.razor", "obj/Pages_Home_razor.g.cs")]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Demo.Store+<RunAsync>d__12.MoveNext", ("Demo.Store.RunAsync", "stateMachine")),
        ("Demo.Store+<>c.<Run>b__5_0", ("Demo.Store.Run", "lambda")),
        ("Demo.Store+<>c__DisplayClass5_0.<Run>b__1", ("Demo.Store.Run", "lambda")),
        ("Demo.Store.<Run>g__Check|5_0", ("Demo.Store.Run.Check", "localFunction")),
        ("App.<>c__DisplayClass10_0.<Run>g__Boom|1", ("App.Run.Boom", "localFunction")),
        ("App.<>c.<<Run>b__8_0>d.MoveNext", ("App.Run", "lambda")),
        ("App.Svc.<<Run>g__Boom|0_0>d.MoveNext", ("App.Svc.Run.Boom", "localFunction")),
        ("Demo.Repository`1+Enumerator.MoveNext", ("Demo.Repository.Enumerator.MoveNext", "method")),
        ("Demo.Box`1[System.Tuple`2[A,B[]]].Open", ("Demo.Box.Open", "method")),
        ("Demo.Store..ctor", ("Demo.Store.Store", "constructor")),
    ],
)
def test_demangle(name, want):
    assert demangle(name) == want


def test_trace_lines(spark):
    text = "2026-07-19 06:12 [ERR]    at Demo.Store.Run(Func`2<Int32, String> f, (Int32, Int32) p)\nERROR: disk\n   at Program.Main() + 0x1b\n[ERR] System.IOException: x\nTimeoutException"
    got = [(r.kind, r.symbol, r.parameters) for r in trace_rows(spark.createDataFrame([(1, text)], "trace_id int, text string")).orderBy("position").collect()]
    assert got == [("frame", "Demo.Store.Run", 2), ("unknown", None, None), ("frame", "Program.Main", 0), ("exception", "System.IOException", None), ("exception", "TimeoutException", None)]


def test_tools_by_name(spark, facts):
    import json

    from factloom.plans import tools

    out = tools.run("find_naming_violations", facts, limit=2)
    text = json.loads(tools.to_json(out).first().json)
    assert text["totalCount"] == 4 and text["truncated"] and text["limit"] == 2 and [x["rule"] for x in text["items"]] == ["InterfacePrefix", "ParameterCamelCase"]
    assert text["summary"] == {"byRule": {"InterfacePrefix": 1, "ParameterCamelCase": 1, "PrivateFieldUnderscore": 1, "PropertyPascalCase": 1}}
    out = tools.run("find_async_violations", facts)
    assert [r.severity for r in out.items.collect()] == ["Error", "Error", "Warning", "Warning"] and not out.meta.first().truncated
    assert json.loads(tools.to_json(tools.run("get_overloads", facts, ask(spark, "nothing"))).first().json) == {"items": [], "totalCount": 0, "truncated": False, "limit": 2**31 - 1, "summary": {}}
    for wrong in (("nope", {}), ("find_naming_violations", {"limit": -1})):
        with pytest.raises(errors.InvalidArgument):
            tools.run(wrong[0], facts, **wrong[1])


DEAD = """
public class Used { public void Call() { Other(); } public void Other() { } public void Alone() { } [McpServerTool] public void Tool() { } internal void Quiet() { } public override string ToString() => ""; }
public class Gone { public void Inside() { } }
public class Tests { [Fact] public void T() { var u = new Used(); u.Call(); } public void Helper() { } }
public class MoreTests : Tests { public void Extra() { } }
[StructLayout(1)] public struct Raw { public int Handle; }
public interface IThing { void Do(); }
public class Thing : IThing { public void Do() { } }
[Obsolete("use Used", true)] public class Old { }
public class User { Old old; Old other; Thing t; Raw r; }
public class Program { public static void Main() { new User(); new MoreTests(); } }
"""


def test_unused_and_obsolete(spark):
    facts = csharp.facts(spark.createDataFrame([("a.cs", "p", DEAD), ("x.g.cs", "p", "class G { void M() { Alone(); } }")], "file string, project string, text string"))
    got = {r.id: r.excused for r in T.unused_symbols(facts).collect()}
    assert got == {"Used.Alone()": None, "Used.Tool()": "mcpTool", "Gone": None, "Tests.T()": "testMethod", "Tests.Helper()": "testContainer", "MoreTests.Extra()": "testContainer", "Raw.Handle": "interop"}
    assert "Used.Quiet()" in {r.id for r in T.unused_symbols(facts, internal=True).collect()}
    assert [tuple(r) for r in T.obsolete_usage(facts).collect()] == [("Old", True, 2, "a.cs", "use Used")]
    assert [r.type for r in T.large_classes(facts, 6, 100).collect()] == ["Used"]
    assert sorted((r.name, r.rank) for r in T.search(facts, "TOOL").collect()) == [("Tool", 0)]
    metadata = spark.createDataFrame([("System.Text.Encoder", "Encoder")], "full_name string, name string")
    assert [r.kind for r in T.search(facts, "enco", metadata).collect()] == ["metadata"] and T.search(facts, "en", metadata).count() == 0


def test_baseline_and_conflicts(spark, facts, tmp_path):
    (tmp_path / "api.json").write_text('[ /* old */ {"name": "Shop.Web.Store", "kind": "class", "accessibility": "Public"}, {"name": "Shop.Web.Lost", "kind": "class", "accessibility": "Public"}, {"name": "Shop.Web.Store.Pay()", "kind": "method", "accessibility": "Public"}]')
    got = {(r.change, r.name) for r in T.breaking_changes(facts, T.read_baseline(facts, str(tmp_path / "api.json"))).where("severity = 'Breaking'").collect()}
    assert got == {("Removed", "Shop.Web.Lost"), ("AccessibilityNarrowed", "Shop.Web.Store.Pay()")}
    schema = "id string, path string, line int, suppressed boolean"
    before = spark.createDataFrame([("E1", "A.cs", 1, False), ("E1", "a.cs", 2, False), ("E2", "b.cs", 1, True)], schema)
    after = spark.createDataFrame([("E1", "a.cs", 1, False), ("E1", "a.cs", 2, None), ("E1", "A.CS", 9, False), ("E2", "b.cs", 1, False), ("E3", "c.cs", 1, True)], schema)
    assert sorted((r.id, r.line) for r in T.conflicts(before, after).collect()) == [("E1", 9), ("E2", 1)]
    with pytest.raises(errors.InvalidArgument):
        T.refuse_degraded(spark.createDataFrame([("p", "gone")], "project string, message string"))
    T.refuse_degraded(spark.createDataFrame([], "project string, message string"))
    rows = spark.createDataFrame([("a", "Error", False, "P1"), ("b", "warning", None, "p2"), ("c", "info", False, "p1"), ("d", "error", True, "p1")], "id string, severity string, suppressed boolean, project string")
    assert sorted(r.id for r in T.diagnostics(rows).collect()) == ["a", "b"] and [r.id for r in T.diagnostics(rows, "error", "p").collect()] == ["a"]
    assert T.god_objects(facts, 5, 3, 0, 1).where("type = 'Shop.Web.Store'").count() == 1 and T.god_objects(facts).count() == 0


def test_control_flow(spark):
    from factloom.functions.control_flow import analyze_control_flow, control_flow

    text = "void M() {\n  if (a) { return 1; }\n  while (true) { if (b) break; }\n  for (;;) { go(); }\n  dead();\n}\n"
    assert control_flow(text, 2, 2)["end_reachable"] and control_flow(text, 2, 2)["returns"] == [(2, "return 1 ;")]
    assert control_flow(text, 3, 3)["end_reachable"] and not control_flow(text, 4, 4)["end_reachable"]
    assert control_flow(text, 4, 5)["unreachable"] == [5]
    assert control_flow("try { throw x; } catch { return 2; } finally { f(); }", 1, 1)["end_reachable"] is False
    assert control_flow("if (a) return 1; else throw e;", 1, 1)["end_reachable"] is False
    assert control_flow("do { x(); } while (true); y();", 1, 1)["unreachable"] == [1]
    assert control_flow("continue;", 1, 1)["exits"] == [(1, "continue ;")] and control_flow(text, 50, 60) is None
    files = spark.createDataFrame([("a.cs", text), ("b.cs", None)], "file string, text string")
    got = analyze_control_flow(files, spark.createDataFrame([("a.cs", 2, 4), ("b.cs", 1, 2), ("a.cs", 90, 99)], "file string, start int, stop int")).collect()
    assert [(r.file, r.end_reachable, r.returns) for r in got] == [("a.cs", False, ["2: return 1 ;"])]


def test_rename(spark, facts):
    rows = T.rename(facts, "Store.Make", "Create").collect()
    assert all(SHOP.split("\n")[r.line - 1][r.col - 1 : r.end_col - 1] == "Make" for r in rows if r.file == "Shop.cs") and {r.what for r in rows} == {"edit", "declaration"} and len(rows) == 3
    assert [r.line for r in T.rename(facts, "Store.Make", "Go").where("what = 'conflict'").collect()] == [15]
    texts = {"Money.cs": MONEY, "Shop.cs": SHOP, "Tests.cs": TESTS}
    assert all(texts[r.file].split("\n")[r.line - 1][r.col - 1 : r.end_col - 1] == "Store" for r in T.rename(facts, "Shop.Web.Store", "Shop2").where("what <> 'conflict'").collect())
    with pytest.raises(errors.InvalidArgument):
        T.rename(facts, "Store.Make", "1x")
    with pytest.raises(errors.SymbolNotFound):
        T.rename(facts, "nothing", "x")


def test_documents_and_metadata(spark):
    xml = "<summary>Buys\n  a thing.</summary><exception cref='T:System.IO.IOException'/><exception cref='Own'/>"
    row = spark.createDataFrame([(xml,), (None,)], "x string").select(T.doc_comment(F.col("x")).alias("d")).collect()
    assert row[0].d.summary == "Buys a thing." and row[0].d.exceptions == ["System.IO.IOException", "Own"] and row[1].d.exceptions == []
    types = spark.createDataFrame([("A", "1", "X"), ("A", "1", "X"), ("A", "2", "Y")], "assembly string, version string, full_name string")
    assert sorted(map(tuple, T.metadata_assemblies(types).collect())) == [("A", "1", 1), ("A", "2", 1)]
    from factloom.functions.predicates import clamped

    assert [r.v for r in spark.range(3).select(clamped(F.col("id") * 4, 1, 5).alias("v")).collect()] == [1, 4, 5]


def test_names_are_stripped_however_deep(spark):
    deep = "global::A.B" + "<C" * 12 + ">" * 12 + ".D`2"
    rows = spark.createDataFrame([(deep,), ("A<B, C<D>>",), ("A<B",), ("A>",), ("A",), ("",), (None,), ("A<B>.C<D<E>>.F",)], "n string")
    assert [r[0] for r in rows.select(T.stripped(F.col("n"))).collect()] == ["A.B.D", "A", "A<B", "A>", "A", "", None, "A.C.F"]
    assert csharp.extract("class A { " + "B<" * 150 + "int" + ">" * 150 + " f; }")


def test_two_subscriptions_at_one_place_are_both_told(spark):
    """Of facts that are alike but for the project one is told, the same in each run."""
    row = {c.split()[0]: 0 if c.endswith(" int") else "" for c in csharp.SCHEMA.split(", ")}
    event = row | {"kind": "member", "name": "Sold", "full_name": "A.Sold", "container": "A", "detail": "event"}
    place = row | {"kind": "subscribe", "name": "Sold", "file": "a.cs", "line": 3, "col": 7}
    facts = spark.createDataFrame([tuple(r.values()) for r in (event, *(place | {"detail": d, "container": c, "project": p} for d, c, p in [("+=", "A.F", "P2"), ("+=", "A.F", "P1"), ("-=", "A.F", "P1"), ("-=", "A.G", "P1")]))], csharp.SCHEMA)
    got = T.event_subscribers(facts, spark.createDataFrame([("Sold",)], "request string")).collect()
    assert sorted((r["subscribes"], r["enclosing"], r["project"]) for r in got) == [(False, "A.F", "P1"), (False, "A.G", "P1"), (True, "A.F", "P1")]


def test_facts_leave_a_task_in_pieces(spark, monkeypatch):
    """Of texts of one name the smallest counts; a name may be null, a text without one is read like others."""
    monkeypatch.setattr(csharp, "FACTS_AT_ONCE", 4)
    files = [("P", "a.cs", "class B { int x; int y; int z; }"), ("P", "a.cs", "class A { int x; int y; int z; int w; }"), ("P", None, "class C { }"), ("P", None, "class D { }"), (None, "e.cs", "class E { }"), ("P", "n.cs", None)]
    got = csharp.facts(spark.createDataFrame(files, "project string, file string, text string"))
    assert sorted(r["name"] for r in got.where("kind = 'type'").collect()) == ["A", "C", "E"]
    assert sorted(r["name"] for r in got.where("kind = 'member'").collect()) == ["w", "x", "y", "z"]
