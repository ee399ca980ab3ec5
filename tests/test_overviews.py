"""Overviews and texts over hand-made facts."""

import pytest

from factloom.operators import overviews as O
from factloom.sources.csharp import SCHEMA

NAMES = [x.split(" ")[0] for x in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def facts(spark):
    def row(kind, **c):
        base = {x.split(" ")[0]: "" if x.split(" ")[1] == "string" else 0 for x in SCHEMA.split(", ")}
        return tuple((base | {"kind": kind, "project": "p"} | c)[n] for n in NAMES)

    member = lambda of, name, line, end, detail="method", params="", file="A.cs": row("member", file=file, name=name, container=of, full_name=f"{of}.{name}", line=line, end_line=end, detail=detail, modifiers="public", extra=params)
    rows = [
        row("type", file="A.cs", name="A", full_name="n.A", container="n", line=1, end_line=20, detail="class", modifiers="public"),
        row("type", file="B.cs", name="B", full_name="n.B", container="n", line=1, end_line=9, detail="class", modifiers="public"),
        row("base", file="B.cs", name="A", container="n.B"),
        member("n.A", "Go", 3, 5),
        member("n.A", "Go", 7, 7, params="int"),
        member("n.B", "Go", 2, 3, file="B.cs"),
        member("n.A", "field", 2, 2, "field"),
        member("n.A", "Last", 6, 99),
        row("call", name="Go", container="n.B.Go", detail="method"),
        row("call", name="Last", container="n.A.Go", detail="method"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_method_sources(spark, facts):
    asked = spark.createDataFrame([("A.Go",), ("Go",), ("A.field",), ("A.Last",), ("X.Y",), ("Lib.Z",), ("A.Go",)], "request string")
    files = spark.createDataFrame([("A.cs", "1\n2\n\n4\n5\n6\n7"), ("B.cs", None)], "file string, text string")
    outside = spark.createDataFrame([("Lib.Z",)], "full_name string")
    got = sorted((r["request"], r["status"], r["id"], r["text"], r["candidates"]) for r in O.method_sources(facts, asked, files, outside).collect())
    assert got == [
        ("A.Go", "ok", "n.A.Go()", "4\n5", None),  # leading blank lines go
        ("A.Go", "ok", "n.A.Go(int)", "7", None),
        ("A.Last", "ok", "n.A.Last()", "6\n7", None),  # a span beyond the file's end
        ("A.field", "unsupportedKind", "n.A.field", None, None),
        ("Go", "ambiguous", None, None, "n.A.Go,n.B.Go"),
        ("Lib.Z", "metadata", None, None, None),
        ("X.Y", "notFound", None, None, None),
    ]
    assert {r["status"] for r in O.method_sources(facts.limit(0), asked, files).collect()} == {"notFound"}
    assert [r["text"] for r in O.method_sources(facts, spark.createDataFrame([("B.Go",)], "request string"), files).collect()] == [None]  # no text of that file


def test_overviews(spark, facts):
    diagnostics = spark.createDataFrame([("D1", "Error", "a.CS", 1), ("D1", "error", "A.cs", 2), ("D2", "warning", "Z.cs", 1), ("D3", None, None, 1)], "id string, severity string, file string, line int")
    files = {r["file"]: tuple(r)[1:] for r in O.file_overviews(facts.where("kind in ('type', 'member')"), diagnostics).collect()}
    assert files["A.cs"] == (["A"], 1, 4, 2, 0) and files["Z.cs"] == ([], 0, 0, 0, 1)
    asked = spark.createDataFrame([("A",), ("B",), ("C",)], "request string")
    types = {r["request"]: (r["ancestors"], r["derived"], r["n_diagnostics"], r["diagnostics"]) for r in O.type_overviews(facts, asked, diagnostics).collect()}
    assert types == {"A": ([], ["n.B"], 2, ["D1"]), "B": (["n.A"], [], 0, [])}
    got = [tuple(r) for r in O.analyze_methods(facts, spark.createDataFrame([("A.Go",), ("A.Last",), ("B",)], "request string")).orderBy("request").collect()]
    assert got == [("A.Go", "n.A.Go()", "A.cs", 3, 2, ["n.B.Go"], ["Last"]), ("A.Last", "n.A.Last()", "A.cs", 6, 1, ["n.A.Go"], [])]


def test_creation_options(spark, facts):
    def row(kind, **c):
        base = {x.split(" ")[0]: "" if x.split(" ")[1] == "string" else 0 for x in SCHEMA.split(", ")}
        return tuple((base | {"kind": kind, "project": "p", "file": "M.cs"} | c)[n] for n in NAMES)

    extra = [
        row("member", name="A", container="n.A", full_name="n.A.A", detail="constructor", modifiers="internal", extra="int"),
        row("member", name="A", container="n.A", full_name="n.A.A", detail="constructor", modifiers="private", extra="A"),  # a copy constructor
        row("member", name="Get", container="n.M", full_name="n.M.Get", detail="method", modifiers="public static", type="System.ValueTask<n.B>", extra="int", project="q"),
        row("member", name="One", container="n.M", full_name="n.M.One", detail="field", modifiers="static", type="B", project="q"),
        row("member", name="Many", container="n.M", full_name="n.M.Many", detail="method", modifiers="public static", type="List<B>"),
        row("member", name="Id", container="n.A", full_name="n.A.Id", detail="property", modifiers="public required", type="int"),
        row("member", name="Id", container="n.B", full_name="n.B.Id", detail="property", modifiers="public required", type="long"),
        row("call", name="AddScoped", container="n.S.Go", detail="method", type="IB, n.B"),
    ]
    every = facts.unionByName(spark.createDataFrame(extra, SCHEMA))
    asked = spark.createDataFrame([("A",), ("B",), ("None",)], "request string")
    friends = spark.createDataFrame([("p", "Test")], "project string, friend string")
    for project, near in (("Test", True), (None, None)):
        got = sorted(map(tuple, O.creation_options(every, asked, friends, project).collect()), key=str)
        far = None if project is None else False
        yes = None if project is None else True
        assert got == sorted(
            [
                ("A", "constructor", "n.A.A", "int", False, near),
                ("A", "required", "n.A.Id", "int", False, None),
                ("B", "constructor", "n.B.B", "", False, yes),
                ("B", "factory", "n.M.Get", "int", True, yes),
                ("B", "factory", "n.M.One", "", False, far),
                ("B", "registration", "IB", "Scoped", False, None),
                ("B", "required", "n.B.Id", "long", False, None),  # the nearest of the name
            ],
            key=str,
        )


def test_conflicts_of_change(spark):
    rows = "id string, path string, line int, suppressed boolean, project string"
    before = spark.createDataFrame([("E", "a", 1, False, "core")], rows)
    after = spark.createDataFrame([("E", "A", 1, False, "core"), ("E", "a", 5, False, "core"), ("E", "b", 1, False, "app"), ("E", "c", 1, False, "other"), ("E", "d", 1, True, "app")], rows)
    refs = spark.createDataFrame([("app", "core"), ("core", "base")], "src string, dst string")
    got = O.conflicts_of_change(before, after, spark.createDataFrame([("core",)], "project string"), refs)
    assert sorted(map(tuple, got.collect())) == [("E", "a", 5, 1), ("E", "b", 1, 1)]
