"""Names by scope, dispatch, exception flow through spans, snapshots kept up to date."""

import pytest
from pyspark.sql import functions as F

from factloom.errors import NotLoaded
from factloom.operators import binding as B
from factloom.operators import exceptions as X
from factloom.plans.fact_store import FactStore

TYPES = "type string, name string, namespace string, container string"
EDGES = "src string, dst string"


@pytest.fixture(scope="module")
def program(spark):
    """Outer holds Inner; Inner derives from Mid, Mid from Top; other types stand in namespaces."""
    types = [("Outer", "Outer", "a.b", None), ("Inner", "Inner", "a.b", "Outer"), ("Mid", "Mid", "a", None), ("Top", "Top", "a", None), ("Helper1", "Helper", "a.b", None), ("Helper2", "Helper", "a", None), ("Lib1", "Tool", "lib.one", None), ("Lib2", "Tool", "lib.two", None), ("Odd", "Odd", "", None), ("Null", None, "a", None), ("Loop", "Loop", "z", None)]
    members = [("Inner.f1", "f", "Inner"), ("Inner.f2", "f", "Inner"), ("Outer.f", "f", "Outer"), ("Top.g", "g", "Top"), ("Mid.h", "h", "Mid"), ("Top.h", "h", "Top"), ("Outer.o", "o", "Outer"), ("Outer.Helper", "Helper", "Outer"), ("Top.null", None, "Top")]
    bases = [("Inner", "Mid"), ("Mid", "Top"), ("Loop", "Loop"), (None, "Top")]
    imports = [("x.cs", "lib.one"), ("y.cs", "lib.one"), ("y.cs", "lib.two"), ("x.cs", "lib.one")]
    return spark.createDataFrame(types, TYPES), spark.createDataFrame(members, "member string, name string, type string"), spark.createDataFrame(bases, EDGES), spark.createDataFrame(imports, "file string, namespace string")


USES = {
    ("f", "Inner", "a.b", "x.cs"): ("ok", "Inner.f1"),  # overloads are one; Outer.f is shadowed
    ("f", "Outer", "a.b", "x.cs"): ("ok", "Outer.f"),
    ("g", "Inner", "a.b", "x.cs"): ("ok", "Top.g"),  # by the closure of bases
    ("h", "Inner", "a.b", "x.cs"): ("ok", "Mid.h"),  # the nearer base wins
    ("o", "Inner", "a.b", "x.cs"): ("ok", "Outer.o"),  # an enclosing type comes after the bases
    ("Helper", "Inner", "a.b", "x.cs"): ("ok", "Outer.Helper"),  # a member before a type of the namespace
    ("Helper", "Mid", "a", "x.cs"): ("ok", "Helper2"),  # a.b is not visible from a
    ("Helper", None, "a.b", "x.cs"): ("ok", "Helper1"),  # the inner namespace first
    ("Tool", "Mid", "a", "x.cs"): ("ok", "Lib1"),
    ("Tool", "Mid", "a", "y.cs"): ("ambiguous", None),  # two imports
    ("Tool", "Mid", "a", "z.cs"): ("notFound", None),  # nothing imported: no match by name alone
    ("Odd", "Mid", "a.b", "x.cs"): ("ok", "Odd"),  # the namespace without a name
    ("Odd", None, None, None): ("ok", "Odd"),
    ("f", None, "a.b", "x.cs"): ("notFound", None),
    ("f", "Unknown", "a.b", "x.cs"): ("notFound", None),
    ("Loop", "Loop", "z", "x.cs"): ("ok", "Loop"),
    ("F", "Inner", "a.b", "x.cs"): ("notFound", None),  # case counts
}


def test_bind(spark, program):
    """Each use twice, all at once."""
    types, members, bases, imports = program
    got = B.bind(spark.createDataFrame([*USES, *USES], "name string, type string, namespace string, file string"), types, members, bases, imports).collect()
    assert {(r["name"], r["type"], r["namespace"], r["file"]): (r["status"], r["id"]) for r in got} == USES and len(got) == len(USES)


def test_bind_of_nothing(spark, program):
    types, members, bases, imports = program
    uses = spark.createDataFrame([(None, "Mid", "a", "x.cs")], "name string, type string, namespace string, file string")
    assert B.bind(uses, types, members, bases, imports).collect() == []
    one = spark.createDataFrame([("f", "Mid", "a", "x.cs")], "name string, type string, namespace string, file string")
    assert [r["status"] for r in B.bind(one, types.limit(0), members.limit(0), bases.limit(0), imports.limit(0)).collect()] == ["notFound"]


def test_bind_qualified(spark, program):
    types, members, bases, _ = program
    two = bases.unionByName(spark.createDataFrame([("Mid", "Helper1")], EDGES))
    more = members.unionByName(spark.createDataFrame([("Helper1.g", "g", "Helper1")], members.schema))
    uses = spark.createDataFrame([("Inner", "h"), ("Inner", "g"), ("Inner", "o"), ("Outer", "Inner"), (None, "g"), ("Inner", None)], "type string, name string")
    got = {(r["type"], r["name"]): (r["status"], r["id"]) for r in B.bind_qualified(uses, types, more, two).collect()}
    assert got == {("Inner", "h"): ("ok", "Mid.h"), ("Inner", "g"): ("ambiguous", None), ("Inner", "o"): ("notFound", None), ("Outer", "Inner"): ("ok", "Inner")}


METHODS = "member string, type string, signature string, overrides boolean"


def test_override_edges(spark):
    methods = [("I.run", "I", "run()", False), ("J.stop", "J", "stop()", False), ("A.run", "A", "run()", False), ("B.run", "B", "run()", True), ("C.run", "C", "run()", True), ("C.run2", "C", "run(int)", True), ("D.run", "D", "run()", False), ("D.stop", "D", "stop()", False)]
    bases = spark.createDataFrame([("B", "A"), ("C", "Gap"), ("Gap", "B"), ("E", "D")], EDGES)
    interfaces = spark.createDataFrame([("A", "I"), ("J", "I"), ("E", "J")], EDGES)
    table = spark.createDataFrame(methods, METHODS)
    got = {(r["src"], r["dst"], r["how"]) for r in B.override_edges(table, bases, interfaces).collect()}
    want = {
        ("B.run", "A.run", "override"),
        ("C.run", "B.run", "override"),  # past a class without the method
        ("A.run", "I.run", "interface"),
        ("B.run", "I.run", "interface"),  # the class below has a nearer one
        ("C.run", "I.run", "interface"),
        ("D.run", "I.run", "interface"),  # E names J, which extends I; D above E does it
        ("D.stop", "J.stop", "interface"),
    }
    assert got == want
    targets = spark.createDataFrame([("C.run",)], "target string")
    reached = {r["target"] for r in B.dispatch_targets(B.override_edges(table, bases, interfaces), targets).collect()}
    assert reached == {"A.run", "B.run", "C.run", "I.run", "D.run"}
    calls = spark.createDataFrame([("I.run", "x", 1, "p"), ("C.run", "x", 1, "p"), ("C.run2", "x", 2, "p"), ("B.run", "y", 3, "q"), ("J.stop", "y", 4, "q")], "target string, file string, line int, project string")
    found = B.callers_by_dispatch(calls, targets, B.override_edges(table, bases, interfaces))
    assert sorted(map(tuple, found.collect())) == [("x", 1, "p", 2, 1), ("y", 3, "q", 1, 0)]
    assert B.dispatch_targets(B.override_edges(table.limit(0), bases.limit(0), interfaces.limit(0)), targets).collect() == [("C.run",)]


@pytest.fixture(scope="module")
def flow(spark):
    """Top calls Mid within a try, Mid calls Deep; exceptions Bad < Error < Exception, Other < Exception."""
    bases = spark.createDataFrame([("Bad", "Error"), ("Error", "Exception"), ("Other", "Exception")], EDGES)
    calls = spark.createDataFrame([("Top", "Mid", 15), ("Mid", "Deep", 25), ("Deep", "Top", 1), ("Mid", "Side", 90), ("Top", "Late", 50)], "src string, dst string, at int")
    root = spark.createDataFrame([("Top",)], "node string")

    def run(throws, tries, clauses, depth=3):
        throws = spark.createDataFrame(throws, "node string, at int, exception string")
        tries = spark.createDataFrame(tries, "node string, span int, start int, stop int")
        clauses = spark.createDataFrame(clauses, "node string, span int, clause int, type string, filtered boolean")
        return list((r["node"], r["exception"], r["chain"], r["caught_in"], r["caught_span"], r["caught_clause"], r["has_filter"]) for r in X.exception_flow(calls, root, throws, tries, clauses, bases, depth).orderBy("node", "at").collect())

    return run


def test_exception_escapes_and_is_caught_by_a_base(flow):
    tries = [("Top", 1, 10, 20)]
    assert flow([("Deep", 5, "Bad")], tries, [("Top", 1, 1, "Other", False)]) == [("Deep", "Bad", "Top>Mid>Deep", None, None, None, False)]
    assert flow([("Deep", 5, "Bad")], tries, [("Top", 1, 1, "Error", False)]) == [("Deep", "Bad", "Top>Mid>Deep", "Top", 1, 1, False)]
    assert flow([("Deep", 5, "Exception")], tries, [("Top", 1, 1, "Error", False)])[0][3] is None  # a base is not caught by what derives from it
    assert flow([("Late", 5, "Bad")], tries, [("Top", 1, 1, None, False)])[0][3] is None  # the call stands outside of the span


def test_first_clause_without_a_filter_decides(flow):
    tries = [("Top", 1, 10, 20), ("Mid", 1, 0, 100), ("Mid", 2, 20, 30)]
    clauses = [("Mid", 2, 1, "Bad", True), ("Mid", 1, 1, "Other", False), ("Mid", 1, 2, "Exception", False), ("Top", 1, 1, None, False)]
    assert flow([("Deep", 5, "Bad")], tries, clauses) == [("Deep", "Bad", "Top>Mid>Deep", "Mid", 1, 2, True)]  # a filter before, an outer try in the same method
    assert flow([("Deep", 5, "Other")], tries, clauses) == [("Deep", "Other", "Top>Mid>Deep", "Mid", 1, 1, False)]  # the filtered clause is of another type
    inner = [("Mid", 2, 1, "Bad", False), *clauses[1:]]
    assert flow([("Deep", 5, "Bad")], tries, inner)[0][3:6] == ("Mid", 2, 1)
    assert flow([("Side", 5, "Bad")], tries, inner)[0][3:6] == ("Mid", 1, 2)  # that call is not in the inner span
    later = [("Mid", 1, 1, None, False), ("Top", 1, 1, "Bad", True)]
    assert flow([("Deep", 5, "Bad")], tries, later)[0][3:] == ("Mid", 1, 1, False)  # a filter further out is not met


def test_exception_in_the_root_and_recursion(flow):
    assert flow([("Top", 12, "Bad"), ("Top", 20, "Bad")], [("Top", 1, 10, 20)], [("Top", 1, 1, None, False)]) == [("Top", "Bad", "Top", "Top", 1, 1, False), ("Top", "Bad", "Top", None, None, None, False)]
    assert flow([("Deep", 5, "Bad")], [], [], depth=1) == []
    assert flow([("Deep", 5, "Unheard"), ("Deep", 5, "Unheard")], [("Deep", 1, 0, 9)], [("Deep", 1, 1, "Unheard", None)])[0][3:] == ("Deep", 1, 1, False)


def test_exception_summary(spark):
    rows = spark.createDataFrame([("A", True, False), ("A", False, True), ("B", True, True)], "exception string, escapes boolean, has_filter boolean")
    assert sorted(map(tuple, X.exception_summary(rows).collect())) == [("A", 1, 1, 1), ("B", 1, 0, 1)]


FILES = "path string, digest string, project string, words int"


def counted(files):
    return files.groupBy("project").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


def test_fact_store(spark, tmp_path):
    refs = spark.createDataFrame([("app", "core"), ("test", "app")], EDGES)
    seen = []

    def extract(files):
        seen.append(sorted({r["project"] for r in files.collect()}))
        return counted(files)

    store = FactStore(spark, f"{tmp_path}/store", "project string, n long, words long", extract)
    with pytest.raises(NotLoaded):
        store.facts()
    first = [("a", "1", "core", 3), ("b", "1", "app", 4), ("c", "1", "test", 5), ("d", "1", "lone", 6)]
    assert store.refresh(spark.createDataFrame(first, FILES), refs) == (0, 4)
    assert store.refresh(spark.createDataFrame(first, FILES), refs) == (0, 0)
    second = [("a", "1", "core", 3), ("b", "2", "app", 40), ("c", "1", "test", 5), ("e", "1", "lone", 1), ("d", "1", "lone", 6)]
    assert store.refresh(spark.createDataFrame(second, FILES), refs) == (1, 3)
    assert seen == [["app", "core", "lone", "test"], ["app", "lone", "test"]]  # core refers to nothing that changed
    now = lambda k=None: sorted(map(tuple, store.facts(k).select("project", "n", "words").collect()))
    assert now() == sorted(map(tuple, counted(spark.createDataFrame(second, FILES)).collect())) and now(0) == [("app", 1, 4), ("core", 1, 3), ("lone", 1, 6), ("test", 1, 5)]
    third = [("a", "1", "core", 3), ("b", "2", "test", 40)]  # a project loses all files, a file moves

    def fails(files):
        return counted(files).withColumn("n", F.raise_error(F.lit("no")).cast("long"))

    store.extract = fails
    pinned = store.facts(1)
    with pytest.raises(Exception, match="no"):
        store.refresh(spark.createDataFrame(third, FILES), refs)
    assert store.latest() == 1 and now() == sorted(map(tuple, counted(spark.createDataFrame(second, FILES)).collect()))
    store.extract = counted
    assert store.refresh(spark.createDataFrame(third, FILES), refs)[0] == 2
    assert now() == [("core", 1, 3), ("test", 1, 40)]
    assert sorted(r["project"] for r in pinned.collect()) == ["app", "core", "lone", "test"]
    assert store.refresh(spark.createDataFrame([], FILES), refs)[0] == 3
    assert now() == [] and store.latest() == 3


def test_fact_store_drops_what_a_failed_refresh_left(spark, tmp_path):
    """A refresh writes facts and then fails; the next one of that number has nothing to say of the project."""
    refs = spark.createDataFrame([], EDGES)
    store = FactStore(spark, f"{tmp_path}/store", "project string, n long, words long", counted)
    store.refresh(spark.createDataFrame([("a", "1", "p", 1)], FILES), refs)
    counted(spark.createDataFrame([("a", "2", "p", 9)], FILES)).withColumn("made_in", F.lit(1).cast("long")).write.mode("append").partitionBy("made_in", "project").parquet(f"{tmp_path}/store/facts")
    assert [tuple(r) for r in store.facts().select("project", "words").collect()] == [("p", 1)]
    store.extract = lambda files: counted(files.where("words > 5"))
    assert store.refresh(spark.createDataFrame([("a", "2", "p", 2)], FILES), refs) == (1, 1)
    assert store.facts().collect() == []


def test_scopes_are_worked_out_for_a_kin_of_types_not_for_each(spark):
    chain = [(f"B{i}", f"B{i + 1}") for i in range(6)]
    types = spark.createDataFrame([(f"T{i}", "x", "n", "Outer" if i % 2 else None) for i in range(40)] + [("Outer", "Outer", "n", None)], "type string, name string, namespace string, container string")
    bases = spark.createDataFrame([(f"T{i}", "B0") for i in range(40)] + chain + [("Outer", "B5"), ("B6", "B4")], "src string, dst string")
    kin, scopes = B.type_kin(types, bases)
    assert kin.count() == 41 and kin.select("kin").distinct().count() == 3
    assert scopes.count() == 7 + 8 + 3  # B0 to B6; these and Outer; B5, B6 and, around the cycle, B4
    members = spark.createDataFrame([("a", "f", "B4"), ("b", "f", "B4"), ("c", "g", "Outer"), ("d", "f", "T3")], "member string, name string, type string")
    uses = spark.createDataFrame([("T2", "f"), ("T3", "f"), ("T3", "g"), ("T2", "g"), ("Unknown", "f")], "type string, name string")
    got = {(r["type"], r["name"]): (r["status"], r["depth"], r["id"]) for r in B.bind_qualified(uses, types, members, bases).collect()}
    assert got == {("T2", "f"): ("ok", 5, "a"), ("T3", "f"): ("ok", 0, "d"), ("T3", "g"): ("notFound", None, None), ("T2", "g"): ("notFound", None, None), ("Unknown", "f"): ("notFound", None, None)}


def test_one_type_that_two_imports_declare_is_one(spark):
    types = spark.createDataFrame([("P", "p", "a", None), ("P", "p", "b", None), ("Q", "q", "a", None), ("R", "q", "b", None)], "type string, name string, namespace string, container string")
    members = spark.createDataFrame([], "member string, name string, type string")
    bases = spark.createDataFrame([], "src string, dst string")
    uses = spark.createDataFrame([(n, None, s, f) for n in ("p", "q") for s in (None, "c.d") for f in (1, 2)], "name string, type string, namespace string, file int")
    imports = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "file int, namespace string")
    got = {(r["name"], r["namespace"], r["file"]): (r["status"], r["tier"], r["id"], r["n"]) for r in B.bind(uses, types, members, bases, imports).collect()}
    want = {(n, s, 1): ("ok", 2, "P", 1) if n == "p" else ("ambiguous", 2, None, 2) for n in ("p", "q") for s in (None, "c.d")}
    assert got == want | {(n, s, 2): ("notFound", None, None, 0) for n in ("p", "q") for s in (None, "c.d")}


def test_an_interface_with_many_methods_of_a_signature_is_not_multiplied_in_the_walk(spark):
    methods = [(f"I.{i}", "I", "s", False) for i in range(30)] + [(f"C{i}.s", f"C{i}", "s", False) for i in range(30)] + [("B.s", "B", "s", False)]
    methods = spark.createDataFrame(methods, "member string, type string, signature string, overrides boolean")
    bases = spark.createDataFrame([(f"C{i}", "B") for i in range(30)] + [("D", "B"), ("B", "D")], EDGES)
    interfaces = spark.createDataFrame([("B", "I"), ("C1", "I")], EDGES)
    assert B.override_edges(methods, bases, interfaces).distinct().count() == B.override_edges(methods, bases, interfaces).count() == 31 * 30
    graph = B.override_graph(methods, bases, interfaces)
    assert graph.count() == 31 + 30
    asked = spark.createDataFrame([("C7.s",)], "target string")
    reached = {r["target"] for edges in (graph,) for r in B.dispatch_targets(edges, asked).collect() if not r["target"].startswith("\0")}
    assert reached == {r["target"] for r in B.dispatch_targets(B.override_edges(methods, bases, interfaces), asked).collect()} and len(reached) == 61
