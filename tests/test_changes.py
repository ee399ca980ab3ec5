"""Change tracking, stale sets and snapshots."""

import pytest

from factloom import errors
from factloom.plans import snapshots
from factloom.streaming import changes


def test_classified(spark):
    rows = spark.createDataFrame([("A.cs", "changed"), ("new.cs", "added"), ("A.cs ", "changed"), ("p.csproj", "changed"), ("x/bin/B.cs", "changed"), ("obj\\C.cs", "changed"), ("l.DLL", "changed"), ("A.txt", "changed"), ("gone.cs", "removed")], "path string, change string")
    files = spark.createDataFrame([("A.cs",), ("gone.cs",)], "path string")
    assert {r.path: r.effect for r in changes.classified(rows, files).collect()} == {"A.cs": "document", "new.cs": "reload", "p.csproj": "reload", "l.DLL": "metadata", "gone.cs": "reload"}


def test_debounced(spark):
    at = ["2026-01-01 00:00:00.000", "2026-01-01 00:00:00.150", "2026-01-01 00:00:00.300", "2026-01-01 00:00:00.900"]
    events = spark.createDataFrame([("a", at[0]), ("b", at[1]), ("a", at[2]), ("a", at[3])], "path string, at string")
    assert sorted((r.batch, r.path, r.n) for r in changes.debounced(events).collect()) == [(1, "a", 2), (1, "b", 1), (2, "a", 1)]


def test_stale_set():
    stale = changes.StaleSet()
    stale.add({"a", "b"})
    with pytest.raises(ZeroDivisionError), stale.drain() as names:
        stale.add({"c"})
        assert names == {"a", "b"}
        1 / 0
    assert stale.waiting() == {"a", "b", "c"}
    with stale.drain() as names:
        assert names == {"a", "b", "c"}
    assert stale.waiting() == set()


def test_rebuild(spark):
    catalog, sizes = snapshots.Catalog(spark), iter([1, 2])
    catalog.load("one", lambda: {"t": spark.range(next(sizes))}, skipped=[("p", "broken")])
    assert catalog.table("t").count() == 1
    assert catalog.rebuild() == "one" and catalog.table("t").count() == 2
    with pytest.raises(StopIteration):
        catalog.rebuild("one")
    assert catalog.table("t").count() == 2 and [tuple(r) for r in catalog.listing().collect()] == [("one", True, 1, "error", 1)]
    catalog.load("two", {})
    assert [(r.path, r.status) for r in catalog.listing().collect()] == [("one", "error"), ("two", "empty")]
    with pytest.raises(errors.InvalidArgument):
        catalog.rebuild("two")
    catalog.unload("two")
    with pytest.raises(errors.NotLoaded):
        catalog.rebuild("two")
