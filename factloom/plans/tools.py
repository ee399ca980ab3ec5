"""The tools by name, over one snapshot of facts: defaults, order of items, limit, and the uniform result as rows or JSON."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.errors import InvalidArgument
from factloom.operators import code_tools as T
from factloom.operators.envelope import ListResult, list_result


@dataclass
class Tool:
    """How a tool's rows are ordered and cut: ``order`` is made total by all other columns; no limit: all rows."""

    run: Callable[..., DataFrame]
    order: list[str]
    limit: int | None = None
    by: dict[str, str] = field(default_factory=dict)


def _rank(column: str, *first: str) -> Column:
    out = F.lit(len(first))
    for n, value in reversed(list(enumerate(first))):
        out = F.when(F.col(column) == value, n).otherwise(out)
    return out


TOOLS = {
    "go_to_definition": Tool(T.definitions, ["file", "line"], 50),
    "search_symbols": Tool(T.search, ["rank", "full_name"], 200, {"byKind": "kind"}),
    "find_references": Tool(T.references, ["file", "line", "col"], 500, {"byKind": "kind", "byProject": "project"}),
    "find_callers": Tool(T.callers, ["file", "line"], 500, {"byProject": "project"}),
    "find_implementations": Tool(T.implementations, ["type"], 200),
    "find_attribute_usages": Tool(T.attribute_usages, ["file", "line"], 500, {"byProject": "project"}),
    "find_event_subscribers": Tool(T.event_subscribers, ["file", "line"], 500, {"byProject": "project"}),
    "find_throw_sites": Tool(T.throw_sites, ["file", "line", "col"], 500, {"byType": "exception", "byProject": "project"}),
    "find_catch_blocks": Tool(T.catch_blocks, ["file", "line"], 500, {"byType": "exception", "byProject": "project"}),
    "find_reflection_usage": Tool(T.reflection_usage, ["file", "line"], 500, {"byKind": "kind"}),
    "find_unused_symbols": Tool(T.unused_symbols, ["project", "file", "line"], 500, {"byKind": "kind"}),
    "find_naming_violations": Tool(T.naming_violations, ["rule", "file", "line"], 500, {"byRule": "rule"}),
    "find_obsolete_usage": Tool(T.obsolete_usage, ["-is_error", "-n", "name"]),
    "find_large_classes": Tool(T.large_classes, ["-size", "type"], 100),
    "find_async_violations": Tool(T.async_violations, ["severity:Error,Warning", "file", "line"], None, {"bySeverity": "severity", "byPattern": "pattern"}),
    "find_disposable_misuse": Tool(T.disposable_misuse, ["severity:Error,Warning", "file", "line"], None, {"bySeverity": "severity"}),
    "find_breaking_changes": Tool(T.breaking_changes, ["severity:Breaking,NonBreaking", "name"], None, {"bySeverity": "severity"}),
    "get_complexity_metrics": Tool(T.complexity_metrics, ["-cyclomatic", "file", "line"], 100),
    "get_di_registrations": Tool(T.di_registrations, ["service", "file", "line"], 200, {"byLifetime": "lifetime"}),
    "get_extension_methods": Tool(T.extension_methods, ["receiver", "method"], 100),
    "get_instantiation_options": Tool(T.instantiation_options, ["request", "how", "member"]),
    "get_operators": Tool(T.operators_of, ["kind", "arity", "params"]),
    "get_overloads": Tool(T.overloads, ["request", "place"]),
    "get_public_api_surface": Tool(T.public_api, ["name", "signature"], None, {"byKind": "kind", "byProject": "project"}),
    "get_symbol_context": Tool(T.symbol_context, ["request", "type"]),
    "get_test_summary": Tool(T.test_summary, ["project", "framework", "attribute"]),
    "get_type_hierarchy": Tool(T.type_hierarchy, ["relation", "depth", "type"]),
    "change_signature": Tool(T.change_signature, ["file", "line", "what"]),
    "generate_test_skeleton": Tool(T.test_skeletons, ["type"]),
}


def run(name: str, facts: DataFrame, *arguments: object, limit: int | None = None, **named: object) -> ListResult:
    """A tool's answer: its rows in its order, cut at ``limit`` or its default, with counts over all of them."""
    if name not in TOOLS:
        raise InvalidArgument("no such tool", tool=name, known=sorted(TOOLS))
    if limit is not None and limit < 0:
        raise InvalidArgument("limit must not be negative", limit=limit)
    tool = TOOLS[name]
    rows = tool.run(facts, *arguments, **named)
    order: list[Column] = []
    for key in tool.order:
        column, _, first = key.partition(":")
        order.append(_rank(column, *first.split(",")) if first else F.col(key[1:]).desc() if key.startswith("-") else F.col(key))
    order += [F.col(c) for c in sorted(rows.columns)]
    cut = limit if limit is not None else tool.limit if tool.limit is not None else 2**31 - 1
    return list_result(rows, order, cut, {n: F.col(c) for n, c in tool.by.items()})


def to_json(result: ListResult) -> DataFrame:
    """One row ``(json)``: items in order, totalCount, truncated, limit and, for each dimension, counts by key. The items are at most ``limit``."""
    place = F.monotonically_increasing_id()
    items = result.items.select(F.struct(place.alias("place"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("item")).alias("x"))
    listed = items.agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["item"]), ","), F.lit("]")).alias("items"))
    out = result.meta.join(F.broadcast(listed))
    if result.summary is None:
        summary = F.lit("{}")
    else:
        keys = result.summary.groupBy("dimension").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("key", F.lit("")).alias("key"), "n")))).alias("counts"))
        whole = keys.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", F.to_json("counts").alias("text")))))).alias("text"))
        # the inner objects are texts here; they become objects by taking the quotes off
        out = out.join(F.broadcast(whole))
        summary = F.replace(F.regexp_replace(F.regexp_replace("text", r'":"\{', '":{'), r'\}"', "}"), F.lit('\\"'), F.lit('"'))
    return out.select(F.concat(F.lit('{"items":'), "items", F.lit(',"totalCount":'), "total_count", F.lit(',"truncated":'), "truncated", F.lit(',"limit":'), "limit", F.lit(',"summary":'), summary, F.lit("}")).alias("json"))
