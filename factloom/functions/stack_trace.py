"""Pasted stack traces as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shapes of names that the compiler makes, after ``+`` has become a dot: an optional closure class, the enclosing method
# in angle brackets, and what it holds; those of asynchronous code run in a method MoveNext of a nested type.
_CLOSURE = r"(?:\.<>c(?:__DisplayClass\d+_\d+)?)?"
_MOVE = r">d(?:__\d+)?(?:`\d+)?\.MoveNext$"
_SHAPES = [
    (re.compile(_CLOSURE + r"\.<<([\w.]+)>g__(\w+)\|[\d_]+" + _MOVE), "localFunction"),
    (re.compile(_CLOSURE + r"\.<<([\w.]+)>b__[\d_]+" + _MOVE), "lambda"),
    (re.compile(_CLOSURE + r"\.<([\w.]+)>d(?:__\d+)?(?:`\d+)?\.MoveNext$"), "stateMachine"),
    (re.compile(_CLOSURE + r"\.<([\w.]+)>g__(\w+)\|[\d_]+$"), "localFunction"),
    (re.compile(_CLOSURE + r"\.<([\w.]+)>b__[\d_]+$"), "lambda"),
]


def plain_name(name: str) -> str:
    """A name with dots for nesting, without arity and type arguments, however deep."""
    name = re.sub(r"`\d+", "", name.replace("+", "."))
    for opened, closed in ("[]", "<>"):
        out, depth = [], 0
        for c in name:
            depth += c == opened
            if not depth:
                out.append(c)
            depth -= c == closed and depth > 0
        name = "".join(out)
    return name


def demangle(name: str) -> tuple[str, str]:
    """The name as written in source, and what the compiler had made of it."""
    dotted = name.replace("+", ".")
    for shape, kind in _SHAPES:
        if m := shape.search(dotted):
            return ".".join([plain_name(dotted[: m.start()]), *(g.lstrip(".") for g in m.groups())]), kind
    name = plain_name(dotted)
    if name.endswith(("..ctor", "..cctor")):
        head = name.rpartition("..")[0]
        return f"{head}.{head.rpartition('.')[2]}", "constructor"
    return name, "method"


def top_level_count(parameters: Column) -> Column:
    """How many parameters a list has: commas outside of brackets, however deep these nest, and one; 0 if it is empty."""
    # pairs of brackets without others within are taken out twice, which leaves none in most lists; what is left of the others is walked
    flat = parameters
    for _ in range(2):
        flat = F.regexp_replace(flat, r"[(\[<{][^(\[<{)\]>}]*[)\]>}]", "")
    marks = F.regexp_extract_all(parameters, F.lit(r"[(\[<{)\]>},]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("n"))

    def step(state: Column, mark: Column) -> Column:
        opens, closes = mark.isin("(", "[", "<", "{"), mark.isin(")", "]", ">", "}")
        depth = F.when(opens, state["depth"] + 1).when(closes, F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        return F.struct(depth.alias("depth"), F.when((mark == ",") & (state["depth"] == 0), state["n"] + 1).otherwise(state["n"]).alias("n"))

    # the flat list is made once for its test and its commas: null if brackets are left
    commas = F.get(F.transform(F.array(flat), lambda x: F.when(~x.rlike(r"[(\[<{)\]>}]"), F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))) + 1)), F.lit(0))
    return F.when(F.coalesce(F.trim(parameters), F.lit("")) == "", 0).otherwise(F.coalesce(commas, F.aggregate(marks, start, step, lambda x: x["n"])))


def trace_rows(traces: DataFrame) -> DataFrame:
    """``(trace_id, position, kind, symbol, origin, parameters, file, line)`` of ``traces(trace_id, text)``; blank and separator lines are left out.

    A frame is what follows ``at``, after any prefix of a log; native offsets are dropped. An exception is a dotted name, or one
    that ends in Exception, at a line's start, after ``--->`` or a log's bracket. Other lines are unknown. Lines are told apart in the JVM; only
    distinct frame names are demangled in Python.
    """
    lines = traces.select("trace_id", F.posexplode(F.split("text", r"\r?\n")).alias("position", "raw")).withColumn("raw", F.trim("raw")).where("raw <> '' and not startswith(raw, '--- ')")
    frame = r"^(?:.*\s)?at ([^(\s][^(]*)\((.*?)\)(?: \+ 0x[0-9a-fA-F]+)?(?: in (.+):line (\d+))?$"
    header = r"^(?:.*\]\s+)?(?:---> )?(?:\(Inner Exception #\d+\) )?(?:Unhandled exception\. )?((?:[A-Za-z_]\w*\.)+[\w+`]+|\w*Exception)(?::.*|\s*)$"
    # a line is matched once for all its parts; those with a NUL of their own, which parts the parts, once for each
    once = F.split(F.regexp_replace("raw", frame, "$1\0$2\0$3\0$4\0"), "\0")
    each = F.when(F.col("raw").rlike(frame), F.array(*(F.regexp_extract("raw", frame, n) for n in range(1, 5)))).otherwise(F.array("raw"))
    # a row of its own, behind which no filter is pushed: that would match each line again
    lines = lines.select("*", F.explode(F.array(F.when(F.instr("raw", "\0") == 0, once).otherwise(each))).alias("parts"))
    kind = F.when(F.size("parts") > 1, "frame").when(F.col("raw").rlike(header), "exception").otherwise("unknown")
    lines = lines.withColumn("kind", kind)
    kind = F.col("kind")
    part = lambda n: F.nullif(F.get("parts", F.lit(n - 1)), F.lit(""))
    name = F.when(kind == "frame", F.trim(part(1))).when(kind == "exception", F.regexp_extract("raw", header, 1))
    rows = lines.select("trace_id", "position", kind.alias("kind"), name.alias("name"), F.when(kind == "frame", top_level_count(part(2))).alias("parameters"), part(3).alias("file"), part(4).cast("int").alias("line"))

    @F.pandas_udf("symbol string, origin string")
    def readable(names):
        import pandas as pd

        known = {n: demangle(n) for n in names.dropna().unique()}
        return pd.DataFrame([known.get(n, (None, None)) for n in names], columns=["symbol", "origin"])

    # names that the compiler did not make stay as they are
    made = (F.col("kind") == "frame") & F.col("name").rlike(r"[+`<>\[\]]|\.\.c?ctor$")
    named = rows.withColumn("made", made).withColumn("r", readable(F.when(F.col("made"), F.col("name"))))
    symbol, origin = F.when(F.col("made"), F.col("r.symbol")).otherwise(F.col("name")), F.when(F.col("made"), F.col("r.origin")).when((F.col("kind") == "frame") & F.col("name").isNotNull(), "method")
    return named.select("trace_id", "position", "kind", symbol.alias("symbol"), origin.alias("origin"), "parameters", "file", "line")


def resolved_frames(frames: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(trace_id, position, symbol, member, origin, status, file, line)`` of the frames of ``trace_rows``, resolved against ``symbols``.

    ``symbols(name, parameters, member, source, file, line)`` by full name, without arity and type arguments. What is from ``source`` comes before metadata, then
    the overload with as many parameters, then the first by file, line and member. The file and line of the trace win over those of the
    symbol. ``status`` is source, metadata or unresolved; ``origin`` says what the compiler had made of the name.
    """
    asked = frames.where("kind = 'frame'").select("trace_id", "position", "symbol", "origin", "parameters", F.col("file").alias("own_file"), F.col("line").alias("own_line"))
    known = symbols.where("name is not null").select(F.col("name").alias("symbol"), F.col("parameters").alias("has"), "member", F.coalesce("source", F.lit(False)).alias("source"), "file", "line")
    # a choice depends on the number of parameters alone, so the symbols are ranked by themselves and frames are worked out once
    place = F.struct("file", "line", "member", "source")
    overloads = known.groupBy("symbol", "source", "has").agg(F.min(place).alias("c"))
    levels = overloads.groupBy("symbol", "source").agg(F.min("c").alias("other"), F.collect_list(F.struct("has", "c")).alias("fits"))
    chosen = levels.groupBy("symbol").agg(F.max_by(F.struct("other", "fits"), "source").alias("best"))
    met = asked.join(chosen, "symbol", "left").withColumn("fits", F.get(F.filter("best.fits", lambda x: x["has"].eqNullSafe(F.col("parameters"))), F.lit(0)))
    met = met.withColumn("c", F.coalesce("fits.c", "best.other"))
    status = F.when(F.col("c").isNull(), "unresolved").when(F.col("c.source"), "source").otherwise("metadata")
    return met.select("trace_id", "position", "symbol", F.col("c.member").alias("member"), "origin", status.alias("status"), F.coalesce("own_file", "c.file").alias("file"), F.coalesce("own_line", "c.line").alias("line"))
