"""Deletion of repeated line runs with a suffix array built by prefix doubling, DataFrame functions only.

Every line of every document starts a suffix of its document's sequence of line ids. A level k holds the
suffixes whose first k lines stand elsewhere too, each with a rank: ranks are equal where the k lines
are, and ordered as the lines' ids are, so a level is the suffix array's part of intervals whose
longest common prefix is k or more. Ranks of 2k sort pairs of ranks of k, ranks of any m between sort
pairs of overlapping ones; line ids have 128 bits, and from there on ranks are exact. A suffix whose
pair stands once has its place, and leaves. Doubling ends when all have, or at a given depth.

In an interval the suffix of the smallest (row, line) is the first copy. Each later copy belongs to the
deepest interval in which it is one; later copies whose lines and first copies follow on each other are
one maximal repeated run, as long as its intervals reach. Runs of later copies are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut_and_sum, cut_in_loop, numbered, salted_join

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def _split(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def lines_of(rows: DataFrame, lone_words: int | None = None) -> DataFrame:
    """``(row, line, a, b, lone)``: the lines of each text, numbered from 0, with an id of 128 bits, and whether one has more words than ``lone_words``."""
    more = F.lit(False) if lone_words is None else None
    ids = F.transform(
        _split("text"),
        lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (x.rlike(rf"\A{_SPACE}*+(?:{_WORD}++{_SPACE}++){{{lone_words}}}{_WORD}") if more is None else more).alias("lone")),
    )
    return rows.select("row", F.posexplode(ids).alias("line", "x")).select("row", "line", "x.*")


def _level(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """Of suffixes with a prefix named by ``keys``, those in an interval of several: ``(row, line, rank, lone, first)``, ``first`` its smallest (row, line).

    Intervals are counted in part before the shuffle; a range sort of the distinct prefixes ranks them; the suffixes
    of one that very many share are dealt to several tasks where they meet its rank.
    """
    found = suffixes.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("row", "line")).alias("first"))
    order = found.where("n > 1").repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranked, total, most = cut_and_sum(order.withColumn("rank", F.monotonically_increasing_id()), "n")
    return cut_in_loop(salted_join(suffixes, ranked, keys, "n", total, most).select("row", "line", "rank", "lone", "first"))


def _paired(level: DataFrame, ahead: int) -> DataFrame:
    """``(row, line, a, b, lone)``: each suffix's rank and that of the one ``ahead`` lines further on, where both are in the level."""
    both = F.array(
        F.struct("line", F.col("rank").alias("a"), F.lit(None).cast("long").alias("b"), F.col("lone")),
        F.struct((F.col("line") - ahead).alias("line"), F.lit(None).cast("long").alias("a"), F.col("rank").alias("b"), F.lit(None).cast("boolean").alias("lone")),
    )
    each = level.select("row", F.explode(both).alias("x")).select("row", "x.*").where("line >= 0")
    met = each.groupBy("row", "line").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("lone").alias("lone"))
    return cut_in_loop(met.where("a is not null and b is not null"))


def suffix_levels(lines: DataFrame, also: int = 1, depth: int | None = None) -> Iterator[tuple[int, DataFrame]]:
    """``(k, (row, line, rank, lone, first))`` for k = 1, 2, 4, ... and ``also``, in order, while any suffix is left and, if given, k is no more than ``depth``."""
    k, level = 1, _level(lines, ["a", "b"])
    while not level.isEmpty():
        yield k, level
        if k < also < 2 * k:
            between = _level(_paired(level, also - k), ["a", "b"])
            if not between.isEmpty():
                yield also, between
        if depth is not None and 2 * k > depth:
            return
        level = _level(_paired(level, k), ["a", "b"])
        k *= 2


def _runs(copies: DataFrame) -> DataFrame:
    """``(row, start, stop, of_row, of_line)``: maximal runs of later copies ``(row, line, k, first)``, each of which covers ``k`` lines from ``line`` on.

    Copies that follow on each other as their first copies do are one run; a run inside another one is left out.
    """
    order = Window.partitionBy("row").orderBy("line")
    before = F.lag(F.struct("line", F.col("first.row").alias("of_row"), F.col("first.line").alias("of_line"))).over(order)
    follows = (before["line"] == F.col("line") - 1) & (before["of_row"] == F.col("first.row")) & (before["of_line"] == F.col("first.line") - 1)
    heads = copies.withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("int"))
    runs = heads.withColumn("run", F.sum("new").over(order)).groupBy("row", "run")
    runs = runs.agg(F.min("line").alias("start"), F.max(F.col("line") + F.col("k")).alias("stop"), F.min("first").alias("first"))
    reach = F.max("stop").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("reach", F.coalesce(reach, F.lit(0))).where("stop > reach").select("row", "start", "stop", F.col("first.row").alias("of_row"), F.col("first.line").alias("of_line"))


def _empty(like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)


def _repeats(rows: DataFrame, min_lines: int, lone_words: int | None, depth: int | None) -> tuple[DataFrame, DataFrame]:
    """Runs of later copies, and ``(row, k)`` for each level in which a row has suffixes."""
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    lone = _empty(rows, "row long, start int, stop int, of_row long, of_line int")
    deep, depths = [_empty(rows, "row long, line int, k int, first struct<row:long,line:int>")], [_empty(rows, "row long, k int")]
    for k, shared in suffix_levels(lines_of(rows, lone_words), also=min_lines, depth=depth):
        if k & (k - 1) == 0:
            depths.append(shared.select("row", F.lit(k).alias("k")))
        copies = shared.where(F.struct("row", "line") > F.col("first"))
        if k >= min_lines:
            deep.append(copies.select("row", "line", F.lit(k).alias("k"), "first"))
        if k == 1 and lone_words is not None:
            lone = copies.where("lone").select("row", F.col("line").alias("start"), (F.col("line") + 1).alias("stop"), F.col("first.row").alias("of_row"), F.col("first.line").alias("of_line"))
    deepest = reduce(DataFrame.unionByName, deep)
    if len(deep) > 2:
        deepest = deepest.groupBy("row", "line").agg(F.max(F.struct("k", "first")).alias("x")).select("row", "line", "x.k", "x.first")
    runs = _runs(deepest).withColumn("alone", F.lit(False)).unionByName(lone.withColumn("alone", F.lit(True)))
    return runs, reduce(DataFrame.unionByName, depths)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, lone_words: int | None = None) -> DataFrame:
    """``(doc_id, start, stop, of_doc, of_line)``: maximal runs of lines, from ``start`` to before ``stop``, that are a later copy of lines from ``of_line`` on of document ``of_doc``.

    Lines count from 0. Rows are told apart as in ``line_dedup``.
    """
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text")
    names = rows.select("row", "doc_id")
    runs, _ = _repeats(rows, min_lines, lone_words, None)
    return runs.join(names, "row").join(names.select(F.col("row").alias("of_row"), F.col("doc_id").alias("of_doc")), "of_row").select("doc_id", "start", "stop", "of_doc", "of_line")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, carry: list[str] = (), lone_words: int | None = None, depth: int | None = None) -> DataFrame:
    """``(doc_id, text, n_lines, n_removed, n_runs, longest_run, shared_run)`` and the columns named in ``carry``: each row's text without later copies of runs of ``min_lines`` lines or more.

    With ``lone_words``, a line of more words than that is a run by itself. Lines end at a line feed. Runs lie within one document; they may repeat within it or in another.
    The copy of the smallest (document, line) stays, but for lines that a later copy overlaps. Kept lines are joined by line feeds; a text of
    which nothing is kept is empty. ``n_runs`` counts the row's maximal runs of ``min_lines`` or more that were deleted, ``longest_run`` is the
    most lines of one. ``shared_run`` is the largest power of two for which a run of so many of its lines stands
    twice, first copies included, 0 for none. With ``depth`` doubling ends there: the same lines go, but runs and ``shared_run`` are told
    only from intervals so deep.

    A null text stays null, with 0 lines; an empty one is one empty line. Rows that repeat an id, and rows without one, are documents of their own,
    in order of id and then of a hash of the text, those without an id last; a repeated row is a later copy of the first. An empty table gives an empty result. Other columns are ignored.
    """
    if depth is not None:
        depth = max(depth, min_lines)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    rows = numbered(rows, "doc_id", "text")
    runs, depths = _repeats(rows.select("row", "text"), min_lines, lone_words, depth)
    # runs may overlap: each adds to the row's mask what no earlier one has covered, 0 for a line that stays, 1 for one that goes
    covered = F.coalesce(F.max("stop").over(Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gone = runs.withColumn("covered", covered).withColumn("fresh", F.greatest(F.col("stop") - F.greatest("start", "covered"), F.lit(0)))
    piece = F.concat(F.repeat(F.lit("0"), F.greatest(F.col("start") - F.col("covered"), F.lit(0))), F.repeat(F.lit("1"), F.col("fresh")))
    masks = (
        gone.withColumn("piece", piece)
        .groupBy("row")
        .agg(
            F.sort_array(F.collect_list(F.struct("start", "stop", "piece"))).alias("pieces"),
            F.sum("fresh").alias("n_removed"),
            F.count_if(~F.col("alone")).alias("n_runs"),
            F.max(F.when(~F.col("alone"), F.col("stop") - F.col("start"))).alias("longest_run"),
        )
        .select("row", "n_removed", "n_runs", "longest_run", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").cast("binary").alias("mask"))
    )
    marks = depths.groupBy("row").agg(F.max("k").alias("depth")).join(masks, "row", "left")
    kept = F.filter(_split("text"), lambda x, i: F.substring(F.col("mask"), i + 1, F.lit(1)) != F.lit(b"1"))
    joined = rows.join(marks, "row", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("mask").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_runs", "longest_run")),
        F.coalesce("depth", F.lit(0)).alias("shared_run"),
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)),
    )
