"""Ranked lexical search over shards of compressed postings, document at a time.

Documents are indexed where they are read, in shards of some MB of whole texts: doc_ids in order, and for every term the
ordinals of the documents that hold it, as compressed differences, with its occurrences. A block of items is sent to
every task. A task takes its shards one after the other; in each, the postings of an item's terms are merged by a heap,
document by document in order of doc_id, and one heap of the best ``k`` per item, keyed by score and then doc_id, goes on from
shard to shard. Terms whose bounds together cannot reach the worst kept score are not merged but looked
up in the documents that the other terms bring; that leaves out no document that could be kept. The tasks' lists are merged
in two steps.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush, heapreplace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .packed import gathered, pack, row, unpack
from .scratch import cut_in_loop, small_batches

#: Bytes of text in a shard, but for longer documents.
SHARD_BYTES = 8 << 20
#: Bytes of items' texts that are looked up together; what each task is sent and the driver holds is bounded by it.
BLOCK_BYTES = 4 << 20
#: Postings that are compressed together; more only if one term has more.
CHUNK = 4096
#: Tasks' lists are merged in so many groups for each item, then these.
GROUPS = 64

_INDEX = "shard long, n_docs long, n_terms long, ids binary, sizes binary, terms binary, counts binary, edges binary, postings array<binary>"
_FOUND = "item long, doc_id long, score long, task long"


def _indexer(shard_bytes: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("lexical_search")
        context = TaskContext.get()
        shard = (context.partitionId() if context else 0) << 32
        for table in gathered(batches, shard_bytes):
            block = W.split(table.column(1), W.ALNUM, fold=True)
            size = np.diff(block.first)
            doc = np.asarray(table.column(0).combine_chunks()).astype(np.int64)
            order = np.argsort(doc, kind="stable")
            order = order[size[order] > 0]
            ordinal = np.zeros(len(doc), dtype=np.int64)
            ordinal[order] = np.arange(len(order))
            terms, number = np.unique(block.hash, return_inverse=True)
            place, often = np.unique(number * max(len(order), 1) + ordinal[block.row_of_word()], return_counts=True)
            term, at = place // max(len(order), 1), place % max(len(order), 1)
            counts = np.bincount(term, minlength=len(terms)).astype(np.int64)
            begin = np.cumsum(counts) - counts
            step = np.diff(at, prepend=0)
            step[begin] = at[begin]
            edges = np.flatnonzero(np.diff(begin // CHUNK, prepend=-1))
            postings = [pack(step[i:j], often[i:j]) for i, j in zip(begin[edges], np.append(begin[edges[1:]], len(place)), strict=True)]
            yield row(_INDEX, shard, len(order), int(size.sum()), doc[order].tobytes(), pack(size[order]), terms.tobytes(), pack(counts), edges.tobytes(), postings)
            shard += 1

    return index


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``docs``, written as Parquet, one row for each shard; it knows of no item."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return cut_in_loop(rows.mapInArrow(_indexer(shard_bytes), _INDEX))


def _meet(known: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ``known`` of the values that sorted ``terms`` has too, and their places there."""
    if not len(known) or not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(terms, known), len(terms) - 1)
    mine = np.flatnonzero(terms[at] == known)
    return mine, at[mine]


@dataclass
class _Query:
    """Distinct terms of a block of items, in order of hashes, and each item's places in them."""

    terms: np.ndarray
    items: list[list[int]]


def _frequencies(shared):
    """In how many documents of a task's shards each term of a block stands."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("lexical_search")
        known = shared.value.terms
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine, at = _meet(known, np.frombuffer(terms, np.uint64))
                total[mine] += unpack(counts)[0][at]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "n"])

    return frequencies


def _length_part(size: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """``100 - 90 + ((90 * n * N) div L)``; in Python's integers where 64 bits would not do."""
    if len(size) and 90 * int(size.max()) * docs < 2**63:
        return 10 + 90 * size * docs // terms
    return np.array([10 + 90 * int(n) * docs // terms for n in size], dtype=np.int64)


@dataclass
class _List:
    """A term's postings in a shard: ordinals in order, what each adds to a score, and the most that any adds."""

    docs: list[int]
    adds: list[int]
    bound: int


def _lists(shard: dict, query: _Query, weights: np.ndarray, docs: int, terms: int) -> dict[int, _List]:
    """The shard's postings of a block's terms that weigh something; only chunks that hold one are decompressed."""
    mine, at = _meet(query.terms, np.frombuffer(shard["terms"], np.uint64))
    mine, at = mine[weights[mine] > 0], at[weights[mine] > 0]
    counts, edges = unpack(shard["counts"])[0], np.frombuffer(shard["edges"], np.int64)
    begin = np.cumsum(counts) - counts
    part = _length_part(unpack(shard["sizes"])[0], docs, terms)
    out, chunk, open_chunk = {}, -1, None
    for term, place in zip(mine.tolist(), at.tolist(), strict=True):
        k = int(np.searchsorted(edges, place, side="right")) - 1
        if k != chunk:
            chunk, open_chunk = k, unpack(shard["postings"][k])
        low = int(begin[place] - begin[edges[k]])
        step, often = (x[low : low + int(counts[place])] for x in open_chunk)
        where = np.cumsum(step)
        adds = int(weights[term]) * (1_000_000_000 * often // (1000 * often + 8 * part[where]))
        out[term] = _List(where.tolist(), adds.tolist(), int(adds.max()))
    return out


def merge(lists: list[_List], ids: list[int], best: list[tuple[int, int]], k: int) -> None:
    """Take a shard's documents in order and keep the ``k`` best in ``best``, a heap of (score, -doc_id)."""
    lists = sorted((x for x in lists if x.bound > 0), key=lambda x: x.bound)
    upto = list(accumulate(x.bound for x in lists))
    cursor = [0] * len(lists)
    first = 0  # lists before this one cannot bring a document into ``best`` by themselves
    while first < len(lists) and len(best) == k and upto[first] < best[0][0]:
        first += 1
    heap = [(lists[j].docs[0], j) for j in range(first, len(lists))]
    heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            j = heap[0][1]
            at = cursor[j]
            score += lists[j].adds[at]
            cursor[j] = at + 1
            if at + 1 < len(lists[j].docs):
                heapreplace(heap, (lists[j].docs[at + 1], j))
            else:
                heappop(heap)
        for j in range(first - 1, -1, -1):
            if score + upto[j] < best[0][0]:
                break
            cursor[j] = at = bisect_left(lists[j].docs, doc, cursor[j])
            if at < len(lists[j].docs) and lists[j].docs[at] == doc:
                score += lists[j].adds[at]
        entry = (score, -ids[doc])
        if score <= 0 or (len(best) == k and entry <= best[0]):
            continue
        if len(best) < k:
            heappush(best, entry)
        else:
            heapreplace(best, entry)
        before = first
        while first < len(lists) and len(best) == k and upto[first] < best[0][0]:
            first += 1
        if first > before:
            heap = [x for x in heap if x[1] >= first]
            heapify(heap)


def _searcher(shared, k: int, docs: int, terms: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("lexical_search")
        query, weights = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in query.items]
        for batch in batches:
            for shard in batch.to_pylist():
                ids = np.frombuffer(shard["ids"], np.int64).tolist()
                lists = _lists(shard, query, weights, docs, terms)
                for item, kept in zip(query.items, best, strict=True):
                    merge([lists[t] for t in item if t in lists], ids, kept, k)
        context = TaskContext.get()
        out = [(i, -x, s) for i, kept in enumerate(best) for s, x in kept]
        task = np.full(len(out), context.partitionId() if context else 0)
        yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in out], pa.int64()) for c in (0, 1, 2)), pa.array(task, pa.int64())], names=["item", "doc_id", "score", "task"])

    return search


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item the ``k`` documents with the highest scores above 0, equal scores by ascending doc_id.

    Terms are runs of letters, digits and bytes from 0x80 up, A-Z lower-cased. ``N``, ``L``, ``df`` and so the weights are of
    the whole index. Items of one id are one item, with the terms of all; items without an id, and items or documents without a term, give no
    rows. Documents without an id are left out; those that share one are documents of their own. Texts of any length are taken whole. Other columns are ignored; ``item_id`` keeps its type.
    """
    spark = index.sparkSession
    docs, terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = asked.schema["item_id"].dataType.simpleString()
    found = []
    for b in range(blocks if docs else 0):
        some = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        split = W.split(pa.array([r["text"] for r in some], pa.large_string()), W.ALNUM, fold=True)
        known, number = np.unique(split.hash, return_inverse=True)
        of: dict = {}
        for r, low, high in zip(some, split.first[:-1], split.first[1:], strict=True):
            of.setdefault(r["item_id"], set()).update(number[low:high].tolist())
        names = list(of)
        query = _Query(known, [sorted(x) for x in of.values()])
        shared = spark.sparkContext.broadcast(query)
        weights = np.full(len(known), -1, dtype=np.int64)
        for r in index.select("terms", "counts").mapInArrow(_frequencies(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
            weights[r["term"]] = math.floor(1000 * math.log((2 * docs + 2) / (2 * r["n"] + 1)))
        told = spark.sparkContext.broadcast((query, weights))
        rows = index.select("ids", "sizes", "terms", "counts", "edges", "postings").mapInArrow(_searcher(told, k, docs, terms), _FOUND)
        near = Window.partitionBy("item", F.pmod("task", F.lit(GROUPS))).orderBy(F.desc("score"), "doc_id")
        rows = rows.withColumn("near", F.row_number().over(near)).where(F.col("near") <= k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")).cast("int")
        rows = rows.select("item", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {kind}")
        found.append(cut_in_loop(rows.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")))
        shared.destroy()
        told.destroy()
    if not found:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``search`` in the index of ``docs``."""
    return search(build_index(docs), items, k)
