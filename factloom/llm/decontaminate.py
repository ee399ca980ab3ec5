"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed once, shard by shard: for every term of a shard's documents its positions, delta-coded and
packed. The index knows nothing of a benchmark, so any number of benchmarks, or blocks of a large one, can be
held against it. A test window is looked up from its rarest term (by postings in the whole corpus), in
those shards that have it: that term's positions, less its offset, are intersected with the next rarest
term's, and so on; what is left are exact places. For proximity, consecutive windows of each item are looked up from
their two rarest terms, and most of their terms must stand within a few words of their places. Shards
hold whole documents, so no posting crosses the network, and a passage that very many documents share
is spread like the documents are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import cut, small_batches

#: Bytes of test texts in one block; the look-up takes one block at a time, so what each task is sent, and the driver holds, is bounded.
BLOCK_BYTES = 4 << 20
#: Bytes of text in a shard, but for longer documents.
SHARD_BYTES = 4 << 20
#: Proximity: this share of a window's terms within so many words of where they would stand.
NEAR_SHARE = 0.7
NEAR_SLOP = 2
#: Candidate places that are looked at together.
_CHUNK = 1 << 20

_INDEX = "shard long, ids binary, first binary, terms binary, counts binary, positions binary"
_LISTS = {"items": "string", "hit_from": "int", "hit_to": "int", "near_items": "string", "near_from": "int"}
_FOUND = "shard long, row int, doc_id long, n_words long, " + ", ".join(f"{n} array<{t}>" for n, t in _LISTS.items())
_DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long, " + ", ".join(f"{n} array<{t}>" for n, t in _LISTS.items())


@dataclass
class Plan:
    """Distinct windows of some items: term numbers (padded with -1) and lengths; window w is of items ``names[item[first[w]:first[w + 1]]]``; ``apart``: windows for proximity."""

    terms: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    item: np.ndarray
    names: list[str]
    apart: np.ndarray


def plan(item_ids: list[str], texts: list[str], window: int) -> Plan:
    """The windows of some items; an item of fewer words, but not none, is one window."""
    block = W.split(pa.array(texts, pa.large_string()), W.ALNUM, fold=True)
    terms, number = np.unique(block.hash, return_inverse=True)
    names = sorted(set(item_ids))
    of = np.searchsorted(np.array(names, dtype=object), np.array(item_ids, dtype=object)) if names else np.empty(0, np.int64)
    size = np.diff(block.first)
    n = np.where(size >= window, size - window + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(len(texts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(size[text], window)
    place = block.first[:-1][text][:, None] + k[:, None] + np.arange(window)
    inside = np.arange(window) < length[:, None]
    rows = np.where(inside, number[np.minimum(place, max(len(number) - 1, 0))] if len(number) else 0, -1).astype(np.int32)
    windows, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.empty(0, np.int64))
    apart = np.unique(which[k % window == 0])
    pairs = np.unique(which.astype(np.int64).ravel() * max(len(names), 1) + of[text])
    first = np.searchsorted(pairs, np.arange(len(windows) + 1) * max(len(names), 1))
    return Plan(terms, windows, (windows >= 0).sum(axis=1), first, (pairs % max(len(names), 1)).astype(np.int32), names, apart)


def _indexer(gap: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("decontaminate")
        context = TaskContext.get()
        shard = (context.partitionId() if context else 0) << 32
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in W.pieces(batch, "text", SHARD_BYTES):
                block = W.split(part.column(1), W.ALNUM, fold=True)
                order = np.argsort(block.hash, kind="stable")
                ordered = block.hash[order]
                head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)
                counts = np.diff(np.append(head, len(ordered))).astype(np.int32)
                # documents stand a gap apart, so that no match runs over a document's end
                position = order + block.row_of_word()[order] * gap
                delta = np.diff(position, prepend=0)
                delta[head] = position[head]
                ids = part.column(0)
                named = np.asarray(ids.fill_null(0)).astype(np.int64)
                valid = np.packbits(np.asarray(ids.is_valid()))
                row = [named.tobytes() + valid.tobytes(), block.first.tobytes(), ordered[head].tobytes(), *(squeeze.compress(x.astype(np.int32).tobytes()) for x in (counts, delta))]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=["shard", "ids", "first", "terms", "counts", "positions"])
                shard += 1

    return index


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 64) -> DataFrame:
    """The positional index of ``docs``, written: one row for each shard, with its rows' ids and sizes and all its terms' postings.

    Benchmarks whose windows are shorter than ``gap`` by twice the slop can be held against it.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cut(docs.mapInArrow(_indexer(gap), _INDEX))


def _numbers(counts: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.int32)


def _meet(known: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ``terms`` of the values that sorted ``known`` has too, and their places there."""
    if not len(known) or not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(terms, known), len(terms) - 1)
    both = np.flatnonzero(terms[at] == known)
    return at[both], both


def _frequencies(shared):
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("decontaminate")
        known = shared.value.terms
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, mine = _meet(known, np.frombuffer(terms, np.uint64))
                total[mine] += _numbers(counts)[at]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["term", "n"])

    return frequencies


def _by_rarity(the: Plan, counts: np.ndarray) -> np.ndarray:
    """Each window's offsets, from its rarest term on; padding last."""
    weight = np.append(counts, np.iinfo(np.int64).max)[the.windows]
    return np.argsort(weight, axis=1, kind="stable").astype(np.int8)


class _Shard:
    """A shard's postings of the terms that a plan has: ``at[position]`` is the term's number there, -1 if none."""

    def __init__(self, row: dict, terms: np.ndarray, gap: int) -> None:
        self.first = np.frombuffer(row["first"], np.int64)
        self.rows = len(self.first) - 1
        self.ids = np.frombuffer(row["ids"], np.int64, count=self.rows)
        self.valid = np.unpackbits(np.frombuffer(row["ids"], np.uint8, offset=8 * self.rows), count=self.rows).astype(bool)
        self.base = self.first[:-1] + np.arange(self.rows) * gap
        at, mine = _meet(terms, np.frombuffer(row["terms"], np.uint64))
        size = _numbers(row["counts"]).astype(np.int64)
        ends = np.cumsum(size)
        begin = ends - size
        total = np.cumsum(_numbers(row["positions"]), dtype=np.int64)
        before = np.where(begin > 0, total[np.maximum(begin - 1, 0)], 0) if len(begin) else begin
        self.begin, self.n = np.zeros(len(terms) + 1, np.int64), np.zeros(len(terms) + 1, np.int64)
        self.begin[mine], self.n[mine] = begin[at], size[at]
        self.positions = total - np.repeat(before, size)
        self.at = np.full(int(self.first[-1]) + (self.rows + 1) * gap, -1, dtype=np.int32)
        wanted = np.zeros(len(size), dtype=bool)
        wanted[at] = True
        number = np.zeros(len(size), dtype=np.int32)
        number[at] = mine
        keep = np.repeat(wanted, size)
        self.at[self.positions[keep]] = np.repeat(number, size)[keep]

    def starts(self, windows: np.ndarray, which: np.ndarray, offset: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) for every posting of the term at ``offset`` of each window in ``which``, some at a time."""
        term = windows[which, offset]
        n = self.n[term]
        which, offset, term, n = (x[n > 0] for x in (which, offset, term, n))
        ends = np.cumsum(n)
        low = 0
        while low < len(which):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _CHUNK, side="right")))
            count = n[low:high]
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            place = self.positions[np.repeat(self.begin[term[low:high]], count) + step] - np.repeat(offset[low:high], count)
            of = np.repeat(which[low:high], count)
            yield of[place >= 0], place[place >= 0]
            low = high

    def exact(self, the: Plan, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (window, start) of exact places: postings intersected from the rarest term on."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        able = np.flatnonzero((self.n[np.where(the.windows < 0, the.windows[:, :1], the.windows)] > 0).all(axis=1)) if len(the.windows) else np.empty(0, np.int64)
        for of, start in self.starts(the.windows, able, rank[able, 0].astype(np.int64)):
            for k in range(1, the.windows.shape[1]):
                offset = rank[of, k].astype(np.int64)
                term = the.windows[of, offset]
                good = (term < 0) | (self.at[np.minimum(start + offset, len(self.at) - 1)] == term)
                of, start = of[good], start[good]
                if not len(of):
                    break
            out.append((of, start))
        return tuple(np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in (0, 1))

    def near(self, the: Plan, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where ``NEAR_SHARE`` of a window's terms stand within ``NEAR_SLOP`` words of theirs, one of its two rarest in place."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for anchor in range(min(2, the.windows.shape[1] if len(the.windows) else 0)):
            some = the.apart[the.lengths[the.apart] > anchor]
            for of, start in self.starts(the.windows, some, rank[some, anchor].astype(np.int64)):
                need = np.ceil(the.lengths[of] * NEAR_SHARE)
                met, seen = np.zeros(len(of), dtype=np.int64), 0
                for k in range(the.windows.shape[1]):
                    offset = rank[of, k].astype(np.int64)
                    term = the.windows[of, offset]
                    place = start + offset
                    close = np.zeros(len(of), dtype=bool)
                    for slop in range(-NEAR_SLOP, NEAR_SLOP + 1):
                        close |= self.at[np.clip(place + slop, 0, len(self.at) - 1)] == term
                    met += close & (term >= 0)
                    seen += 1
                    left = np.maximum(the.lengths[of] - seen, 0)
                    good = met + left >= need
                    of, start, need, met = of[good], start[good], need[good], met[good]
                    if not len(of):
                        break
                out.append((of, start))
        return tuple(np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in (0, 1))


def _by_row(row: np.ndarray, of: np.ndarray, the: Plan, rows: int) -> list[list[str]]:
    """Sorted names of the items of the windows found in each row."""
    n = the.first[of + 1] - the.first[of]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    item = the.item[np.repeat(the.first[of], n) + step]
    cell = np.unique(np.repeat(row, n).astype(np.int64) * max(len(the.names), 1) + item)
    cuts = np.searchsorted(cell, np.arange(rows + 1) * max(len(the.names), 1))
    return [[the.names[x] for x in (cell[a:b] % max(len(the.names), 1)).tolist()] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _matcher(shared, gap: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("decontaminate")
        the, rank = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                shard = _Shard(r, the.terms, gap)
                rows = shard.rows
                of, start = shard.exact(the, rank)
                edge = np.zeros(len(shard.at) + 1, dtype=np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + the.lengths[of], -1)
                turn = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
                up, down = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                cuts = np.searchsorted(np.searchsorted(shard.base, up, side="right") - 1, np.arange(rows + 1))
                spans = [(up[a:b] - shard.base[k], down[a:b] - shard.base[k]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                items = _by_row(np.searchsorted(shard.base, start, side="right") - 1, of, the, rows)
                of, start = shard.near(the, rank)
                # a place may lie up to the slop outside of its document: it counts for the one that holds its middle
                row = np.searchsorted(shard.base, np.maximum(start + the.lengths[of] // 2, 0), side="right") - 1
                near = _by_row(row, of, the, rows)
                cell = np.unique(np.stack([row, np.maximum(start - shard.base[row], 0)]), axis=1) if len(row) else np.empty((2, 0), np.int64)
                cuts = np.searchsorted(cell[0], np.arange(rows + 1))
                places = [cell[1, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                ints = [[x[j].astype(np.int32) for x in spans] for j in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, r["shard"])),
                        pa.array(np.arange(rows, dtype=np.int32)),
                        pa.array(shard.ids, mask=~shard.valid),
                        pa.array(np.diff(shard.first)),
                        pa.array(items, pa.list_(pa.string())),
                        *(pa.array(x, pa.list_(pa.int32())) for x in ints),
                        pa.array(near, pa.list_(pa.string())),
                        pa.array([x.astype(np.int32) for x in places], pa.list_(pa.int32())),
                    ],
                    names=["shard", "row", "doc_id", "n_words", *_LISTS],
                )

    return match


def _whole(match):
    """Of one block, rows are finished where they are found, in the same Python process."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in match(batches):
            yield from _digest([batch])

    return digest


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite spans, count, and name items; lists may come from several blocks."""
    for batch in batches:
        got = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        rows = []
        for a, b, items, near, places in zip(got["hit_from"], got["hit_to"], got["items"], got["near_items"], got["near_from"], strict=True):
            spans: list[list[int]] = []
            for x, y in sorted(zip(a, b, strict=True)):
                if spans and x <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], y)
                else:
                    spans.append([x, y])
            names, close = sorted(set(items)), sorted(set(near))
            digest = hashlib.sha256(",".join(names).encode()).hexdigest()
            rows.append((sum(y - x for x, y in spans), len(names), digest, bool(spans), len(close), names, [x for x, _ in spans], [y for _, y in spans], close, sorted(set(places))))
        text, number = pa.list_(pa.string()), pa.list_(pa.int32())
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), text, number, number, text, number]
        names = ["n_hit", "n_items", "items_sha256", "contaminated", "n_near", *_LISTS]
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", "n_words", *names])


def search(index: DataFrame, benchmark: DataFrame, window: int = 10, item_col: str = "item_id", item_text_col: str = "text", gap: int = 64) -> DataFrame:
    """What ``decontaminate`` returns, from the index of ``build_index``."""
    if window + 2 * NEAR_SLOP > gap:
        raise ValueError("the index's gap is too small for the window")
    spark = index.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = []
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        the = plan([r["item"] for r in some], [r["text"] for r in some], window)
        del some
        terms = spark.sparkContext.broadcast(Plan(the.terms, the.windows[:0], the.lengths[:0], the.first[:1], the.item[:0], [], the.apart[:0]))
        counts = np.zeros(len(the.terms), dtype=np.int64)
        for r in index.select("terms", "counts").mapInArrow(_frequencies(terms), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["term"]] = r["n"]
        shared = spark.sparkContext.broadcast((the, _by_rarity(the, counts)))
        match = _matcher(shared, gap)
        found.append(cut(index.mapInArrow(_whole(match) if blocks == 1 else match, _DIGEST if blocks == 1 else _FOUND)))
        for x in (terms, shared):
            x.destroy()
    if blocks == 1:
        return found[0]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    every = every.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in _LISTS))
    return every.mapInArrow(_digest, _DIGEST)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items, hit_from, hit_to, near_items, near_from)``, row by row.

    A document's word inside any occurrence of ``window`` consecutive item words is hit; an item of
    fewer words is one window. ``near_items`` are the items of which some window of consecutive ones stands nearly: ``NEAR_SHARE`` of its terms
    within ``NEAR_SLOP`` words of their places; ``near_from`` are the places, in words (proximity; this decides nothing).

    Null and empty texts have no words. Items without an id are left out; items that repeat an id are
    one. Rows may repeat and ids may be null; other columns are ignored. An empty benchmark hits nothing, an empty table gives an empty result.
    """
    gap = max(64, window + 2 * NEAR_SLOP)
    return search(build_index(docs, id_col, text_col, gap), benchmark, window, item_col, item_text_col, gap)
