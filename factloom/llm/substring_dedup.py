"""Exact substring deduplication by level-wise doubling.

A window of W words is removed where its words also start in a document of a smaller id. Finding
these by shipping every window would move more than the texts. Instead lengths double up to W
(for 13: 4, 7, 13; each window is covered by two of half its length), and only what repeats at one
length is extended to the next:

* Level 1. Every W-window names one place: its smallest short window by hash. Equal windows name
  equal places, so all copies agree, and only about a fifth of all places are named. Their 32-bit
  fingerprints, dealt by further hash bits, tell which short windows occur more than once.
* Next levels. The windows around surviving places are fingerprinted and dealt the same way.
* Last level. Whole W-windows that survived go out as 64-bit hashes with the smallest id that each
  batch has for them; what comes back is whether another batch has a smaller one.

A false survivor of an early level only costs the next one; none is lost. Texts are packed into
batches of about 4 MB that stay where they are; each batch sends a distinct fingerprint once, however
many documents share it, and gets one bit for it. A passage that a third of all documents share is
therefore one fingerprint for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import cut, cut_by, shuffle_width, small_batches

BATCH_BYTES = 4 << 20
#: Text in a partition of batches, about; there are at least as many partitions as the session gives a shuffle.
PARTITION_BYTES = 64 << 20
_U = np.uint64
_BATCH = "part long, ids binary, at binary, texts binary"
_SENT = "part long, level int, bucket long, keys binary, owners binary"
_BITS = "part long, level int, bucket long, n int, bits binary"


def lengths(window: int) -> list[int]:
    """The levels' lengths, each at most twice the one before."""
    chain = [window]
    while chain[0] > 4:
        chain.insert(0, -(-chain[0] // 2))
    return chain


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    W.tidy("substring_dedup")
    context = TaskContext.get()
    part = (context.partitionId() if context else 0) << 32
    squeeze = zstandard.ZstdCompressor(level=1)
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    texts: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal part, held
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        row = [pa.array([part], pa.int64()), *(pa.array([x], pa.binary()) for x in (np.concatenate(ids).tobytes(), at.tobytes(), squeeze.compress(b"".join(texts))))]
        part, held = part + 1, 0
        ids.clear(), sizes.clear(), texts.clear()
        return pa.RecordBatch.from_arrays(row, names=["part", "ids", "at", "texts"])

    for batch in batches:
        for piece in W.pieces(batch, "text"):
            data, at, _ = W.buffers(piece.column(1))
            ids.append(np.asarray(piece.column(0)).astype(np.int64))
            sizes.append(np.diff(at))
            texts.append(data.tobytes())
            held += len(data)
            if held >= BATCH_BYTES:
                yield flush()
    if ids:
        yield flush()


class _Batch:
    """One batch's windows, level by level, as far as the bits that came back allow."""

    def __init__(self, row: pd.Series, window: int) -> None:
        self.chain = lengths(window)
        self.ids = np.frombuffer(row.ids, dtype=np.int64)
        self.at = np.frombuffer(row["at"], dtype=np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(row.texts)
        column = pa.Array.from_buffers(pa.large_binary(), len(self.ids), [None, pa.py_buffer(self.at.tobytes()), pa.py_buffer(self.raw)])
        self.block = W.split(column, W.NOT_SPACE, fold=False)
        n = np.diff(self.block.first)
        enough = np.flatnonzero(n >= window)
        count = n[enough] - window + 1
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        self.row = np.repeat(enough, count)
        self.p = np.arange(total) - np.repeat(ends - count, count) + self.block.first[self.row]
        g = [W.grams(self.block.hash, self.chain[0])]
        for short, long in zip(self.chain, self.chain[1:], strict=False):
            size = max(0, len(self.block.hash) - long + 1)
            g.append(W.pairs(g[-1][:size], g[-1][long - short : long - short + size]))
        self.grams = g
        span = window - self.chain[0] + 1
        if total:
            ahead = np.lib.stride_tricks.sliding_window_view(g[0], span)
            self.place = np.concatenate([ahead[q].argmin(axis=1) for q in np.array_split(self.p, -(-total // 65536))]) + self.p
        else:
            self.place = self.p

    def starts(self, level: int) -> np.ndarray:
        """For every window still in question, where its part of this level's length starts."""
        if level == 0:
            return self.place
        long, window = self.chain[level], self.chain[-1]
        return np.maximum(self.p, np.minimum(self.place, self.p + window - long))

    def narrow(self, level: int, repeated: np.ndarray, places: np.ndarray) -> None:
        """Keep the windows whose part is among the ``repeated`` ones of the sorted ``places``' hashes."""
        keep = repeated[np.searchsorted(places, self.grams[level][self.starts(level)])]
        self.p, self.place, self.row = self.p[keep], self.place[keep], self.row[keep]

    def shared(self, level: int) -> np.ndarray:
        """Which of this level's distinct hashes more than one document of the batch has."""
        h, ids = self.grams[level][self.starts(level)], self.ids[self.row]
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        differs = (h[1:] == h[:-1]) & (ids[1:] != ids[:-1])
        return np.isin(np.unique(h), h[1:][differs])

    def hashes(self, level: int) -> np.ndarray:
        return np.unique(self.grams[level][self.starts(level)])

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """The last level's distinct hashes and the smallest id that has each here."""
        h, ids = self.grams[-1][self.p], self.ids[self.row]
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        head = np.ones(len(h), dtype=bool)
        head[1:] = h[1:] != h[:-1]
        return h[head], ids[head]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def _replay(batch: _Batch, bits: pd.DataFrame, upto: int) -> np.ndarray:
    """Apply what came back for the levels before ``upto``; the last level's flags, if asked for."""
    flags = np.empty(0, dtype=bool)
    for level in range(upto):
        got = bits[bits.level == level].sort_values("bucket")
        flags = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n) for b, n in zip(got.bits, got.n, strict=True)] or [np.empty(0, np.uint8)]).astype(bool)
        if level < len(batch.chain) - 1:
            batch.narrow(level, flags | batch.shared(level), batch.hashes(level))
    return flags


def _sender(window: int, level: int, buckets: int):
    def send(batches: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in batches.iterrows():
            batch = _Batch(row, window)
            _replay(batch, bits, level)
            last = level == len(batch.chain) - 1
            h, owners = batch.owners() if last else (batch.hashes(level), None)
            if len(h):
                bucket = _bucket(h, buckets)
                edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(h)]
                keys = h if last else h.astype(np.uint32)
                out += [(row.part, level, bucket[a], keys[a:b].tobytes(), owners[a:b].tobytes() if last else b"") for a, b in zip(edges, edges[1:], strict=False)]
        return pd.DataFrame(out, columns=["part", "level", "bucket", "keys", "owners"])

    return send


def _judge(sent: pd.DataFrame) -> pd.DataFrame:
    """For each batch's fingerprints in a bucket: has another batch them too (last level: with a smaller id)?"""
    owners = np.frombuffer(b"".join(sent.owners), dtype=np.int64)
    keys = np.frombuffer(b"".join(sent["keys"]), dtype=np.uint64 if len(owners) else np.uint32)
    width = keys.itemsize
    _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
    if len(owners):
        least = np.full(len(count), np.iinfo(np.int64).max)
        np.minimum.at(least, at, owners)
        flags = least[at] < owners
    else:
        flags = count[at] > 1
    sizes = sent["keys"].map(len).to_numpy() // width
    ends = np.cumsum(sizes)
    bits = [np.packbits(flags[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
    return pd.DataFrame({"part": sent.part, "level": sent.level, "bucket": sent.bucket, "n": sizes.astype(np.int32), "bits": bits})


def _finisher(window: int, full: bool):
    def finish(batches: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in batches.iterrows():
            batch = _Batch(row, window)
            elsewhere = _replay(batch, bits, len(batch.chain))
            removed = np.zeros(len(batch.block.start) + 1, dtype=np.int32)
            if len(batch.p):
                h, owner = batch.owners()
                at = np.searchsorted(h, batch.grams[-1][batch.p])
                gone = batch.p[elsewhere[at] | (owner[at] < batch.ids[batch.row])]
                np.add.at(removed, gone, 1)
                np.add.at(removed, gone + window, -1)
            keep = np.cumsum(removed[:-1]) == 0
            for i, first, end, a, b in zip(batch.ids.tolist(), batch.block.first[:-1].tolist(), batch.block.first[1:].tolist(), batch.at[:-1].tolist(), batch.at[1:].tolist(), strict=True):
                words, stay = batch.raw[a:b].split(), keep[first:end]
                n_kept = int(stay.sum())
                text = b" ".join(words if n_kept == len(words) else compress(words, stay.tolist()))
                record = (i, len(words), len(words) - n_kept, hashlib.sha256(text).hexdigest())
                if full:
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~stay, [False]]).astype(np.int8)))
                    record = (*record, text.decode(), edge[::2].tolist(), edge[1::2].tolist())
                out.append(record)
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept", "removed_from", "removed_to"] if full else [])])

    return finish


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, full: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` and, if ``full``, the kept text and the removed word spans.

    Words are runs without white space, unchanged. Every word that is covered by a window of
    ``window`` words that also starts in a document of a smaller id is removed; windows are judged on
    the input. Null, empty and shorter texts have no window. Rows that repeat an id do not count as
    smaller than each other, so they keep what only they share; each gives a row. Rows without an id
    are left out; whole texts count, however long; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    store = cut_by(docs.mapInArrow(_pack, _BATCH), "part", max(shuffle_width(spark), -(-size // PARTITION_BYTES)))
    buckets = min(max(store.count(), 1), 1 << 31)
    held = store.groupBy("part")
    bits = spark.createDataFrame([], _BITS)
    levels = len(lengths(window))
    for level in range(levels):
        sent = held.cogroup(bits.groupBy("part")).applyInPandas(_sender(window, level, buckets), _SENT)
        bits = cut(bits.unionByName(sent.groupBy("bucket").applyInPandas(_judge, _BITS)))
    more = ", kept string, removed_from array<int>, removed_to array<int>" if full else ""
    return held.cogroup(bits.groupBy("part")).applyInPandas(_finisher(window, full), f"doc_id long, n_words long, n_removed long, kept_sha256 string{more}")
