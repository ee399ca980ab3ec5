"""Exact top-k inner products: query blocks times shards of vectors, tile by tile.

Both sides are packed into blocks of rows with their vectors in one binary value. Shards of tiles and
groups of query blocks form a grid: a tile goes to every group, a query block to every shard, and a
cell's task holds the blocks of its group, ``QUERY_BYTES`` at most, while the tiles stream past. Nothing is
broadcast and no vector comes to the driver. Each tile is multiplied as a whole, its best scores are
selected by a partition of the score matrix, and the shards' lists are merged in levels of ``FAN_IN``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import cut, numbered, shuffle_width, small_batches

#: Vectors of a group of query blocks, at 8 bytes a component.
QUERY_BYTES = 32 << 20
QUERY_TILE = 512
TILE = 4096
#: Tiles of a shard, about.
SHARD_TILES = 8
#: Lists that are merged into one at each level.
FAN_IN = 16

_LEAST = np.iinfo(np.int64).min
_KINDS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<f8"))
_PACKED = "d int, part long, n long, ids binary, rows binary, kind int, vectors binary"
_FOUND = "query_row long, query_id long, shard long, row long, vec_id long, score long"


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Usable rows' numbers, all rows' offsets, and components times 256 rounded down; usable: not null, all components finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    at = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64())
    ok = np.asarray(flat.is_valid())
    values = np.where(ok, flat.fill_null(0.0).to_numpy(zero_copy_only=False), np.nan)
    scaled = np.floor(values * 256.0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(scaled))])
    return np.flatnonzero(valid & (bad[at[1:]] == bad[at[:-1]])), at, scaled


def _pack(d: int, part: int, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> tuple:
    most = np.abs(vectors).max(initial=0)
    kind = 0 if most < 2**15 else 1 if most < 2**31 else 2
    return d, part, len(ids), ids.tobytes(), rows.tobytes(), kind, vectors.astype(_KINDS[kind]).tobytes()


def _batch(packed: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*packed, strict=True), kinds, strict=True)], names=["d", "part", "n", "ids", "rows", "kind", "vectors"])


def _packer(size: int):
    """Rows ``(row, vec_id, part, v)`` to blocks of at most ``size`` rows of one length and part; without a part, each block is one of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("exact_topk")
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        sizes: dict[tuple[int, int], int] = {}

        def close(key: tuple[int, int]) -> tuple:
            nonlocal block
            d, part = key
            ids, rows, vectors = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            sizes.pop(key)
            block += 1
            return _pack(d, block if part < 0 else part, ids, rows, vectors)

        for batch in batches:
            good, at, scaled = _matrix(batch.column(3))
            if not len(good):
                continue
            rows, ids = (np.asarray(batch.column(k)).astype(np.int64) for k in (0, 1))
            part = np.asarray(batch.column(2).fill_null(-1)).astype(np.int64)
            size_of = (at[1:] - at[:-1])[good].astype(np.int64)
            out = []
            for d, p in sorted(set(zip(size_of.tolist(), part[good].tolist(), strict=True))):
                some = good[(size_of == d) & (part[good] == p)]
                for low in range(0, len(some), size):
                    few = some[low : low + size]
                    if sizes.get((d, p), 0) + len(few) > size:
                        out.append(close((d, p)))
                    held.setdefault((d, p), []).append((ids[few], rows[few], scaled[at[few][:, None] + np.arange(d)]))
                    sizes[d, p] = sizes.get((d, p), 0) + len(few)
            if out:
                yield _batch(out)
        rest = [close(key) for key in sorted(held)]
        if rest:
            yield _batch(rest)

    return pack


def dot(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in single or double precision where no sum can reach what it holds exactly, else as integers."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(vectors)), dtype=np.int64)
    bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if bound < 2**24:
        return (queries.astype(np.float32) @ vectors.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in queries], dtype=object) @ np.array([[int(x) for x in r] for r in vectors], dtype=object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def select(scores: np.ndarray, least: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (query, vector) of a score matrix that can be among a query's ``k`` best: as good as its k-th best in the tile and as ``least``, ties included."""
    if scores.shape[1] > k:
        masked = np.where(allowed, scores, _LEAST)
        least = np.maximum(least, np.partition(masked, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    return np.nonzero((scores >= least[:, None]) & allowed)


def keep_best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among their query's ``k`` best: higher scores first, then smaller ids, then smaller rows; in order of query and rank."""
    order = np.lexsort((rows, ids, ~score, query))
    query = query[order]
    first = np.searchsorted(query, query)
    return order[np.arange(len(query)) - first < k]


class _Queries:
    """One block of queries with the best entries so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int) -> None:
        order = np.argsort(rows)
        self.ids, self.rows, self.vectors, self.k = ids[order], rows[order], vectors[order], k
        self.least = np.full(len(ids), _LEAST)
        none = np.empty(0, dtype=np.int64)
        self.top = none, none, none, none  # query, score, id, row

    def meet(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        scores = dot(self.vectors, vectors)
        allowed = np.ones(scores.shape, dtype=bool)
        own = np.minimum(np.searchsorted(self.rows, rows), len(self.rows) - 1)
        mine = np.flatnonzero(self.rows[own] == rows)
        allowed[own[mine], mine] = False
        q, t = select(scores, self.least, allowed, self.k)
        every = [np.concatenate(x) for x in zip(self.top, (q, scores[q, t], ids[t], rows[t]), strict=True)]
        best = keep_best(*every, self.k)
        self.top = tuple(x[best] for x in every)
        q, score = self.top[:2]
        full = np.flatnonzero(np.bincount(q, minlength=len(self.rows)) == self.k)
        self.least[full] = score[np.searchsorted(q, full, side="right") - 1]


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered: a cell's query blocks, then its tiles."""
        W.tidy("exact_topk")
        cell, blocks = None, []

        def close() -> pa.RecordBatch:
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for b in blocks:
                q, score, ids, rows = b.top
                for column, x in zip(columns, (b.rows[q], b.ids[q], np.full(len(q), cell[1]), rows, ids, score), strict=True):
                    column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in columns], names=["query_row", "query_id", "shard", "row", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                d, shard, group, asks, ids, rows, kind, vectors = (batch.column(c)[i].as_py() for c in range(8))
                if (d, shard, group) != cell:
                    if blocks:
                        yield close()
                    cell, blocks = (d, shard, group), []
                ids, rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
                matrix = np.frombuffer(vectors, _KINDS[kind]).reshape(len(ids), d).astype(np.float64)
                if asks:
                    blocks.append(_Queries(ids, rows, matrix, k))
                else:
                    for b in blocks:
                        b.meet(ids, rows, matrix)
        if blocks:
            yield close()

    return search


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows of each row whose id is divisible by ``every``.

    Components become ``floor(256 * x)``; the score is their integer inner product (held to the range
    of long). Vectors that are null or hold a null or a component that is not finite take no part,
    nor do rows without an id; a query meets the vectors of its own length, all but its own row. Ties go to the smaller
    id. Rows that repeat an id are candidates, and queries, each by itself; their lists share the id. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    rows = numbered(rows, "vec_id", "v")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, size = rows.agg(F.count("*"), F.sum(F.when(F.pmod("vec_id", F.lit(every)) == 0, 8 * F.size("v") + 16))).first()
    groups = max(1, -(-(size or 0) // QUERY_BYTES))
    shards = max(1, -(-n // (TILE * SHARD_TILES)))
    tiles = rows.select("row", "vec_id", F.lit(None).cast("long").alias("part"), "v").mapInArrow(_packer(TILE), _PACKED)
    tiles = tiles.select("d", F.pmod(F.xxhash64("part"), F.lit(shards)).alias("shard"), F.explode(_upto(groups)).alias("part"), F.lit(False).alias("asks"), "ids", "rows", "kind", "vectors")
    blocks = asked.select("row", "vec_id", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("part"), "v").repartition(groups, "part").mapInArrow(_packer(QUERY_TILE), _PACKED)
    blocks = blocks.select("d", F.explode(_upto(shards)).alias("shard"), "part", F.lit(True).alias("asks"), "ids", "rows", "kind", "vectors")
    dealt = blocks.unionByName(tiles).repartition(max(shards * groups, shuffle_width(spark)), "d", "shard", "part")
    found = dealt.sortWithinPartitions("d", "shard", "part", F.desc("asks")).mapInArrow(_searcher(k), _FOUND)
    lists = cut(found)
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        merged = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        order = Window.partitionBy("query_row", "shard").orderBy(F.desc("score"), "vec_id", "row")
        lists = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
