"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

1. Every document's set of word shingles becomes a signature. One permutation (sigma) scatters the
   shingles over a universe of 2**20 places; coordinate k is the smallest value of a second
   permutation (pi), shifted circularly by k, over those places. So two permutations give all
   coordinates, and the k-values of one shingle are one contiguous slice of pi.
2. Documents with the same set are one class, stood for by its smallest id.
3. Classes that share a band are candidates. Each band's bucket first proposes its smallest member
   with each other one (a star, not all pairs); these pairs are verified on full sets and joined to
   components. Buckets that still hold more than one component are then cut into blocks of bounded
   size, and members of different components are compared on full sets, two blocks at a time; only
   links come out. No bucket, pair or document is capped.

Bands are chosen so that a pair at the threshold is missed with a probability under 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .scratch import cut, cut_and_sum, salted_join, shuffle_width, small_batches

COORDINATES = 192
UNIVERSE = 1 << 20
MISS = 1e-6
#: Up to so many rows of ids are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Shingles in a group of pairs that are verified together.
GROUP_SHINGLES = 2_000_000
#: Members of a bucket in one block, and their shingles.
BLOCK = 2000
BLOCK_SHINGLES = 1_000_000
_U = np.uint64

_tables: dict[str, np.ndarray] = W.kept.setdefault("near_dup", {})


def band_rows(threshold: float, coordinates: int = COORDINATES) -> int:
    """The most rows a band may have for a miss under ``MISS`` at the threshold."""
    fit = [r for r in range(1, 17) if (1 - threshold**r) ** (coordinates // r) <= MISS]
    return max(fit, default=1)


def _circulant() -> np.ndarray:
    if "pi" not in _tables:
        pi = np.random.default_rng(20).permutation(UNIVERSE).astype(np.int32)
        _tables["pi"] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:COORDINATES]]), COORDINATES)
    return _tables["pi"]


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of one set: the smallest of pi, shifted by k, over sigma of the set."""
    windows = _circulant()
    place = (W.mix(shingles ^ _U(0xA0761D6478BD642F)) >> _U(44)).astype(np.int64)  # sigma
    best = np.full(COORDINATES, UNIVERSE, dtype=np.int32)
    for at in range(0, len(place), 2048):
        np.minimum(best, windows[place[at : at + 2048]].min(axis=0), out=best)
    return best


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted; of fewer words the whole sequence is one."""
    block = W.split(column, W.NOT_SPACE, fold=True)
    whole = W.grams(block.hash, size)
    sets = []
    for first, end in zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True):
        if end - first >= size:
            sets.append(np.unique(whole[first : end - size + 1]))
        elif end > first:
            sets.append(W.grams(block.hash[first:end], end - first) ^ _U(end - first))
        else:
            sets.append(np.empty(0, dtype=_U))
    return sets


def _sketcher(size: int, rows: int):
    bands = COORDINATES // rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("near_dup")
        for batch in batches:
            for part in W.pieces(batch, "text"):
                sets = shingle_sets(part.column(1), size)
                counts = np.array([len(s) for s in sets], dtype=np.int64)
                key = np.zeros((len(sets), 2), dtype=_U)
                names = np.zeros((len(sets), bands), dtype=_U)
                for i, s in enumerate(sets):
                    if len(s):
                        key[i] = W.mix(s).sum(dtype=_U), W.mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)
                        got = signature(s)
                        names[i] = W.grams(got[: bands * rows].reshape(bands, rows).astype(_U).ravel(), rows)[::rows] ^ W.mix(np.arange(bands, dtype=_U))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(counts),
                        pa.array(key[:, 0].astype(np.int64)),
                        pa.array(key[:, 1].astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(names.astype(np.int64).ravel())),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    return sketch


def _verifier(size: int, num: int, den: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered: a group's pivot (role 0), then its members."""
        W.tidy("near_dup")
        group, pivots = None, []
        for batch in batches:
            for part in W.pieces(batch, "text"):
                sets = shingle_sets(part.column(part.schema.get_field_index("text")), size)
                a, salt, role, ids = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("a", "salt", "role", "doc_id"))
                out = []
                for i, s in enumerate(sets):
                    if (a[i], salt[i]) != group:
                        group, pivots = (a[i], salt[i]), []
                    if role[i] == 0:
                        pivots.append(s)
                        continue
                    for p in pivots:
                        small, large = (p, s) if len(p) <= len(s) else (s, p)
                        if den * len(small) < num * len(large) or not len(small):
                            continue
                        both = int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small))
                        if den * both >= num * (len(p) + len(s) - both):
                            out.append((a[i], ids[i]))
                            break
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return verify


def verified(pairs: DataFrame, docs: DataFrame, counts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those ``pairs(a, b)`` of which 100 times the intersection reaches the threshold times the union.

    Texts travel once for each pair and once for each group; groups of one pivot are dealt anew by
    the shingles that they hold, so a pivot with very many partners spreads over many tasks.
    """
    load = pairs.join(counts.withColumnRenamed("doc_id", "b"), "b").groupBy("a").agg(F.sum("n_shingles").alias("load"), F.count("*").alias("n"))
    groups, total, most = cut_and_sum(load.select("a", "n", F.ceil(F.col("load") / GROUP_SHINGLES + F.col("n") / 256).cast("int").alias("salts")), "n")
    members = salted_join(pairs, groups, ["a"], "n", total, most).select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"))
    heads = groups.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    texts = _with_text(docs, members.unionByName(heads))
    dealt = texts.select("a", "salt", "role", "doc_id", "text").repartition(shuffle_width(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "role")
    return cut(dealt.mapInArrow(_verifier(size, num, den), "a long, b long").distinct())


def links_across(sets: list[np.ndarray], comp: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of a left and a right member of different components that reach the threshold, by exact counts.

    Members of the most frequent component stand on one side only. Common shingles are counted by
    products of incidence matrices, a slab of members and some thousand shingles at a time.
    """
    names, counts = np.unique(comp, return_counts=True)
    lone = np.flatnonzero(comp != names[counts.argmax()])
    if not len(lone):
        return []
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, cell, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(often > 1) - 1
    keep = often[cell] > 1
    owner, cell = owner[keep], shared[cell[keep]]
    order = np.argsort(cell, kind="stable")
    owner, cell = owner[order], cell[order]
    found = []
    width = 4096
    edges = np.searchsorted(cell, np.arange(0, (int(cell[-1]) + 1 if len(cell) else 0) + width, width))
    for low in range(0, len(lone), 256):
        some = lone[low : low + 256]
        both = np.zeros((len(some), len(sets)), dtype=np.float32)
        for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            at = np.zeros((len(sets), width), dtype=np.float32)
            at[owner[x:y], cell[x:y] - k * width] = 1
            both += at[some] @ at.T
        both = both.astype(np.int64)
        ok = (den * both >= num * (sizes[some][:, None] + sizes[None] - both)) & (comp[some][:, None] != comp[None])
        ok &= (left[some][:, None] & right[None]) | (right[some][:, None] & left[None])
        found += [(int(some[x]), int(y)) for x, y in zip(*np.nonzero(ok), strict=True)]
    return found


def _linker(size: int, num: int, den: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by group; a group is one block of a bucket, or two."""
        W.tidy("near_dup")
        group, rows = None, []

        def close() -> pa.RecordBatch:
            ids, comp, blk, sets = zip(*rows, strict=True)
            blk = np.array(blk)
            found = links_across(list(sets), np.array(comp), blk == group[1], blk == group[2], num, den)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([f(ids[x], ids[y]) for x, y in found], pa.int64()) for f in (min, max)], names=["a", "b"])

        for batch in batches:
            for part in W.pieces(batch, "text"):
                sets = shingle_sets(part.column(part.schema.get_field_index("text")), size)
                columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("band", "i", "j", "doc_id", "comp", "blk")]
                for band, i, j, doc, comp, blk, s in zip(*columns, sets, strict=True):
                    if (band, i, j) != group:
                        if rows:
                            yield close()
                        group = band, i, j
                    rows.append((doc, comp, blk, s))
        if rows:
            yield close()

    return link


def _with_text(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """``roles`` with their documents' texts; few roles go to every executor, many are joined by a shuffle."""
    roles = cut(roles)
    return docs.join(F.broadcast(roles) if roles.count() <= BROADCAST_ROWS else roles.hint("merge"), "doc_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, set_id, class_size)``, one row per row with an id.

    Documents are linked when ``den * intersection >= num * union`` of their shingle sets.
    ``set_id`` is the smallest id with the same set, ``class_size`` the number of rows with it;
    ``component_id`` is the smallest id reachable over links, ``kept`` whether that is the row's own.

    Null and wordless texts have an empty set and are linked with nothing. Rows without an id are
    left out. Links are between ids: of rows that repeat an id with other texts each is returned, and
    a link of one that stands for its set holds for all. Other columns are ignored; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    rows = band_rows(num / den)
    sketches = cut(docs.mapInArrow(_sketcher(shingle, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"))
    full = sketches.where("n_shingles > 0")
    classes = cut(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("class_size"), F.first("n_shingles").alias("n_shingles")))
    counts = classes.groupBy(F.col("set_id").alias("doc_id")).agg(F.max("n_shingles").alias("n_shingles"))
    heads = full.join(classes.select(F.col("set_id").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    banded = heads.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last"), F.count("*").alias("m"), F.sum("n_shingles").alias("load"))
    blocks = F.ceil(F.col("m") / BLOCK + F.col("load") / BLOCK_SHINGLES).cast("int")
    buckets, total, most = cut_and_sum(buckets.where("a < last").select("band", "a", "m", blocks.alias("blocks")), "m")
    members = cut(salted_join(banded, buckets, ["band"], "m", total, most).select("band", "a", "blocks", "doc_id"))
    stars = cut(members.where("doc_id > a").groupBy("a", F.col("doc_id").alias("b")).count().select("a", "b"))
    links = verified(stars, docs, counts, shingle, num, den)
    comps = cut(components(links))
    placed = cut(members.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component"))
    mixed = placed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"))
    mixed, total, most = cut_and_sum(mixed.where("low < high").select("band", "m"), "m")
    sides = (
        salted_join(placed, mixed, ["band"], "m", total, most)
        .withColumn("blk", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("doc_id", "band", "comp", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    )
    dealt = _with_text(docs, sides).repartition(shuffle_width(docs.sparkSession), "band", "i", "j").sortWithinPartitions("band", "i", "j")
    more = cut(dealt.mapInArrow(_linker(shingle, num, den), "a long, b long").distinct())
    if not more.isEmpty():
        comps = cut(components(links.unionByName(more)))
    of_class = classes.select("k1", "k2", "set_id", "class_size").join(comps.withColumnRenamed("node", "set_id"), "set_id", "left")
    of_class, total, most = cut_and_sum(of_class.withColumn("component_id", F.coalesce("component", "set_id")).drop("component"), "class_size")
    rows = sketches.select("doc_id", "n_shingles", "k1", "k2")
    linked = salted_join(rows.where("n_shingles > 0"), of_class, ["k1", "k2"], "class_size", total, most)
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("set_id"), F.lit(1).cast("long").alias("class_size"))
    every = linked.select("doc_id", "n_shingles", "component_id", "set_id", "class_size").unionByName(alone)
    return every.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "set_id", "class_size")
