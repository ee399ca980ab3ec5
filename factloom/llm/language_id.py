"""Language identification by nearest centroid over TF-IDF byte trigrams.

A text's trigrams of folded bytes are hashed to ``DIMENSIONS`` counts, damped, weighted by inverse
document frequency and normalised. Each language has several centroids (spherical k-means); a text
gets the language of the centroid with the largest cosine. A text that is farther from its centroid
than nearly all training texts of that centroid by a wide margin is rejected; short ones are held against
snippets of training texts with about as many trigrams. The margin is wide since names, keys and one word said over and
over lie far from running text of their own language; text in a script that no language has has no known trigram at all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import cut, small_batches

DIMENSIONS = 4096
#: Centroids of all languages together are about so many, but ``CENTROIDS`` of one language at most and at least one of each. Of more than ``MOST_LANGS`` languages, those with the most rows are learned.
ALL_CENTROIDS = 2400
MOST_LANGS = 5000
CENTROIDS = 6
#: Rounds of k-means, each over all training rows.
ROUNDS = 3
#: Cosines are counted in so many bins; vectors are summed as whole numbers of this part, so that sums don't depend on their order.
BINS = 1000
UNIT = 1 << 20
#: Sums that a task holds before they go on.
HELD = 256
#: What a text should reach is the cosine that all but ``REJECT_TAIL`` of its centroid's texts reach (of its language's, where the centroid has fewer than ``LEAST_MEMBERS``). Under ``DOUBT_SHARE`` of that it is looked at again, by trigrams of known bytes only, and rejected under ``REJECT_SHARE`` of it.
DOUBT_SHARE = 0.5
REJECT_SHARE = 0.15
REJECT_TAIL = 0.01
LEAST_MEMBERS = 20
#: Of texts of fewer distinct trigrams than ``LEAST_TRIGRAMS``, what nearly all (but ``SNIPPET_TAIL``) of a language's snippets with ``1 / NEAR_SIZE`` to ``NEAR_SIZE`` times as many reach, for the language where that is least.
LEAST_TRIGRAMS = 64
SNIPPET_CHARS = (4, 8, 16, 32, 64, 100)
SNIPPET_TAIL = 0.005
NEAR_SIZE = 1.3
LEAST_SNIPPETS = 20
#: A byte is known if in some language this share of the texts has it.
KNOWN_SHARE = 0.01
UNKNOWN = "und"

_FOLDED = np.arange(256, dtype=np.uint32)
_FOLDED[65:91] += 32
_FOLDED[[b for b in range(128) if not chr(b).isalpha()]] = 32
_LETTER = regex.compile(r"\p{L}")
_ROWS = 128


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that no model learns from: the checksum of the id as text is divisible by ``folds``."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(False))


def _counts(column: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Trigram counts, some rows at a time; a space stands before and after each text. With ``known``, only trigrams of these folded bytes."""
    data, at, _ = W.buffers(column)
    for low in range(0, len(column), _ROWS):
        high = min(low + _ROWS, len(column))
        size = np.diff(at[low : high + 1])
        row = np.repeat(np.arange(high - low), size)
        text = np.full(int(size.sum()) + 2 * (high - low), 32, dtype=np.uint32)
        text[np.arange(len(row)) + 2 * row + 1] = _FOLDED[data[at[low] : at[high]]]
        of = np.repeat(np.arange(high - low), size + 2)
        a, b, c = text[:-2], text[1:-1], text[2:]
        good = (of[2:] == of[:-2]) & ~((b == 32) & ((a == 32) | (c == 32)))
        if known is not None:
            good &= known[a] & known[b] & known[c]
        cell = ((a * np.uint32(2654435761) + b * np.uint32(2246822519) + c * np.uint32(3266489917)) >> np.uint32(20)).astype(np.int64)
        cell += of[2:] * DIMENSIONS
        yield low, np.bincount(cell[good], minlength=(high - low) * DIMENSIONS).reshape(high - low, DIMENSIONS)


def _bytes_of(text: str) -> np.ndarray:
    """Which folded bytes a text has."""
    has = np.zeros(256, dtype=bool)
    has[_FOLDED[np.frombuffer(text.encode(), dtype=np.uint8)]] = True
    return has


def _snippets(text: str) -> list[str]:
    """Pieces from the middle of a text, from a word's start if there is one near."""
    out = []
    for size in SNIPPET_CHARS:
        at = len(text) // 2 if len(text) > 2 * size else 0
        space = text.find(" ", at, at + 50) if at else -1
        out.append(text[max(at, space + 1) :][:size])
    return out


@dataclass
class Model:
    """IDF weights, centroids (one a row) with their languages and what their texts reach, what texts of few trigrams reach by their number, and the known bytes."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    reached: np.ndarray
    short: np.ndarray
    known: np.ndarray


_SEEN = "lang string, n long, counts binary"
_SUMS = "lang string, part int, n long, vector binary"
_BINS = "lang string, part int, size int, bin int, n long"


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: document frequencies of all rows (no language), and by language in how many rows each folded byte stands."""
    W.tidy("language_id")
    seen, total = np.zeros(DIMENSIONS, dtype=np.int64), 0
    held: dict[str, list] = {}
    for batch in batches:
        for part in W.pieces(batch, "text"):
            texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
            for low, counts in _counts(part.column(0)):
                seen += (counts > 0).sum(axis=0)
                total += len(counts)
                for i in range(low, low + len(counts)):
                    x = held.setdefault(langs[i], [0, np.zeros(256, dtype=np.int64)])
                    x[0] += 1
                    x[1] += _bytes_of(texts[i])
        if len(held) > 16 * HELD:
            yield _batch([(k, n, x.tobytes()) for k, (n, x) in held.items()], [pa.string(), pa.int64(), pa.binary()], _SEEN)
            held.clear()
    if total:
        yield _batch([(k, n, x.tobytes()) for k, (n, x) in held.items()] + [(None, total, seen.tobytes())], [pa.string(), pa.int64(), pa.binary()], _SEEN)


def _batch(rows: list[tuple], types: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])


def _added(table: pa.Table) -> pa.Table:
    """A group's row with the sums of ``n`` and of its vectors of whole numbers, the last column."""
    total = sum(np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table.column(table.num_columns - 1))
    out = table.slice(0, 1)
    place = table.column_names.index("n")
    out = out.set_column(place, table.schema.field(place), pa.array([int(np.sum(table.column(place).to_numpy()))], pa.int64()))
    return out.set_column(table.num_columns - 1, table.schema.field(table.num_columns - 1), pa.array([total.tobytes()], pa.binary()))


def _own(rows: pa.RecordBatch, idf: np.ndarray, centres: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By language, some rows at a time: unit vectors that are not 0, the nearest of the language's own centroids, its cosine, and numbers of distinct trigrams."""
    langs = np.array(rows.column(1).to_pylist(), dtype=object)
    for low, counts in _counts(rows.column(0)):
        vectors, size = _unit(np.log1p(counts, dtype=np.float32) * idf), (counts > 0).sum(axis=1)
        here = langs[low : low + len(counts)]
        for lang in sorted(set(here)):
            at = np.flatnonzero((here == lang) & (size > 0))
            if len(at):
                cosine = vectors[at] @ centres[lang].T if lang in centres else np.zeros((len(at), 1), np.float32)
                yield lang, vectors[at], cosine.argmax(axis=1), cosine.max(axis=1), size[at]


def _bins(cosine: np.ndarray) -> np.ndarray:
    return np.clip((cosine * BINS).astype(np.int64), 0, BINS - 1)


def _summing(idf: np.ndarray, centres: dict[str, np.ndarray], edges: dict[str, np.ndarray]):
    """Per task: sums of the unit vectors of each language and centroid, or, where a language has ``edges``, of each class of cosine with its one centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("language_id")
        held: dict[tuple[str, int], list] = {}
        out = lambda: _batch([(*k, n, x.tobytes()) for k, (n, x) in held.items()], [pa.string(), pa.int32(), pa.int64(), pa.binary()], _SUMS)
        for batch in batches:
            for part in W.pieces(batch, "text"):
                for lang, vectors, of, cosine, _ in _own(part, idf, centres):
                    of = np.searchsorted(edges[lang], _bins(cosine), side="left") if lang in edges else of
                    whole = np.rint(vectors * UNIT).astype(np.int64)
                    for c in np.unique(of):
                        x = held.setdefault((lang, int(c)), [0, np.zeros(DIMENSIONS, dtype=np.int64)])
                        x[0] += int((of == c).sum())
                        x[1] += whole[of == c].sum(axis=0)
                    if len(held) > HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return run


def _counting(idf: np.ndarray, centres: dict[str, np.ndarray], snippets: bool):
    """Per task: how many rows of each language and centroid have which cosine (size 0: all, 1: those of enough trigrams); part -1: snippets by number of trigrams, with the nearest centroid of all."""
    every = np.vstack([centres[x] for x in sorted(centres)]) if centres else np.zeros((0, DIMENSIONS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("language_id")
        held: Counter = Counter()
        out = lambda: _batch([(*k, n) for k, n in held.items()], [pa.string(), *[pa.int32()] * 3, pa.int64()], _BINS)
        for batch in batches:
            for part in W.pieces(batch, "text"):
                for lang, _, of, cosine, size in _own(part, idf, centres):
                    held.update((lang, int(c), int(long), int(x)) for c, long, x in zip(of, size >= LEAST_TRIGRAMS, _bins(cosine), strict=True))
                if snippets and len(every):
                    langs, texts = part.column(1).to_pylist(), part.column(0).to_pylist()
                    of = [x for x in langs for _ in SNIPPET_CHARS]
                    for low, few in _counts(pa.array([s for t in texts for s in _snippets(t)], pa.string())):
                        size = (few > 0).sum(axis=1)
                        at = np.flatnonzero((size > 0) & (size < LEAST_TRIGRAMS))
                        cosine = (_unit(np.log1p(few[at], dtype=np.float32) * idf) @ every.T).max(axis=1)
                        held.update((of[low + i], -1, int(size[i]), int(x)) for i, x in zip(at, _bins(cosine), strict=True))
                if len(held) > 64 * HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def _quantiles(bins: DataFrame, by: list[str], tail: float) -> DataFrame:
    """``(by, total, bin)``: the bin that all but ``tail`` of the rows counted in ``bins(by, bin, n)`` reach."""
    group = Window.partitionBy(*by)
    cells = bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    cells = cells.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    return cells.where(F.col("upto") > F.col("total") * tail).groupBy(*by).agg(F.max("total").alias("total"), F.min("bin").alias("bin"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _centres(rows: DataFrame, idf: np.ndarray, before: dict[str, np.ndarray], edges: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean directions of all rows by language and part; a centroid that is nearest to none stays."""
    sums = rows.mapInArrow(_summing(idf, before, edges), _SUMS).groupBy("lang", "part").applyInArrow(_added, _SUMS)
    new: dict[str, dict[int, np.ndarray]] = {}
    for r in cut(sums).toLocalIterator():
        new.setdefault(r["lang"], {})[r["part"]] = _unit(np.frombuffer(r["vector"], dtype=np.int64).astype(np.float64)).astype(np.float32)
    out = {}
    for lang, parts in new.items():
        keep = {} if lang in edges or lang not in before else dict(enumerate(before[lang]))
        out[lang] = np.stack([x for _, x in sorted((keep | parts).items())])
    return out


def fit(docs: DataFrame) -> Model:
    """Learn from ``docs(text, lang, doc_id)``; rows without a language or text, or of the held-out fold, are not used; a null id is of no fold that is held out.

    All training rows count everywhere: in document frequencies, bytes, centroids and thresholds. Centroids are those of spherical k-means, ``ROUNDS`` rounds over all rows
    of a language, from the means of classes of about as many rows by cosine with the language's mean; tasks add up vectors, Spark adds up what tasks have, and the driver holds the centroids.
    Of more than ``MOST_LANGS`` languages those with the most rows have one, which
    bounds what the driver and each task hold. Whole texts are used,
    however long. Without labelled rows the model knows no language.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    seen = cut(rows.mapInArrow(_observe, _SEEN).groupBy("lang").applyInArrow(_added, _SEEN))
    every = seen.where("lang is null").collect()
    total = every[0]["n"] if every else 0
    idf = np.log((1 + total) / (1 + (np.frombuffer(every[0]["counts"], dtype=np.int64) if every else np.zeros(DIMENSIONS)))).astype(np.float32) + np.float32(0.1)
    learned = seen.where("lang is not null").orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    known = np.zeros(256, dtype=bool)
    for r in learned:
        known |= np.frombuffer(r["counts"], dtype=np.int64) >= KNOWN_SHARE * r["n"]
    known[32] = True
    if seen.where("lang is not null").count() > len(learned):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(r["lang"],) for r in learned], "lang string")), "lang", "left_semi").select("text", "lang")
    k = max(1, min(CENTROIDS, ALL_CENTROIDS // max(1, len(learned))))
    centres = _centres(rows, idf, {}, {})
    if k > 1 and centres:
        cells = rows.mapInArrow(_counting(idf, centres, False), _BINS).select("lang", "bin", "n")
        cells = cut(cells.groupBy("lang", "bin").agg(F.sum("n").alias("n")))
        edges: dict[str, list[int]] = {}
        for i in range(1, k):
            for r in _quantiles(cells, ["lang"], i / k).collect():
                edges.setdefault(r["lang"], []).append(r["bin"])
        centres = _centres(rows, idf, centres, {x: np.unique(e) for x, e in edges.items()})
        for _ in range(ROUNDS):
            centres = _centres(rows, idf, centres, {})
    bins = cut(rows.mapInArrow(_counting(idf, centres, True), _BINS).groupBy("lang", "part", "size", "bin").agg(F.sum("n").alias("n")))
    long = bins.where("part >= 0 and size = 1")
    own = {(r["lang"], r["part"]): r["bin"] / BINS for r in _quantiles(long, ["lang", "part"], REJECT_TAIL).where(F.col("total") >= LEAST_MEMBERS).collect()}
    whole = {r["lang"]: r["bin"] / BINS for r in _quantiles(long, ["lang"], REJECT_TAIL).collect()}
    langs = [x for x in sorted(centres) for _ in centres[x]]
    reached = [own.get((x, c), whole.get(x, 0.0)) for x in sorted(centres) for c in range(len(centres[x]))]
    # what snippets of about a size reach, for the language where that is least, and never more than for a larger size
    near = F.explode(F.filter(F.sequence(F.lit(1), F.lit(LEAST_TRIGRAMS - 1)), lambda x: (F.col("size") >= x / NEAR_SIZE) & (F.col("size") <= x * NEAR_SIZE)))
    few = _quantiles(bins.where("part = -1").select("lang", "bin", "n", near.alias("near")), ["lang", "near"], SNIPPET_TAIL).where(F.col("total") >= LEAST_SNIPPETS)
    short = np.full(LEAST_TRIGRAMS, np.inf)
    for r in few.groupBy("near").agg(F.min("bin").alias("bin")).collect():
        short[r["near"]] = r["bin"] / BINS
    short = np.where(np.isinf(short), 0.0, np.minimum.accumulate(short[::-1])[::-1])
    W.tidy("language_id")
    stacked = np.vstack([centres[x] for x in sorted(centres)]) if centres else np.zeros((0, DIMENSIONS), np.float32)
    return Model(idf, stacked, langs, np.array(reached), short, known)


def _known_cosine(texts: pa.Array, model: Model) -> np.ndarray:
    """Largest cosine of each text when trigrams with a byte that is not known count for no centroid: hashed, these can meet some by chance."""
    out = []
    for (_, every), (_, known) in zip(_counts(texts), _counts(texts, model.known), strict=True):
        length = np.linalg.norm(np.log1p(every, dtype=np.float32) * model.idf, axis=1)
        out.append(((np.log1p(known, dtype=np.float32) * model.idf) @ model.centroids.T).max(axis=1) / np.maximum(length, 1e-12))
    return np.concatenate(out)


def _predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("language_id")
        for batch in batches:
            for part in W.pieces(batch, "text"):
                texts = part.column(0)
                letters = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], dtype=bool)
                best = np.zeros(len(texts))
                n = np.zeros(len(texts), dtype=np.int64)
                reached = np.zeros(len(texts))
                lang: list[str] = []
                for low, counts in _counts(texts):
                    n[low : low + len(counts)] = (counts > 0).sum(axis=1)
                    if model.langs:
                        cosine = _unit(np.log1p(counts, dtype=np.float32) * model.idf) @ model.centroids.T
                        at = cosine.argmax(axis=1)
                        best[low : low + len(at)] = cosine[np.arange(len(at)), at]
                        reached[low : low + len(at)] = model.reached[at]
                        lang += [model.langs[k] for k in at]
                    else:
                        lang += [UNKNOWN] * len(counts)
                score = np.where(letters, np.clip(best, 0, 1), 0.0)
                few = n < LEAST_TRIGRAMS
                reached[few] = model.short[n[few]]
                far = np.zeros(len(texts), dtype=bool)
                doubt = np.flatnonzero(letters & (score < reached * DOUBT_SHARE))
                if len(doubt) and model.langs:
                    far[doubt] = _known_cosine(texts.take(pa.array(doubt)), model) < reached[doubt] * REJECT_SHARE
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array([x if ok else UNKNOWN for x, ok in zip(lang, letters, strict=True)], pa.string()), pa.array(score), pa.array(~letters | far | (not model.langs))],
                    names=[*part.schema.names[1:], "lang_pred", "score", "rejected"],
                )

    return W.resting(predict)


def predict(docs: DataFrame, model: Model, keep: dict[str, str], text_col: str = "text") -> DataFrame:
    """The columns named in ``keep`` (name: type) and ``lang_pred``, ``score`` (cosine, 0 to 1), ``rejected``, row by row.

    A text that is null or has no letter gets ``und``, score 0, and is rejected. With nothing learned
    every row does. Ties go to the first language in order. Rows may repeat; ids may be null. Whole texts
    count, however long. Columns not named are ignored, whatever their names. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)))
    fields = ", ".join(f"_{i} {t}" for i, t in enumerate(keep.values()))
    out = rows.mapInArrow(_predictor(model), f"{fields}, lang_pred string, score double, rejected boolean")
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "rejected")
