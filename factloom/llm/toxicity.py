"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's logit is a bias plus the weights of its words and of their beginnings (hashed to
``BUCKETS``), so that inflected and compound forms count too, and of pairs of neighbouring characters in scripts
that are written without spaces; a document is toxic unless every sentence is clean (noisy-or):
P = 1 - prod(1 - p). Only document labels are given, so the loss of P trains the sentence scorer, which
then points at the sentences at fault.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .language_id import held_out
from .scratch import cut, small_batches

BUCKETS = 1 << 18
#: Labelled documents that train the model: those with the smallest hashes of the id, whatever their length.
SAMPLE_DOCS = 8000
#: A feature gets a weight if at least so many toxic training documents have it, and so many standard deviations more than labels would give it by chance.
LEAST_TOXIC = 4
LEAST_DEVIATIONS = 3.5
#: Beginnings of words that are features, in bytes.
PREFIXES = (4, 5, 6)
ROUNDS = 80

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".!?\n"]] = True
# Sentence ends beyond ASCII (ideographic and full-width, Devanagari, Arabic, Urdu).
_WIDE_STOPS = [c.encode() for c in "。！？।؟۔"]
# First bytes, in UTF-8, of characters of scripts without spaces (kana and ideographs; Thai and Lao begin with E0 B8 to E0 BB).
_DENSE = np.zeros(256, dtype=bool)
_DENSE[0xE3:0xEA] = True


@dataclass
class Model:
    """Word weights and the sentence bias."""

    weights: np.ndarray
    bias: float


def _ends(data: np.ndarray) -> np.ndarray:
    """How many sentences have ended before each byte."""
    stops = _STOPS[data]
    if (data >= 0x80).any():
        for stop in _WIDE_STOPS:
            at = np.flatnonzero(data[: len(data) - len(stop) + 1] == stop[0])
            for k in range(1, len(stop)):
                at = at[data[at + k] == stop[k]]
            stops[at + len(stop) - 1] = True
    return np.cumsum(stops, dtype=np.int32)


def _dense_pairs(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Start and bucket of each pair of neighbouring three-byte characters of scripts without spaces."""
    data = block.data
    lead = _DENSE[data]
    thai = np.flatnonzero(data[:-1] == 0xE0) if len(data) > 1 else np.empty(0, np.int64)
    lead[thai[(data[thai + 1] >= 0xB8) & (data[thai + 1] <= 0xBB)]] = True
    lead &= ~((data == 0xE3) & (np.append(data[1:], 0) == 0x80) & (np.append(data[2:], [0, 0])[: len(data)] <= 0x9F))  # punctuation
    at = np.flatnonzero(lead[:-3] & lead[3:]) if len(data) > 5 else np.empty(0, np.int64)
    at = at[at + 6 <= len(data)]
    edge = block.text_at[np.searchsorted(block.text_at, at, side="right")] if len(at) else at
    at = at[at + 6 <= edge]
    name = np.full(len(at), 2, dtype=np.uint64)
    for j in range(6):
        name = (name << np.uint64(8)) | data[at + j].astype(np.uint64)
    return at, (W.mix(name) & np.uint64(BUCKETS - 1)).astype(np.int32)


def _sentences(block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each token's features, a row for each token, 0 for none; each token's sentence, numbered through the block; the row of each sentence that has tokens; each token's start and end.

    Tokens are words and, in scripts without spaces, pairs of characters.
    """
    if not len(block.start):
        none = np.empty(0, np.int64)
        return np.empty((0, 1 + len(PREFIXES)), np.int32), none, none, none, none
    features = np.zeros((len(block.start), 1 + len(PREFIXES)), dtype=np.int32)
    features[:, 0] = block.hash & np.uint64(BUCKETS - 1)
    for k, n in enumerate(PREFIXES, 1):
        long = np.flatnonzero(block.end - block.start >= n)
        name = np.full(len(long), n, dtype=np.uint64)
        for j in range(n):
            name = (name << np.uint64(8)) | _FOLD[block.data[block.start[long] + j]]
        features[long, k] = W.mix(name) & np.uint64(BUCKETS - 1)
    start, end = block.start, block.end
    at, bucket = _dense_pairs(block)
    if len(at):
        order = np.argsort(np.concatenate([start, at]), kind="stable")
        more = np.zeros((len(at), 1 + len(PREFIXES)), dtype=np.int32)
        more[:, 0] = bucket
        features, start, end = np.concatenate([features, more])[order], np.concatenate([start, at])[order], np.concatenate([end, at + 6])[order]
    row = np.searchsorted(block.text_at, start, side="right") - 1
    mark = _ends(block.data)[start] + row
    head = np.ones(len(mark), dtype=bool)
    head[1:] = mark[1:] != mark[:-1]
    return features, np.cumsum(head) - 1, row[head], start, end


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    W.tidy("toxicity")
    for batch in batches:
        for part in W.pieces(batch, "text"):
            block = W.split(part.column(0), W.ALNUM, fold=True)
            bucket, sentence, _, start, _ = _sentences(block)
            cuts = np.searchsorted(start, block.text_at)
            words = [(bucket[a:b].tobytes(), (sentence[a:b] - sentence[a] if b > a else sentence[a:b]).astype(np.int32).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([x[0] for x in words], pa.large_binary()).cast(pa.binary()), pa.array([x[1] for x in words], pa.large_binary()).cast(pa.binary())], names=["toxic", "buckets", "sentences"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many documents, and toxic ones, each bucket occurs."""
    W.tidy("toxicity")
    every, pos = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for toxic, buckets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = np.unique(np.frombuffer(buckets, dtype=np.int32))
            every[found] += 1
            pos[found] += toxic > 0
    used = np.flatnonzero(every)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(every[used]), pa.array(pos[used])], names=["bucket", "n", "pos"])


def _pick(usable: np.ndarray):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("toxicity")
        for batch in batches:
            rows = []
            for buckets, sentences in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                b, s = np.frombuffer(buckets, dtype=np.int32), np.frombuffer(sentences, dtype=np.int32)
                keep = np.isin(b, usable)
                rows.append((b[keep].tobytes(), np.repeat(s, 1 + len(PREFIXES))[keep].tobytes(), int(s[-1]) + 1 if len(s) else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int32())))], names=["toxic", "buckets", "sentences", "n_sentences"])

    return pick


def train(weights: np.ndarray, usable: np.ndarray, buckets: np.ndarray, sentence: np.ndarray, doc: np.ndarray, toxic: np.ndarray, plain: np.ndarray | None = None) -> Model:
    """Fit the noisy-or by gradient steps from ``weights`` on; ``buckets`` and ``sentence`` are each feature's, ``doc`` each sentence's, ``toxic`` each document's, as is ``plain``, the number of further sentences without any feature."""
    docs = len(toxic)
    plain = np.zeros(docs) if plain is None else plain
    place = np.zeros(BUCKETS, dtype=np.int64)
    place[usable] = np.arange(len(usable))
    feature, fitted = place[buckets], weights[usable].astype(float)
    bias, rate = -6.0, 0.15
    first, second = np.zeros(len(usable) + 1), np.zeros(len(usable) + 1)
    for step in range(1, ROUNDS + 1):
        z = np.clip(bias + np.bincount(sentence, weights=fitted[feature], minlength=len(doc)), -30, 30)
        total = np.bincount(doc, weights=np.logaddexp(0, z), minlength=docs) + plain * np.logaddexp(0, np.clip(bias, -30, 30))
        pull = np.where(toxic > 0, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) / docs
        dz = pull[doc] / (1 + np.exp(-z))
        gradient = np.append(np.bincount(feature, weights=dz[sentence], minlength=len(usable)) + 1e-4 / docs * fitted, dz.sum() + (pull * plain).sum() / (1 + np.exp(-np.clip(bias, -30, 30))))
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        fitted -= move[:-1]
        bias -= move[-1]
    out = np.zeros(BUCKETS, dtype=np.float32)
    out[usable] = fitted
    return Model(out, float(bias))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labelled documents outside the held-out fold; a document labelled twice is toxic if one label says so.

    The sample are the ``SAMPLE_DOCS`` labelled ids with the smallest hashes. Of rows that repeat an id the text with the smallest
    hash counts; rows and labels without an id, and labels without a value, are left out, and null texts have no sentence. Whole texts are used, however long.
    Features are counted where the sample is; only those that go with toxic labels, and their places,
    come to the driver. Sentences without any of them are only counted.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(SAMPLE_DOCS)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the bound of SAMPLE_DOCS rows makes the broadcast safe
    sample = text.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = cut(sample.select("text", "toxic").mapInArrow(_extract, "toxic int, buckets binary, sentences binary"))
    n_pos, n_all = sample.agg(F.count_if(F.col("toxic") > 0), F.count("*")).first()
    n_neg = max(n_all - n_pos, 1)
    chance = F.col("n") * (n_pos / max(n_all, 1))
    counted = sample.mapInArrow(_count, "bucket int, n long, pos long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    found = counted.where((F.col("bucket") > 0) & (F.col("pos") >= LEAST_TOXIC) & (F.col("pos") - chance >= LEAST_DEVIATIONS * F.sqrt(chance))).orderBy("bucket").collect()
    weights = np.zeros(BUCKETS)
    for r in found:
        weights[r["bucket"]] = np.clip(np.log((r["pos"] + 0.5) / max(n_pos, 1)) - np.log((r["n"] - r["pos"] + 0.5) / n_neg), -1, 4) / 2
    usable = np.array([r["bucket"] for r in found], dtype=np.int32)
    rows = sample.mapInArrow(_pick(usable), "toxic int, buckets binary, sentences binary, n_sentences int").where("n_sentences > 0").collect() if len(usable) else []
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), -6.0)
    rows.sort(key=lambda r: (r["toxic"], r["n_sentences"], bytes(r["buckets"]), bytes(r["sentences"])))
    buckets, sentence, doc, plain, done = [], [], [], [], 0
    for k, r in enumerate(rows):
        used, at = np.unique(np.frombuffer(r["sentences"], dtype=np.int32), return_inverse=True)
        buckets.append(np.frombuffer(r["buckets"], dtype=np.int32))
        sentence.append(at + done)
        doc.append(np.full(len(used), k))
        plain.append(r["n_sentences"] - len(used))
        done += len(used)
    toxic = np.array([r["toxic"] for r in rows], dtype=float)
    return train(weights, usable, *(np.concatenate(x) for x in (buckets, sentence, doc)), toxic, np.array(plain, dtype=float))


def _scorer(model: Model, full: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("toxicity")
        for batch in batches:
            for part in W.pieces(batch, "text"):
                block = W.split(part.column(1), W.ALNUM, fold=True)
                bucket, sentence, row, start, end = _sentences(block)
                z = model.bias + np.bincount(sentence, weights=model.weights[bucket].sum(axis=1), minlength=len(row))
                clean = np.logaddexp(0, np.clip(z, -30, 30))
                total = np.bincount(row, weights=clean, minlength=block.rows)
                first = np.searchsorted(row, np.arange(block.rows + 1))
                worst = np.full(block.rows, -1, dtype=np.int64)
                faults: list[list[str]] = []
                heads = np.searchsorted(sentence, np.arange(len(row) + 1))
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if b > a:
                        worst[i] = int(z[a:b].argmax())
                    if full:
                        faults.append([bytes(block.data[start[heads[k]] : end[heads[k] : heads[k + 1]].max()]).decode() for k in (np.flatnonzero(z[a:b] >= 0) + a).tolist()])
                p = -np.expm1(-total)
                columns = [part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(np.diff(first)), pa.array(worst, mask=worst < 0)]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(faults, pa.list_(pa.string()))] if full else [])], names=["doc_id", "score", "predicted", "n_sentences", "worst_sentence", *(["offending"] if full else [])])

    return score


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """``(doc_id, score, predicted, n_sentences, worst_sentence)`` and, if ``full``, the offending sentences, row by row.

    Sentences end at ``. ! ?``, their forms in other scripts or a line's end; only those with words count. Null and empty texts
    have none and score 0. Rows may repeat and ids may be null; whole texts count, however long. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    more = ", offending array<string>" if full else ""
    return rows.mapInArrow(_scorer(model, full), f"doc_id long, score double, predicted int, n_sentences long, worst_sentence long{more}")
