"""A trigram language model in sharded Elias-Fano tries, learned from and applied to whole tables.

Documents are cut into pieces of some MB of whole texts. Each piece is told the numbers and training counts of its
distinct words; then it knows its windows of three tokens, and sends the distinct ones, with how often training
documents have them, to the shard of their first word (of their first two words, or of all three, where a prefix is too
frequent for one shard). A shard sums the windows of all pieces into a trie: first words, second words below them,
third words below those. A level's word numbers, made relative to their context by adding the last value of the range before, and
its pointers to the next level are monotone and stored so; beside them stand smoothed probabilities as logarithms on a
fixed grid. The shard looks the distinct windows up, level by level, by successor search within the range of the
context, and answers each piece. No piece holds the model and no shard the corpus.

Smoothing is by Dirichlet priors: ``p(c|ab) = (n(abc) + m3 p(c|b)) / (n(ab) + m3)``, ``p(c|b)`` likewise with ``m2``,
and ``p(c) = (n(c) + 1) / (N + V + 1)``. Every text begins in a context of its own and closes with an end token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import elias_fano as E
from . import words as W
from .packed import gathered, pack, row, unpack
from .scratch import cut_in_loop, scrap, small_batches

#: Weights of the shorter context, for two and three tokens.
PRIOR_2 = 2.0
PRIOR_3 = 0.7
#: Bytes of text in a piece, but for longer documents.
PIECE_BYTES = 8 << 20
#: Rows of pieces' tables that a shard holds on average.
SHARD_ROWS = 1 << 19
#: A pair of tokens with more than a part of ``SHARE`` of all windows (and more than half a shard) is spread by its third token; there are no more than ``SHARE`` of these.
SHARE = 50_000
#: Probabilities are stored as multiples of ``1 / GRID`` of a decade; ``NONE`` says that there is no such window.
GRID = 4096
NONE = 65535
#: Numbers of tokens that are not words: unknown, after the end, before the first.
UNKNOWN, AFTER, BEFORE = 0, 1, 2
_FIRST = 3
#: A word that no text has stands for the end.
_END = np.uint64(W.word_hash(b" "))

_PIECES = "piece long, n_words long, n_texts long, docs binary, words binary, counts binary"
_WORDS = "piece long, shard long, words binary, ids binary, counts binary, tokens long, known long"
_WINDOWS = "piece long, n_windows long, windows binary, heavy array<struct<a: long, b: long, n: long>>"
_ANSWERS = "piece long, shard long, trie binary, second binary, third binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _tokenise(piece_bytes: int):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("ngram_lm")
        context = TaskContext.get()
        piece = (context.partitionId() if context else 0) << 32
        for table in gathered(batches, piece_bytes):
            block = W.split(table.column(1), W.NOT_SPACE, fold=True)
            learn = np.asarray(table.column(2).combine_chunks()).astype(bool)
            words, token = np.unique(np.append(block.hash, _END), return_inverse=True)
            counts = np.bincount(token[:-1][learn[block.row_of_word()]], minlength=len(words)).astype(np.int64)
            counts[token[-1]] += int(learn.sum())
            often = np.bincount(token[:-1], minlength=len(words))
            place = np.empty(len(words), dtype=np.int64)
            place[_by_frequency(often)] = np.arange(len(words))
            ids = table.column(0).combine_chunks()
            docs = pack(np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64), np.asarray(ids.is_valid()).astype(np.int64), learn.astype(np.int64), np.diff(block.first), place[token], often)
            yield row(_PIECES, piece, len(words), int(learn.sum()), docs, words.tobytes(), pack(counts))
            piece += 1

    return tokenise


def _by_frequency(often: np.ndarray) -> np.ndarray:
    """Words from the most frequent on; tokens as places in this order have few large numbers, and compress."""
    return np.argsort(-often, kind="stable")


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    """Words are dealt by ranges of their hashes, so that a sorted list falls into runs."""
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _slice_words(shards: int):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, raw, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words, counts = np.frombuffer(raw, np.uint64), unpack(packed)[0]
                of = _word_shard(words, shards)
                edge = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    yield row("shard long, piece long, words binary, counts binary", int(of[a]), piece, words[a:b].tobytes(), pack(counts[a:b]))

    return cut_up


def _number_words(shards: int, known: pa.Table | None, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The learned words of a shard (piece null), unless they are given, and for each piece the numbers and counts of its words there."""
    if not table.num_rows:
        return
    shard = table.column("shard")[0].as_py()
    lists = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
    if known is None:
        every, which = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.zeros(len(every), dtype=np.int64)
        np.add.at(total, which, np.concatenate([unpack(x)[0] for x in table.column("counts").to_pylist()]))
        words, counts = every[total > 0], total[total > 0]
        rank = np.empty(len(words), dtype=np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        ids = _FIRST + rank * shards + shard
        yield row(_WORDS, None, shard, words.tobytes(), pack(ids), pack(counts), int(counts.sum()), len(words))
    else:
        rows = known.select(["words", "ids", "counts"]).to_pylist()
        words = np.frombuffer(rows[0]["words"], np.uint64) if rows else np.empty(0, np.uint64)
        ids, counts = (unpack(rows[0][c])[0] if rows else np.empty(0, np.int64) for c in ("ids", "counts"))
    for piece, mine in zip(table.column("piece").to_pylist(), lists, strict=True):
        at = np.minimum(np.searchsorted(words, mine), max(len(words) - 1, 0))
        there = words[at] == mine if len(words) else np.zeros(len(mine), dtype=bool)
        found = [np.where(there, x[at], 0) if len(x) else np.zeros(len(mine), np.int64) for x in (ids, counts)]
        yield row(_WORDS, piece, shard, None, pack(found[0]), pack(found[1]), 0, 0)


def _as_table(rows: Iterator[pa.RecordBatch], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.Table.from_batches(list(rows), pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))]))


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of integers from 0 on, in their order, and which of them each row is."""
    if not len(columns[0]):
        return list(columns), np.empty(0, np.int64)
    key = columns[0]
    for x in columns[1:]:
        bits = int(x.max()).bit_length()
        if int(key.max()).bit_length() + bits > 63:
            key = np.unique(key, return_inverse=True)[1]
        key = (key << bits) | x
    order = np.argsort(key, kind="stable")
    new = np.diff(key[order], prepend=-1) != 0
    which = np.empty(len(key), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return [x[order[new]] for x in columns], which


def _encode(a: np.ndarray, b: np.ndarray, c: np.ndarray, *others: np.ndarray) -> bytes:
    """Windows in order, as differences from the one before wherever what stands before is the same."""
    one, two = np.diff(a, prepend=-1) == 0, np.diff(b, prepend=-1) == 0
    second, third = b.copy(), c.copy()
    second[one] -= b[np.flatnonzero(one) - 1]
    third[one & two] -= c[np.flatnonzero(one & two) - 1]
    return pack(np.diff(a, prepend=0), second, third, *others)


def _since(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running sums that begin anew where ``start`` holds."""
    total = np.cumsum(x)
    first = np.flatnonzero(start)
    return total - (total[first] - x[first])[np.cumsum(start) - 1]


def _decode(data: bytes) -> list[np.ndarray]:
    """The columns of ``_encode``."""
    step, second, third, *others = unpack(data)
    if not len(step):
        return [step, second, third, *others]
    new = step != 0
    new[0] = True
    b = _since(second, new)
    fresh = new | (second != 0)
    return [np.cumsum(step), b, _since(third, fresh), *others]


@dataclass
class _Piece:
    """Documents of a piece with the numbers (``ids``) and counts of their distinct words; tokens and windows as places in these."""

    doc: np.ndarray
    valid: np.ndarray
    learn: np.ndarray
    size: np.ndarray
    token: np.ndarray
    ids: np.ndarray
    counts: np.ndarray

    def windows(self, texts: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Distinct windows (a, b, c) as places in ``ids`` in order of numbers, which one starts before each token, and each token's document. ``texts``: how many texts were learned from."""
        n, end = self.size, self.token[-1]
        self.ids, self.counts = np.append(self.ids, [AFTER, BEFORE]), np.append(self.counts, [0, texts])
        first = np.cumsum(n + 3) - (n + 3)
        row = np.repeat(np.arange(len(n)), n)
        sequence = np.empty(int(n.sum()) + 3 * len(n), dtype=np.int64)
        sequence[first] = len(self.ids) - 1
        sequence[np.arange(len(row)) + 3 * row + 1] = self.token[:-1]
        sequence[first + n + 1], sequence[first + n + 2] = end, len(self.ids) - 2
        of = np.repeat(np.arange(len(n)), n + 1)
        start = np.arange(len(of)) + 2 * of
        order = np.argsort(self.ids, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        found, which = _distinct(*(rank[sequence[start + k]] for k in range(3)))
        return [order[x] for x in found], which, of


def _read_piece(docs: bytes, ids: np.ndarray, counts: np.ndarray) -> _Piece:
    doc, valid, learn, size, place, often = unpack(docs)
    return _Piece(doc, valid.astype(bool), learn.astype(bool), size, _by_frequency(often)[place], ids, counts)


def _looked_up(piece: _Piece, window: list[np.ndarray]) -> np.ndarray:
    """Windows whose first two tokens are known: no other is in a trie."""
    return (piece.ids[window[0]] != UNKNOWN) & (piece.ids[window[1]] != UNKNOWN)


def _window_rows(texts: int, shard_rows: int):
    def rows(pieces: pa.Table, answers: pa.Table) -> pa.Table:
        W.tidy("ngram_lm")
        out = []
        said = answers.sort_by("shard").select(["ids", "counts"]).to_pylist()
        for asked in pieces.to_pylist():
            ids, counts = (np.concatenate([unpack(x[c])[0] for x in said]) for c in ("ids", "counts"))
            piece = _read_piece(asked["docs"], ids, counts)
            window, which, of = piece.windows(texts)
            seen = np.bincount(which[piece.learn[of]], minlength=len(window[0])).astype(np.int64)
            known = _looked_up(piece, window)
            a, b, c = (piece.ids[x][known] for x in window)
            often = piece.counts[window[0]][known] > shard_rows // 2
            (x, y), pair = _distinct(a[often], b[often])
            n = np.bincount(pair, minlength=len(x))
            heavy = n > len(a) // (2 * SHARE)
            packed = _encode(a, b, c, seen[known], piece.counts[window[0]][known] * often)
            out.append((asked["piece"], len(a), packed, [{"a": int(i), "b": int(j), "n": int(k)} for i, j, k in zip(x[heavy], y[heavy], n[heavy], strict=True)]))
        heavy_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))
        kinds = [("piece", pa.int64()), ("n_windows", pa.int64()), ("windows", pa.binary()), ("heavy", heavy_type)]
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], schema=pa.schema(kinds))

    return rows


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return W.pairs(a.astype(np.uint64), b.astype(np.uint64))


def _route(a: np.ndarray, b: np.ndarray, c: np.ndarray, often: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each window: by its shortest prefix that is not too frequent for one."""
    pair = _pair_key(a, b)
    key = np.where(often, pair, W.mix(a.astype(np.uint64)))
    key = np.where(often & np.isin(pair, hot), W.pairs(pair, c.astype(np.uint64)), key)
    return (key % np.uint64(shards)).astype(np.int64)


def _slice_windows(shards: int, hot: np.ndarray):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, packed in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                a, b, c, seen, often = _decode(packed)
                of = _route(a, b, c, often > 0, hot, shards)
                order = np.argsort(of, kind="stable")
                edge = np.append(np.flatnonzero(np.diff(of[order], prepend=-1)), len(of))
                for i, j in zip(edge[:-1], edge[1:], strict=True):
                    some = order[i:j]
                    yield row("shard long, piece long, windows binary", int(of[some[0]]), piece, _encode(a[some], b[some], c[some], seen[some], often[some]))

    return cut_up


def _count_pairs(hot: np.ndarray):
    """How often training documents have the pairs in ``hot``, by key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hot), dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                a, b, _, seen, _ = _decode(packed)
                key = _pair_key(a, b)
                there = np.isin(key, hot)
                np.add.at(total, np.searchsorted(hot, key[there]), seen[there])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hot))), pa.array(total)], names=["pair", "n"])

    return count


def _code(share: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(share) * GRID), NONE - 1).astype(np.uint16)


def _relative(ids: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Ids that increase below each parent, as one monotone sequence: each has the last value of the range before added."""
    last = np.flatnonzero(np.append(np.diff(parent) != 0, True)) if len(parent) else np.empty(0, np.int64)
    base = np.append(0, np.cumsum(ids[last]))
    return ids + base[np.cumsum(np.append(0, np.diff(parent) != 0))] if len(ids) else ids


def build_trie(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, often: np.ndarray, hot: np.ndarray, hot_n: np.ndarray) -> bytes:
    """The trie of distinct windows in order, each seen ``n`` times. ``often``: the first token's count where its windows are in other shards too, else 0; ``hot``, ``hot_n``: keys and counts of pairs of which that holds."""
    (first, second), pair = _distinct(a, b)
    seen = np.bincount(pair, weights=n, minlength=len(first)).astype(np.int64)
    key = _pair_key(first, second)
    there = np.isin(key, hot)
    seen[there] = hot_n[np.searchsorted(hot, key[there])]
    (word,), of = _distinct(first)
    context = np.bincount(of, weights=seen, minlength=len(word)).astype(np.int64)
    (given,), at = _distinct(a)
    total = np.zeros(len(given), dtype=np.int64)
    np.maximum.at(total, at, often)
    context = np.where(total > 0, total, context)
    levels = [
        *E.encode(word),
        *E.encode(np.searchsorted(of, np.arange(len(word) + 1))),
        *E.encode(_relative(second, of)),
        *E.encode(np.searchsorted(pair, np.arange(len(first) + 1))),
        *E.encode(_relative(c, pair)),
    ]
    return E.lay_out([*levels, _code(seen / (context[of] + PRIOR_2)), _code(n / (seen[pair] + PRIOR_3))])


class Trie:
    """Looks windows up in the mapped levels of ``build_trie``."""

    def __init__(self, blob: bytes) -> None:
        parts = E.mapped(blob)
        kinds = [np.int64, np.uint8, np.uint8, np.int64]
        self.word, self.to_second, self.second, self.to_third, self.third = (E.Monotone(*(np.frombuffer(parts[4 * k + j], t) for j, t in enumerate(kinds))) for k in range(5))
        self.second_code, self.third_code = (np.frombuffer(x, np.uint16) for x in parts[20:])

    @staticmethod
    def _below(level: E.Monotone, pointers: E.Monotone, parent: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The places of ``ids`` below their parents, -1 if not there (or no parent)."""
        out = np.full(len(ids), -1, dtype=np.int64)
        has = np.flatnonzero(parent >= 0)
        low, high = pointers.at(parent[has]), pointers.at(parent[has] + 1)
        base = np.zeros(len(has), dtype=np.int64)
        base[low > 0] = level.at(low[low > 0] - 1)
        target = ids[has] + base
        at = level.successor(low, high, target)
        inside = np.flatnonzero(at < high)
        met = inside[level.at(at[inside]) == target[inside]]
        out[has[met]] = at[met]
        return out

    def find(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of p(b|a) and p(c|ab), without their shorter contexts' parts, for distinct windows in order."""
        (first, second), pair = _distinct(a, b)
        (word,), of = _distinct(first)
        at = self.word.successor(np.zeros(len(word), np.int64), np.full(len(word), self.word.n), word)
        inside = np.flatnonzero(at < self.word.n)
        root = np.full(len(word), -1, dtype=np.int64)
        met = inside[self.word.at(at[inside]) == word[inside]]
        root[met] = at[met]
        node = self._below(self.second, self.to_second, root[of], second)
        leaf = self._below(self.third, self.to_third, node[pair], c)
        codes = [np.append(x, np.uint16(NONE)) for x in (self.second_code, self.third_code)]
        return codes[0][node][pair], codes[1][leaf]


def _answer(hot: np.ndarray, hot_n: np.ndarray, given: pa.Table | None, keep: bool, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """A shard's trie (piece null), if it is not given but to be kept, and for each piece the codes of its windows there."""
    if not table.num_rows:
        return
    shard, lists = table.column("shard")[0].as_py(), [_decode(x) for x in table.column("windows").to_pylist()]
    a, b, c, seen, often = (np.concatenate([x[k] for x in lists]) for k in range(5))
    window, which = _distinct(a, b, c)
    if given is None:
        n, context = np.bincount(which, weights=seen).astype(np.int64), np.zeros(len(window[0]), np.int64)
        np.maximum.at(context, which, often)
        learned = n > 0
        blob = build_trie(*(x[learned] for x in window), n[learned], context[learned], hot, hot_n)
        if keep:
            yield row(_ANSWERS, None, shard, blob, None, None)
    else:
        blob = given.column("trie")[0].as_py() if given.num_rows else build_trie(*[np.empty(0, np.int64)] * 5, hot, hot_n)
    second, third = (x[which].astype(np.int64) for x in Trie(blob).find(*window))
    at = 0
    for piece, x in zip(table.column("piece").to_pylist(), lists, strict=True):
        yield row(_ANSWERS, piece, shard, None, pack(second[at : at + len(x[0])]), pack(third[at : at + len(x[0])]))
        at += len(x[0])


def _score_rows(model: Model):
    shards, shard_rows, hot, total, known, texts = model.shards, model.shard_rows, model.hot, model.tokens, model.known, model.texts

    def rows(pieces: pa.Table, answers: pa.Table) -> pa.Table:
        W.tidy("ngram_lm")
        out = []
        numbered = answers.filter(pa.compute.is_valid(answers.column("ids"))).sort_by("shard").select(["ids", "counts"]).to_pylist()
        said = answers.filter(pa.compute.is_valid(answers.column("second"))).sort_by("shard").select(["second", "third"]).to_pylist()
        for blob in pieces.column("docs").to_pylist():
            piece = _read_piece(blob, *(np.concatenate([unpack(x[c])[0] for x in numbered]) for c in ("ids", "counts")))
            window, which, of = piece.windows(texts)
            looked = np.flatnonzero(_looked_up(piece, window))
            a, b, c = (piece.ids[x][looked] for x in window)
            order = looked[np.argsort(_route(a, b, c, piece.counts[window[0]][looked] > shard_rows // 2, hot, shards), kind="stable")]
            share = []
            for name in ("second", "third"):
                code = np.full(len(window[0]), NONE, dtype=np.int64)
                if said:
                    code[order] = np.concatenate([unpack(x[name])[0] for x in said])
                share.append(np.where(code == NONE, 0.0, 10.0 ** (-code / GRID)))
            context, count = piece.counts[window[0]], piece.counts[window[1]]
            pair = share[0] * (context + PRIOR_2)
            two = share[0] + PRIOR_2 / (context + PRIOR_2) * ((count + 1) / (total + known + 1))
            p = two[which]
            later = np.flatnonzero(np.diff(of, prepend=-1) == 0)
            before = which[later - 1]
            p[later] = share[1][before] + PRIOR_3 / (pair[before] + PRIOR_3) * p[later]
            n = piece.size + 1
            base = np.log10((count + 0.1) / (total + 0.1 * (known + 1)))
            out.append(
                [
                    pa.array(piece.doc, mask=~piece.valid),
                    pa.array(~piece.learn),
                    pa.array(n),
                    pa.array(np.bincount(of, weights=count[which] > 0, minlength=len(n)).astype(np.int64)),
                    pa.array(np.full(len(n), total, np.int64)),
                    pa.array(np.bincount(of, weights=base[which], minlength=len(n))),
                    pa.array(np.bincount(of, weights=np.log10(p), minlength=len(n))),
                ]
            )
        names = [x.split(" ")[0] for x in _SCORES.split(", ")]
        return pa.concat_tables([pa.Table.from_arrays(x, names=names) for x in out])

    return rows


@dataclass
class Model:
    """``words`` and ``tries`` are tables of shards; what else a look-up must know is small: ``hot`` has at most 2 * ``SHARE`` pairs."""

    words: DataFrame
    tries: DataFrame
    word_shards: int
    shards: int
    tokens: int
    known: int
    texts: int
    hot: np.ndarray
    hot_n: np.ndarray
    piece_bytes: int
    shard_rows: int


def _pieces(docs: DataFrame, id_col: str, text_col: str, learn_col: str, piece_bytes: int) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(learn_col), F.lit(False)).alias("learn"))
    return cut_in_loop(rows.mapInArrow(_tokenise(piece_bytes), _PIECES))


def _ask_words(pieces: DataFrame, shards: int, known: DataFrame | None) -> DataFrame:
    asked = pieces.select("piece", "words", "counts").mapInArrow(_slice_words(shards), "shard long, piece long, words binary, counts binary").groupBy("shard")
    if known is None:
        return asked.applyInArrow(lambda table: _as_table(_number_words(shards, None, table), _WORDS), _WORDS)
    return asked.cogroup(known.groupBy("shard")).applyInArrow(lambda table, given: _as_table(_number_words(shards, given, table), _WORDS), _WORDS)


def _windows(pieces: DataFrame, answers: DataFrame, texts: int, shard_rows: int) -> DataFrame:
    return cut_in_loop(pieces.select("piece", "docs").groupBy("piece").cogroup(answers.select("piece", "shard", "ids", "counts").groupBy("piece")).applyInArrow(_window_rows(texts, shard_rows), _WINDOWS))


def _ask_tries(windows: DataFrame, shards: int, hot: np.ndarray, hot_n: np.ndarray, given: DataFrame | None, keep: bool = False) -> DataFrame:
    asked = windows.select("piece", "windows").mapInArrow(_slice_windows(shards, hot), "shard long, piece long, windows binary").groupBy("shard")
    if given is None:
        return asked.applyInArrow(lambda table: _as_table(_answer(hot, hot_n, None, keep, table), _ANSWERS), _ANSWERS)
    return asked.cogroup(given.groupBy("shard")).applyInArrow(lambda table, trie: _as_table(_answer(hot, hot_n, trie, keep, table), _ANSWERS), _ANSWERS)


def _scores(pieces: DataFrame, numbers: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    """A piece's documents meet the numbers of their words and the codes of their windows."""
    both = answers.select("piece", "shard", "second", "third").unionByName(numbers.select("piece", "shard", "ids", "counts"), allowMissingColumns=True)
    return pieces.select("piece", "docs").groupBy("piece").cogroup(both.groupBy("piece")).applyInArrow(_score_rows(model), _SCORES)


def _hot_pairs(windows: DataFrame, shard_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys, in order, and training counts of pairs with too many windows for a shard, and how many windows there are.

    A piece tells of a pair if it has a part of ``2 * SHARE`` of its windows, so what is not told of a pair is at most that part of all.
    """
    total = windows.agg(F.sum("n_windows")).first()[0] or 0
    least = max(shard_rows // 2, total // SHARE) - total // (2 * SHARE)
    told = windows.select(F.explode("heavy").alias("h")).select("h.*").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") > least).toPandas()
    hot = np.unique(_pair_key(told["a"].to_numpy(np.int64), told["b"].to_numpy(np.int64)))
    count = np.zeros(len(hot), dtype=np.int64)
    if len(hot):
        for r in windows.select("windows").mapInArrow(_count_pairs(hot), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
            count[r["pair"]] = r["n"]
    return hot, count, total


def fit_and_score(docs: DataFrame, learn_col: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, piece_bytes: int = PIECE_BYTES, shard_rows: int = SHARD_ROWS) -> tuple[Model, DataFrame]:
    """The model of the rows where ``learn_col`` is true, and the scores of all rows, as ``score`` gives them. Its tries are written only with ``keep``.

    Each shard answers for the rows' windows as soon as its trie is built.
    """
    pieces = _pieces(docs, id_col, text_col, learn_col, piece_bytes)
    size, texts = pieces.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_texts"), F.lit(0))).first()
    word_shards = max(1, -(-size // shard_rows))
    answers = cut_in_loop(_ask_words(pieces, word_shards, None))
    words = answers.where("piece is null")
    tokens, known = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    numbers = answers.where("piece is not null")
    windows = _windows(pieces, numbers, texts, shard_rows)
    hot, hot_n, total = _hot_pairs(windows, shard_rows)
    shards = max(1, -(-total // shard_rows))
    found = cut_in_loop(_ask_tries(windows, shards, hot, hot_n, None, keep))
    scrap(windows)
    model = Model(words, found.where("piece is null").select("shard", "trie"), word_shards, shards, tokens, known, texts, hot, hot_n, piece_bytes, shard_rows)
    return model, _scores(pieces, numbers, found.where("piece is not null"), model)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row, by a model of ``fit_and_score``; scores are log10 of probabilities of whole texts.

    A null text is empty: it has its end token only. Rows may repeat and ids may be null; other columns are
    ignored. A text of any length is scored whole, in one piece; none of its words need be known. An empty table gives an empty result.
    """
    pieces = _pieces(docs.withColumn("_learn", F.lit(False)), id_col, text_col, "_learn", model.piece_bytes)
    numbers = cut_in_loop(_ask_words(pieces, model.word_shards, model.words).where("piece is not null"))
    windows = _windows(pieces, numbers, model.texts, model.shard_rows)
    return _scores(pieces, numbers, _ask_tries(windows, model.shards, model.hot, model.hot_n, model.tries), model)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity by token, of the model and of single words, for learned and held-out rows."""
    per = [F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens")).alias(name) for c, name in (("score", "model"), ("base_score", "single_words"))]
    return scores.groupBy("held_out").agg(F.count("*").alias("n_docs"), *per)

