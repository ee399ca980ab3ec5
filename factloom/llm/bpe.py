"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

Encoding. The merges become a nondeterministic transducer. It reads bytes along a trie of all tokens
and, where a token ends, may emit it and go back to the trie's root; its memory is the last token
emitted, and a token may follow another only if merging the two side by side gives back just these
two. Of all paths over a prefix exactly one ends at the root: the merges' own result for that prefix.
``Transducer`` makes this deterministic state by state, as texts need it: a state is the set of live
paths with the tokens that each still owes, and a step emits what all of them agree on. Paths differ
at most over the longest token, so a token leaves after that lookahead at the latest.

Decoding. Bytes pass a UTF-8 automaton whose state is kept between tokens, so a character that is
split over tokens, or over chunks of a stream, comes out once it is whole, and never before.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import small_batches

#: States that a worker keeps; the first ones are the frequent ones, beyond them a step is worked out each time.
KEEP_STATES = 40_000
#: Pieces and token pairs that it remembers; when full, it forgets them and starts again.
KEEP_PIECES = 250_000
KEEP_PAIRS = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _State:
    __slots__ = ("kept", "paths", "step")

    def __init__(self, paths: tuple, kept: bool) -> None:
        self.kept = kept
        self.paths = paths  # (trie node, last token, owed tokens); the first is at the root
        self.step: dict[int, tuple[tuple[int, ...], _State]] = {}


class Transducer:
    """``encode(piece)`` gives the ids of one piece of text (one match of the splitting pattern)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                    self.children[node][b] = nxt
                node = nxt
            self.token_at[node] = rank
        self._fits: dict[int, bool] = {}
        self._states: dict[tuple, _State] = {}
        self.start = self._state(((0, -1, ()),))

    def _merge(self, piece: bytes) -> list[bytes]:
        """The merges as defined, lowest rank first, leftmost of equals; only for short strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: nothing): merged side by side both stay as they are."""
        got = self._fits.get(left << 32 | right)
        if got is None:
            if len(self._fits) > KEEP_PAIRS:
                self._fits.clear()
            want = [self.bytes_of[x] for x in (left, right) if x >= 0]
            got = self._fits[left << 32 | right] = self._merge(b"".join(want)) == want
        return got

    def _state(self, paths: tuple) -> _State:
        got = self._states.get(paths)
        if got is None:
            got = _State(paths, len(self._states) < KEEP_STATES)
            if got.kept:
                self._states[paths] = got
        return got

    def _advance(self, state: _State, b: int) -> tuple[tuple[int, ...], _State]:
        moved, whole = [], None
        for node, last, owed in state.paths:
            nxt = self.children[node].get(b)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if token >= 0 and whole is None and self.fits(last, token):
                whole = (0, token, (*owed, token))
            if self.children[nxt]:
                moved.append((nxt, last, owed))
        paths = [whole, *moved]
        shared = 0
        shortest = min(len(p[2]) for p in paths)
        while shared < shortest and all(p[2][shared] == whole[2][shared] for p in moved):
            shared += 1
        out = whole[2][:shared]
        if shared:
            paths = [(node, last, owed[shared:]) for node, last, owed in paths]
        step = out, self._state(tuple(paths))
        if state.kept:
            state.step[b] = step
        return step

    def stream(self, piece: Iterable[int]) -> Iterator[int]:
        """Tokens of the bytes as they come, each after a bounded lookahead."""
        state = self.start
        for b in piece:
            out, state = state.step.get(b) or self._advance(state, b)
            yield from out
        yield from state.paths[0][2]

    def encode(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:  # a piece that is a token is that token, even where merges would stop short of it
            return [rank]
        ids: list[int] = []
        state = self.start
        for b in piece:
            step = state.step.get(b)
            if step is None:
                step = self._advance(state, b)
            if step[0]:
                ids += step[0]
            state = step[1]
        ids += state.paths[0][2]
        return ids


class Encoder:
    """Splits texts by a pattern and encodes each match separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self._seen: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if len(self._seen) > KEEP_PIECES:
            self._seen.clear()
        ids = self.transducer.encode(piece.encode())
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self._seen[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        seen, piece = self._seen.get, self._piece
        return b"".join([seen(p) or piece(p) for p in self.find(text)])


# The UTF-8 automaton: fixed by the standard (RFC 3629). State 0: between characters; 1: a byte that
# nothing may follow was seen. Others: what may follow, as (low, high, next).
_FOLLOW = {2: (0x80, 0xBF, 0), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 2), 5: (0x80, 0x9F, 2), 6: (0x90, 0xBF, 3), 7: (0x80, 0xBF, 3), 8: (0x80, 0x8F, 3)}
_LEAD = [(0x00, 0x7F, 0), (0xC2, 0xDF, 2), (0xE0, 0xE0, 4), (0xE1, 0xEC, 3), (0xED, 0xED, 5), (0xEE, 0xEF, 3), (0xF0, 0xF0, 6), (0xF1, 0xF3, 7), (0xF4, 0xF4, 8)]


def _automaton() -> list[list[int]]:
    table = [[1] * 256 for _ in range(9)]
    for low, high, to in _LEAD:
        table[0][low : high + 1] = [to] * (high + 1 - low)
    for state, (low, high, to) in _FOLLOW.items():
        table[state][low : high + 1] = [to] * (high + 1 - low)
    return table


_UTF8 = _automaton()


class StreamDecoder:
    """Feeds ids in, gets text out; a character that is not yet whole waits for its bytes."""

    def __init__(self, vocabulary: "Vocabulary") -> None:
        self.vocabulary, self.state, self.held = vocabulary, 0, b""

    def feed(self, ids: np.ndarray) -> str:
        opens = self.vocabulary.opens
        table = self.vocabulary.texts
        out: list[str] = []
        at, n = 0, len(ids)
        odd = np.flatnonzero(opens[ids])
        k = 0
        while at < n:
            if self.state == 0 and not self.held:
                k += int(np.searchsorted(odd[k:], at))
                upto = int(odd[k]) if k < len(odd) else n
                out += [table[i] for i in ids[at:upto].tolist()]
                at = upto
                if at == n:
                    break
            out.append(self._bytes(self.vocabulary.tokens[ids[at]]))
            at += 1
        return "".join(out)

    def _bytes(self, token: bytes) -> str:
        whole: list[str] = []
        for b in token:
            to = _UTF8[self.state][b]
            if to == 1:  # what was held can't become a character; b may still begin one
                if self.held:
                    whole.append("�")
                    self.held, self.state = b"", 0
                    to = _UTF8[0][b]
                if to == 1:
                    whole.append("�")
                    continue
            self.state = to
            self.held += bytes([b])
            if to == 0:
                whole.append(self.held.decode())
                self.held = b""
        return "".join(whole)

    def finish(self) -> str:
        """What is left: a replacement character if the stream ended within a character."""
        rest, self.state, self.held = "�" * bool(self.held), 0, b""
        return rest


class Vocabulary:
    """Token bytes by id, and the text of those that are whole characters."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.texts: list[str | None] = [None] * size
        self.opens = np.ones(size, dtype=bool)
        for i, token in enumerate(self.tokens):
            state = 0
            for b in token:
                state = _UTF8[state][b]
                if state == 1:
                    break
            if state == 0:
                self.texts[i] = token.decode()
                self.opens[i] = False

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join([self.tokens[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray, chunk: int = 1 << 16) -> str:
        decoder = StreamDecoder(self)
        return "".join([decoder.feed(ids[at : at + chunk]) for at in range(0, len(ids), chunk)]) + decoder.finish()


_loaded: dict[tuple[str, str], tuple[Encoder, Vocabulary]] = W.kept.setdefault("bpe", {})


def _load(path: str, pattern: str) -> tuple[Encoder, Vocabulary]:
    got = _loaded.get((path, pattern))
    if got is None:
        ranks = load_ranks(path)
        got = _loaded[path, pattern] = Encoder(ranks, pattern), Vocabulary(ranks)
    return got


def _coder(path: str, pattern: str, full: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy("bpe")
        encoder, vocabulary = _load(path, pattern)
        for batch in batches:
            for part in W.pieces(batch, "text", 1 << 20):
                rows = []
                for text in part.column(1).to_pylist():
                    packed = encoder.encode(text or "")
                    ids = np.frombuffer(packed, dtype="<u4")
                    decoded = vocabulary.decode(ids)
                    row = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append((*row, ids.astype(np.int32), decoded) if full else row)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                width = 5 if full else 3
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(width))], names=["doc_id", *names[:width]])

    return W.resting(code)


def encode_decode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` and, if ``full``, ``ids`` and ``decoded``, row by row.

    A null text counts as empty: no ids, and the hashes of nothing. Every row gives one row, rows
    that repeat and rows without an id as well; other columns are ignored. The vocabulary file must
    be readable at the same path on every executor; it is read once for each worker.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    more = ", ids array<int>, decoded string" if full else ""
    return docs.mapInArrow(_coder(vocabulary_path, pattern, full), f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
