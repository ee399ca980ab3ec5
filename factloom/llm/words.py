"""Vectorised word splitting and hashing over Arrow text buffers.

Words are maximal runs of bytes of one class. Both classes used here hold every byte from 0x80
up, so cutting UTF-8 by bytes equals cutting it by characters. A word's hash is a polynomial over
random byte values modulo 2**64, read off a running sum, then mixed; no Python object is made
per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_PIECE = 1 << 18
_U = np.uint64


def _table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.int64).astype(_U) * _U(2) + _U(1)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUES = _table(7, 256)
_VALUES_FOLDED = _VALUES[_FOLD]
_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INVERSE = pow(_RADIX, -1, 2**64)

#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i under ``n``."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.empty(size, dtype=_U)
        have[0] = 1
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * _U(pow(base, done, 2**64))
            done *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Block:
    """Some rows' words. ``first[i]:first[i + 1]`` are row i's words; ``start``, ``end`` are their places in ``data``."""

    data: np.ndarray
    text_at: np.ndarray
    valid: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets into them and validity of a string or binary array; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string())
    n = len(column)
    if column.null_count:
        valid = np.asarray(column.is_valid())
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    else:
        valid = np.ones(n, dtype=bool)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64), valid
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=n + 1, offset=column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0], valid


def split(column: pa.Array, classes: np.ndarray, fold: bool, with_hash: bool = True) -> Block:
    """Words of every row of ``column``; ``fold`` hashes A-Z as a-z."""
    data, at, valid = buffers(column)
    values = _VALUES_FOLDED if fold else _VALUES
    n = len(data)
    member = classes[data]
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = member[:-1]
        after[:-1] = member[1:]
        filled = at[:-1][at[:-1] < at[1:]]
        before[filled] = False
        after[filled[1:] - 1] = False
    start = np.flatnonzero(member & ~before)
    end = np.flatnonzero(member & ~after) + 1
    hashes = np.empty(len(start) if with_hash else 0, dtype=_U)
    done = 0
    while with_hash and done < len(start):
        base = start[done]
        upto = max(done + 1, int(np.searchsorted(end, base + _PIECE, side="right")))
        s, e = start[done:upto] - base, end[done:upto] - base
        size = int(e[-1])
        total = np.zeros(size + 1, dtype=_U)
        np.cumsum(values[data[base : base + size]] * _power(_RADIX, size), out=total[1:])
        got = (total[e] - total[s]) * _power(_RADIX_INVERSE, size)[s]
        hashes[done:upto] = mix(got + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        done = upto
    return Block(data, at, valid, np.searchsorted(start, at).astype(np.int64), start, end, hashes)


def word_hash(word: bytes) -> int:
    """The hash that ``split`` gives this word."""
    return int(split(pa.array([word], pa.binary()), np.ones(256, dtype=bool), fold=False).hash[0])


_STEPS = _table(11, 64)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each place on; the last ``n - 1`` places have none."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, dtype=_U)
    total = hashes[:size] * _STEPS[0]
    for k in range(1, n):
        total += hashes[k : k + size] * _STEPS[k % 64] + _U(k // 64)
    return mix(total)


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(left * _STEPS[0] + right * _STEPS[1])


def pieces(batch: pa.RecordBatch, text: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``limit`` bytes, at least one row each."""
    _, at, _ = buffers(batch.column(batch.schema.get_field_index(text)))
    row = 0
    while row < batch.num_rows:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield batch.slice(row, upto - row)
        row = upto


#: What operators keep in a worker between tasks, by operator: emptied when the worker goes on to another one.
kept: dict[str, dict] = {}
#: Seconds that a worker is idle until it drops them: stages without Python, in which no task begins here, leave that memory to the JVM.
IDLE = 2.0
_waiting: list[threading.Timer] = []


def tidy(operator: str) -> None:
    """Call as a task begins: drop what other operators keep here, and give freed memory back to the system where the C library can."""
    while _waiting:
        _waiting.pop().cancel()
    others = [x for name, x in kept.items() if name != operator and x]
    for x in others:
        x.clear()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _rest() -> None:
    """Unless another task begins here within ``IDLE`` seconds, drop all that is kept."""
    _waiting.append(threading.Timer(IDLE, tidy, [""]))
    _waiting[-1].daemon = True
    _waiting[-1].start()


def resting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function whose worker gives back what it keeps, and its freed memory, if it then stays idle."""

    def then_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _rest()

    return then_rest
