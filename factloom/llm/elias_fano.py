"""Monotone sequences in Elias-Fano form: high bits in unary, low bits packed, read in place by vectorised select and successor search."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_CHUNK = 1 << 18


def encode(values: np.ndarray) -> list[np.ndarray]:
    """Parts of a non-decreasing sequence of integers from 0 on: head (length, low bits), low bits, high bits, ones before each 64 high bits."""
    n = len(values)
    if not n:
        return [np.zeros(2, np.int64), np.empty(0, np.uint8), np.empty(0, np.uint8), np.zeros(1, np.int64)]
    values = values.astype(np.int64)
    width = max(0, (int(values[-1]) // n).bit_length() - 1)
    low = np.concatenate([((values[k : k + _CHUNK, None] >> np.arange(width)) & 1).astype(np.uint8).ravel() for k in range(0, n, _CHUNK)])
    place = (values >> width) + np.arange(n)
    high = np.zeros(-(-int(place[-1] + 1) // 64) * 64, dtype=np.uint8)
    high[place] = 1
    packed = np.packbits(high, bitorder="little")
    ones = np.cumsum(np.bitwise_count(packed.view("<u8")), dtype=np.int64)
    bits = np.packbits(low, bitorder="little")
    return [np.array([n, width], np.int64), np.append(bits, np.zeros(16 - len(bits) % 8, np.uint8)), packed, np.append(0, ones)]


def _select(word: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The place of the ``left``-th one, from 0 on, of each 64-bit word: by halves."""
    place = np.zeros(len(word), dtype=np.uint64)
    left = left.astype(np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        step = np.uint64(width)
        ones = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.uint64)
        up = left >= ones
        left -= ones * up
        move = step * up
        word = word >> move
        place += move
    return place.astype(np.int64)


class Monotone:
    """A sequence of ``encode``, read where it lies."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.width = int(head[0]), int(head[1])
        self.low, self.high, self.ones = low.view("<u8"), high.view("<u8"), ones

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        out = np.empty(len(i), dtype=np.int64)
        for k in range(0, len(i), _CHUNK):
            some = i[k : k + _CHUNK]
            word = np.searchsorted(self.ones, some, side="right") - 1
            value = word * 64 + _select(self.high[word], some - self.ones[word]) - some
            if self.width:
                bit = some * self.width
                at, off = bit >> 6, (bit & 63).astype(np.uint64)
                # a shift by 64 bits is not defined: the next word comes in two steps
                raw = (self.low[at] >> off) | ((self.low[at + 1] << np.uint64(1)) << (np.uint64(63) - off))
                value = (value << self.width) | (raw & np.uint64((1 << self.width) - 1)).astype(np.int64)
            out[k : k + _CHUNK] = value
        return out

    def successor(self, low: np.ndarray, high: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first places in ``[low, high)`` whose values are not under ``target``; ``high`` if there is none."""
        low, high = low.copy(), high.copy()
        left = np.flatnonzero(low < high)
        while len(left):
            middle = (low[left] + high[left]) >> 1
            under = self.at(middle) < target[left]
            low[left[under]] = middle[under] + 1
            high[left[~under]] = middle[~under]
            left = left[low[left] < high[left]]
        return low


def lay_out(parts: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each from a multiple of 8 bytes on, behind their sizes."""
    sizes = np.array([len(parts), *(x.nbytes for x in parts)], dtype=np.int64)
    return b"".join([sizes.tobytes(), *(x.tobytes() + bytes(-x.nbytes % 8) for x in parts)])


def mapped(blob: bytes) -> list[memoryview]:
    """The arrays of ``lay_out`` as views of a mapped file, which has no name and goes with the last view."""
    with tempfile.TemporaryFile() as file:
        file.write(blob)
        file.flush()
        view = memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
    sizes = np.frombuffer(view, np.int64, count=int(np.frombuffer(view, np.int64, count=1)[0]) + 1)
    out, at = [], sizes.nbytes
    for size in sizes[1:].tolist():
        out.append(view[at : at + size])
        at += size + -size % 8
    return out
