"""Columns of integers in compressed form, and runs of whole texts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from . import words as W


def pack(*columns: np.ndarray) -> bytes:
    """Columns of integers from 0 on, by byte planes, compressed."""
    out = []
    for x in columns:
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        planes = x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T
        out.append(len(x).to_bytes(8, "little") + bytes([width]) + planes.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    """The columns of ``pack``."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, width = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8]
        planes = np.frombuffer(raw, np.uint8, count=n * width, offset=at + 9).reshape(width, n)
        full = np.zeros((n, 8), dtype=np.uint8)
        full[:, :width] = planes.T
        out.append(full.view("<u8").ravel().astype(np.int64))
        at += 9 + n * width
    return out


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows in runs of about ``limit`` bytes of ``text``, the second column, or of one longer text."""
    held, size = [], 0
    for batch in batches:
        for part in W.pieces(batch, "text", limit):
            more = W.buffers(part.column(1))[1][-1]
            if held and size + more > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield pa.Table.from_batches(held)


def row(ddl: str, *values) -> pa.RecordBatch:
    """One row of ``long`` and ``binary`` columns."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    fields = [x.split(" ", 1) for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], names=[n for n, _ in fields])
