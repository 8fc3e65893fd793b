"""Vectorised text primitives shared by the corpus operators.

Everything here works on Arrow record batches inside ``mapInArrow`` tasks: the
UTF-8 buffer of a string column is viewed as a numpy array, so splitting and
hashing words costs a few nanoseconds a byte and no Python object per word.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; A-Z count as
a-z. A word is known by a 64-bit polynomial hash (bytes mapped through a fixed
random table, modulus 2**64, then mixed). Null texts behave as empty ones.
Memory follows the slice size and the longest single text, never the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER] | _U(1)
_POWERS: dict[str, np.ndarray] = {}


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python tasks receive, by rows and bytes."""
    for key, value in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", str(4 << 20))):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def release() -> None:
    """Give freed memory back to the system: workers live on between stages, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that releases its memory when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        n = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _P), ("down", _PINV)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return raw[lo:hi], offsets - lo


def characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code point, first byte, offsets in characters) of each character; bytes that continue none count as one each."""
    goes_on = (raw & 0xC0) == 0x80
    if not goes_on.any():
        return raw.astype(np.uint32), np.arange(len(raw)), offsets
    begins = ~goes_on
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, len(raw)))
    lead = raw[at].astype(np.uint32)
    points = np.where(size == 1, lead, lead & (0x7F >> np.minimum(size, 4)).astype(np.uint32))
    for k in range(1, int(min(size.max(), 4))):
        more = np.flatnonzero(size > k)
        points[more] = points[more] << np.uint32(6) | (raw[at[more] + k] & np.uint32(0x3F))
    return points, at, np.searchsorted(at, offsets)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; a longer text stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, stop
        row = stop


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and exclusive end of each word; texts end words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SEP[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    lasts = firsts[1:] - 1
    ends[lasts] = inside[lasts]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span; values: one uint64 per symbol."""
    up, down = _powers(len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word, in order. Long texts are hashed piece by piece, cut before words."""
    starts, ends = word_bounds(raw, offsets)
    rows = np.searchsorted(offsets, starts, "right") - 1
    if len(raw) <= 2 * SLICE_BYTES:
        return span_hashes(_BYTE[raw], starts, ends), rows
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        lo, hi = starts[at], ends[stop - 1]
        out[at:stop] = span_hashes(_BYTE[raw[lo:hi]], starts[at:stop] - lo, ends[at:stop] - lo)
        at = stop
    return out, rows


def hash_word(word: str) -> int:
    """The hash that a single word has; for tests and small tables."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(_BYTE[raw], np.array([0]), np.array([len(raw)]))[0])


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``size`` words; a shorter text with words is one run."""
    if not len(hashes):
        return hashes, rows
    if len(hashes) >= size:
        run = np.zeros(len(hashes) - size + 1, np.uint64)
        for j in range(size):
            run = run * _U(_P) + hashes[j : j + len(run)]
        whole = rows[: len(run)] == rows[size - 1 :]
        out, at = mix(run[whole]), rows[: len(run)][whole]
    else:
        out, at = np.zeros(0, np.uint64), np.zeros(0, rows.dtype)
    counts = np.bincount(rows)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        begins = np.concatenate(([0], np.cumsum(counts)))[short]
        extra = np.empty(len(short), np.uint64)
        for k, (b, r) in enumerate(zip(begins, short, strict=True)):
            h = int(counts[r])
            for x in hashes[b : b + counts[r]].tolist():
                h = (h * _P + x) & (1 << 64) - 1
            extra[k] = h
        out, at = np.concatenate((out, mix(extra))), np.concatenate((at, short))
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def distinct(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs sorted by row, then key."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    if len(keys):
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        keys, rows = keys[new], rows[new]
    return keys, rows


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending uint64 values as byte-truncated differences."""
    if not len(x):
        return b""
    step = np.diff(x, prepend=_U(0))
    first, step[0] = int(step[0]), 0
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    body = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + first.to_bytes(8, "little") + body.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width, first = blob[0], int.from_bytes(blob[1:9], "little")
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    full = np.zeros((len(body), 8), np.uint8)
    full[:, :width] = body
    return np.cumsum(full.reshape(-1).view("<u8")) + _U(first)


def pack_counts(x: np.ndarray) -> bytes:
    """Non-negative integers in the least of 1, 2, 4 or 8 bytes each."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)
