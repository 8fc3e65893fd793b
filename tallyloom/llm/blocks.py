"""Corpus-wide counts by block requests and bucket answers.

Counting every n-gram of a corpus by a row each would shuffle the corpus many
times over. Here a task sums what it meets in a block of texts (about 8 MB), sorts
the distinct 64-bit keys and cuts them at bucket borders; one row holds a whole
(block, bucket) piece. A bucket's task merges the pieces of its key range and
answers each with totals in the order asked, so keys never travel back. A key that
is in every text comes once from each block, so hot keys don't gather rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textkernel import pack_counts, pack_sorted, slices, unpack_counts, unpack_sorted, utf8

BLOCK_BYTES = 8 << 20


def grouped(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool]]:
    """(rows, bytes, offsets, whether a block begins here), in slices of about 1 MB."""
    seen, first = 0, True
    for batch in batches:
        raw, offsets = utf8(batch.column(text))
        for lo, hi in slices(offsets):
            if seen > limit:
                seen, first = 0, True
            yield batch.slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], first
            seen, first = seen + int(offsets[hi] - offsets[lo]) + 16 * (hi - lo), False


def runs(*ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of neighbours that are equal in all arrays."""
    n = len(ids[0])
    cuts = (np.flatnonzero(np.logical_or.reduce([np.diff(x) != 0 for x in ids])) + 1).tolist()
    yield from zip([0, *cuts], [*cuts, n], strict=True) if n else ()


def bucket_cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Positions in ascending keys where each of n equal key ranges begins, and the end."""
    borders = np.array([((k << 64) + n - 1) // n for k in range(1, n)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, borders), [len(keys)]))


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, one position of each, number of each position's key); by a fast unstable sort."""
    by = np.argsort(keys)
    ordered = keys[by]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[by] = np.cumsum(new) - 1
    return ordered[new], by[new], number


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, totals, totals in the order of each input)."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    found, _, number = ranked(np.concatenate(keys))
    totals = np.zeros(len(found), np.int64)
    at = 0
    for c in counts:  # keys are distinct within an input
        totals[number[at : at + len(c)]] += c
        at += len(c)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return found, totals, np.split(totals[number], cuts)


__all__ = ["BLOCK_BYTES", "bucket_cuts", "grouped", "merge_counts", "pack_counts", "pack_sorted", "ranked", "runs", "unpack_counts", "unpack_sorted"]
