"""Exact top-k inner-product search over a bit-sliced index.

A component x becomes the integer floor(1024 x). The index cuts the rows into blocks;
a block holds, for each component, one bitmap for each bit of (value - least value).
The weighted sum of a query is added up on bitmaps alone: a bit of a weight picks
slices, three bitmaps of a weight become one of the same and one of double weight
(full adders), until one bitmap for each bit of the sum is left. For a negative
weight the complement of the slices is added, so that all sums are non-negative.

The best rows are then selected from the most significant bitmap downward: rows with
the bit set are kept if at least k are left, else they are safe and the rest is
searched. Rows that tie at the boundary are resolved by their ids, exactly.

Vectors that are null or hold a null or non-finite component take no part, nor do
rows without id. Vectors of different lengths are not compared. Rows with the id of
the query are its own and no candidates; a query that is repeated is answered for
each row. Fewer candidates than k: all of them. An empty table gives no row.
Components of 2**62 or more after scaling raise an error.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored
from .textkernel import lean, tune

BLOCK_ROWS = 1 << 15
QUERIES = 2000  # of a task, at most


def integers(column: pa.Array, dim: int) -> np.ndarray:
    values = np.floor(1024.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim))
    if len(values) and dim and np.abs(values).max() >= 2.0**62:
        raise ValueError("a component is too large for 64-bit integers")
    return values.astype(np.int64)


class Slices:
    """Bitmaps of one block: slices[component, bit] over rows in order of id."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, bits: int, slices: np.ndarray):
        self.ids, self.least, self.bits, self.slices = ids, least, bits, slices

    @staticmethod
    def of(ids: np.ndarray, values: np.ndarray) -> Slices:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        least = values.min(0)
        raised = (values - least).astype(np.uint64).T.copy()
        bits = max(1, int(raised.max(initial=0)).bit_length())
        words = -(-len(ids) // 64)
        out = np.zeros((raised.shape[0], bits, words * 8), np.uint8)
        for b in range(bits):
            packed = np.packbits((raised >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
            out[:, b, : packed.shape[1]] = packed
        return Slices(ids, least, bits, out.view(np.uint64))

    def sums(self, weights: list[int]) -> tuple[list[np.ndarray], int]:
        """(one bitmap for each bit of the sum, least first; what to add to each row's sum)."""
        more = 0
        stack: dict[int, list[np.ndarray]] = {}
        flipped = np.array([w < 0 for w in weights])
        size = np.array([abs(w) for w in weights], dtype=object)
        for d, w in enumerate(weights):
            more += w * int(self.least[d]) - (abs(w) * ((1 << self.bits) - 1) if w < 0 else 0)
        for j in range(max((int(s).bit_length() for s in size), default=0)):
            picks = np.array([bool(int(s) >> j & 1) for s in size])
            for sign in (False, True):
                at = np.flatnonzero(picks & (flipped == sign))
                if len(at):
                    for b in range(self.bits):
                        part = self.slices[at, b]
                        stack.setdefault(j + b, []).append(~part if sign else part)
        out, weight = [], 0
        while stack:
            parts = stack.pop(weight, None)
            if parts is None:
                out.append(np.zeros(self.slices.shape[2], np.uint64))
                weight += 1
                continue
            rows = np.concatenate(parts) if len(parts) > 1 else parts[0]
            while len(rows) > 1:
                third = len(rows) // 3
                if third:
                    a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                    half = a ^ b
                    stack.setdefault(weight + 1, []).append((a & b) | (half & c))
                    rows = np.concatenate((half ^ c, rows[3 * third :]))
                else:
                    stack.setdefault(weight + 1, []).append((rows[0] & rows[1])[None])
                    rows = (rows[0] ^ rows[1])[None]
            out.append(rows[0])
            weight += 1
        return out, more

    def top(self, query_id: int, weights: list[int], k: int) -> list[tuple[int, int]]:
        """The k best (id, score), ties to the smaller id; rows with the query's own id left out."""
        sums, more = self.sums(weights)
        keep = np.zeros(self.slices.shape[2] * 64, np.uint8)
        keep[: len(self.ids)] = self.ids != query_id
        open_ = np.packbits(keep, bitorder="little").view(np.uint64)
        safe = np.zeros_like(open_)
        for bitmap in reversed(sums):
            tried = safe | (open_ & bitmap)
            n = int(np.bitwise_count(tried).sum())
            if n >= k:
                open_ = open_ & bitmap
                if n == k:
                    break
            else:
                safe, open_ = tried, open_ & ~bitmap
        rows = members(safe)
        rows = np.concatenate((rows, members(open_)[: max(0, k - len(rows))]))  # in order of id
        bits = np.array([(s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1) for s in sums], np.uint64) if sums else np.zeros((0, len(rows)), np.uint64)
        scores = [sum(int(b) << i for i, b in enumerate(bits[:, r])) + more for r in range(len(rows))]
        if any(abs(s) >= 1 << 63 for s in scores):
            raise OverflowError("a score does not fit 64 bits")
        return [(int(self.ids[r]), s) for r, s in zip(rows.tolist(), scores, strict=True)]


def members(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


INDEX = "block long, dim int, ids binary, least binary, bits int, slices binary"


def _build(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def rows_of(dim: int) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            s = Slices.of(ids, values)
            name = zlib.crc32(s.ids.tobytes(), dim)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([dim], pa.int32()), pa.array([s.ids.tobytes()], pa.binary()), pa.array([s.least.tobytes()], pa.binary()), pa.array([s.bits], pa.int32()), pa.array([s.slices.tobytes()], pa.binary())], ["block", "dim", "ids", "least", "bits", "slices"])

        for batch in batches:
            ids, vectors = batch.column("vec_id").to_numpy(), batch.column("vector")
            dims = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                values = integers(vectors.take(pa.array(at)), dim)
                for a in range(0, len(at), block_rows):
                    held.setdefault(dim, []).append((ids[at[a : a + block_rows]], values[a : a + block_rows]))
                    if sum(len(x) for x, _ in held[dim]) >= block_rows:
                        yield rows_of(dim)
        for dim in sorted(held):
            yield rows_of(dim)

    return run


def _search(k: int):
    def run(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if index.num_rows and queries.num_rows:
            vectors = queries["vector"].combine_chunks()
            dims = np.diff(vectors.offsets.to_numpy())
            for dim, ids, least, bits, slices in zip(*(index[c].to_pylist() for c in ("dim", "ids", "least", "bits", "slices")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                block = Slices(ids, np.frombuffer(least, np.int64), bits, np.frombuffer(slices, np.uint64).reshape(dim, bits, -(-len(ids) // 64)))
                at = np.flatnonzero(dims == dim)
                values = integers(vectors.take(pa.array(at)), dim).tolist()
                for i, weights in zip(at.tolist(), values, strict=True):
                    q, row = queries["query_id"][i].as_py(), queries["row"][i].as_py()
                    out += [(q, row, v, s) for v, s in block.top(q, weights, k)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["query_id", "row", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for each row of ``queries``; both have vec_id and embedding.

    Each task holds some index blocks and at most QUERIES queries; the index is
    written once and every query meets every block.
    """
    spark = vectors.sparkSession
    tune(spark)
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = lambda df: df.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    index = stored(usable(vectors).mapInArrow(lean(_build(block_rows)), INDEX), "bit-slices")
    asked = stored(usable(queries).select(F.col("vec_id").alias("query_id"), F.monotonically_increasing_id().alias("row"), "vector"), "queries")
    blocks, n = max(1, index.count()), asked.count()
    lanes = min(blocks, 4096)
    groups = max(1, math.ceil(n / QUERIES), math.ceil(2 * spark.sparkContext.defaultParallelism / lanes))
    left = index.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    found = left.groupBy("lane", "part").cogroup(right.groupBy("lane", "part")).applyInArrow(_search(k), "query_id long, row long, vec_id long, score long")
    best = W.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
