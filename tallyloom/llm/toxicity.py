"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of its words' character n-grams (3 to 5 code points, with a mark at
either end of a word) and of its whole words, hashed into buckets. Each bucket has
a vector; the mean over the bag goes through a linear softmax. Vectors and softmax
are trained jointly in numpy (Adagrad, one text at a time) on a bounded sample of
labelled texts, as many of each class, with the classes' true shares put back as a
bias. An unseen misspelling shares most of its n-grams' vectors with the word.

Since the classifier is linear, scoring needs one number for each bucket, and the
score of a text is an average over its whole bag. Null and empty texts, or texts
without a word, have the bias alone. Labels other than 0 and 1 don't teach; an id with
several labels is toxic if one says so, and of several texts under one id the least
teaches. Without both classes every score is the share of the one there is, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import extended, fold
from .textkernel import characters, lean, mix, _powers, slices, tune, utf8

BITS = 18
SIZE = 1 << BITS
ORDERS = (3, 4, 5)
#: Bound of the labelled sample, in texts of each class.
SAMPLE = 5000
#: So many neutral subwords are in every bag; a text of a few words is then no extreme.
NEUTRAL = 1000
#: Bytes of features that the one training task may hold; longer samples stop at that many, in hashed order.
SAMPLE_BYTES = 256 << 20
_U = np.uint64
_LOWER = np.arange(128, dtype=np.uint32)
_LOWER[65:91] += 32
_BREAK = np.array([b < 128 and not chr(b).isalnum() and b != 39 for b in range(128)])
_LOWER[_BREAK] = 32


def bag(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each subword of the texts, by order of n-gram."""
    n = len(offsets) - 1
    points, _, offsets = characters(raw, offsets)
    # Marks before, between and after the texts.
    text = np.insert(points, offsets, 10).astype(np.uint32)
    text = np.where(text < 128, _LOWER[np.minimum(text, 127)], text)
    stop = text == 32
    value = text.astype(np.uint64) * _U(0x9E3779B97F4A7C15) | _U(1)
    up, down = _powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(value * up[: len(text)], out=total[1:])
    borders = offsets + np.arange(n + 1)
    keys, places = [], []
    for size in ORDERS:
        m = len(text) - size + 1
        if m <= 0:
            continue
        whole = ~stop[1 : m + 1]
        for j in range(2, size - 1):
            whole &= ~stop[j : m + j]
        at = np.flatnonzero(whole)
        keys.append(((total[at + size] - total[at]) * down[at] + _U(size)) * _U(0xBF58476D1CE4E5B9) >> _U(64 - BITS))
        places.append(at)
    begins = np.flatnonzero(~stop[1:] & stop[:-1]) + 1
    ends = np.flatnonzero(stop[1:] & ~stop[:-1]) + 1
    keys.append(mix((total[ends] - total[begins]) * down[begins]) >> _U(64 - BITS))
    places.append(begins)
    place = np.concatenate(places)
    # A row's text begins after its border's mark; n-grams may begin on the mark itself.
    return np.concatenate(keys).astype(np.int32), np.searchsorted(borders, place, "right") - 1


class Joint:
    """Bucket vectors and a linear softmax, trained together."""

    def __init__(self, dim: int = 8, seed: int = 5):
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.05, (SIZE, dim)).astype(np.float32)
        self.w = r.normal(0, 0.5, (dim, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.ge, self.gw, self.gb = np.full(SIZE, 1e-8, np.float32), np.full((dim, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)

    def learn(self, keys: np.ndarray, share: np.ndarray, label: int, rate: float) -> float:
        rows = self.e[keys]
        mean = share @ rows
        logit = mean @ self.w + self.b
        p = np.exp(logit - logit.max())
        p /= p.sum()
        loss = -float(np.log(p[label] + 1e-9))
        p[label] -= 1
        back = self.w @ p
        gw = np.outer(mean, p)
        self.gw += gw * gw
        self.w -= 0.1 * rate * gw / np.sqrt(self.gw)
        self.gb += p * p
        self.b -= 0.1 * rate * p / np.sqrt(self.gb)
        self.ge[keys] += share * share * float(back @ back)
        self.e[keys] = rows - rate * (share / np.sqrt(self.ge[keys]))[:, None] * back
        return loss

    def bucket_scores(self) -> tuple[np.ndarray, float]:
        turn = self.w[:, 1] - self.w[:, 0]
        return self.e @ turn, float(self.b[1] - self.b[0])


def train(data: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 10, rate: float = 2.0, seed: int = 5) -> Joint:
    model, r = Joint(seed=seed), np.random.default_rng(seed)
    for epoch in range(epochs):
        for i in r.permutation(len(data)):
            model.learn(*data[i], rate * (1 - epoch / epochs))
    return model


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        blobs = []
        for lo, hi in slices(offsets):
            key, row = bag(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            pairs, times = np.unique(row.astype(np.int64) << BITS | key, return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(hi - lo + 1) << BITS)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                blobs.append(((pairs[a:b] & (SIZE - 1)).astype("<u4").tobytes(), times[a:b].astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([a for a, _ in blobs], pa.binary()), pa.array([b for _, b in blobs], pa.binary())], ["doc_id", "label", "features", "counts"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fit on the whole bounded sample in one task; the driver gets one number for each bucket."""
    data, room = [], SAMPLE_BYTES
    for batch in batches:
        for doc, label, features, counts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "features", "counts")), strict=True):
            key, times = np.frombuffer(features, "<u4"), np.frombuffer(counts, "<u4").astype(np.float32)
            room -= len(features) + len(counts)
            if len(key) and room > 0:
                data.append((doc, key, times / (times.sum() + NEUTRAL), label))
    data = [x[1:] for x in sorted(data, key=lambda x: x[0])]
    ones = sum(x[2] for x in data)
    scores, bias = train(data).bucket_scores() if 0 < ones < len(data) else (np.zeros(0), 0.0)
    yield pa.RecordBatch.from_arrays([pa.array([scores.astype("<f4").tobytes()], pa.binary()), pa.array([bias]), pa.array([ones]), pa.array([len(data)])], ["scores", "bias", "ones", "n"])


class Model:
    def __init__(self, scores: np.ndarray, bias: float):
        self.scores, self.bias = scores, bias

    def score(self, column: pa.Array) -> np.ndarray:
        raw, offsets = utf8(column)
        out = np.empty(len(column))
        for lo, hi in slices(offsets):
            key, row = bag(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            n = hi - lo
            size = np.bincount(row, minlength=n)
            out[lo:hi] = np.bincount(row, self.scores[key], n) / (size + NEUTRAL)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, label (0 or 1). Learns from all ids in ``labels``, up to ``size`` of each class."""
    tune(docs.sparkSession)
    clean = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = clean.agg(F.avg("label")).first()[0]
    order = F.xxhash64("doc_id")
    chosen = clean.where("label = 1").orderBy(order, "doc_id").limit(size).unionByName(clean.where("label = 0").orderBy(order, "doc_id").limit(size))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 x size rows at most
    rows = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).mapInArrow(lean(_featurise), "doc_id long, label int, features binary, counts binary")
    found = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id")).mapInArrow(lean(_train), "scores binary, bias double, ones long, n long").collect() if share is not None else []
    if not found or not found[0].scores:
        return Model(np.zeros(SIZE, np.float32), 30.0 if share else -30.0)
    r = found[0]
    return Model(np.frombuffer(r.scores, "<f4"), r.bias + float(np.log(share / (1 - share)) - np.log(r.ones / (r.n - r.ones))))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with a score; a narrow pass."""
    tune(df.sparkSession)
    kept = df.drop("score")
    shared = df.sparkSession.sparkContext.broadcast(model)  # SIZE floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column(text)))], [*batch.schema.names, "score"])

    return kept.mapInArrow(lean(run), extended(kept.schema, score="double"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    taught = labels.select("doc_id", F.col("toxic").alias("label")).where(fold("doc_id", 3) != 1)
    model = fit(docs, taught)
    out = score(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
