"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Features are hashed n-grams of one to three characters (code points; A-Z as a-z,
everything in ASCII that is no letter as one blank). Document frequencies cover every
training text. The weights come from follow-the-regularised-leader with elastic-net
penalties on a bounded, hashed sample (``SAMPLE`` texts, spread evenly over the
languages, at least one of each); a fifth of it only sets the softmax temperature.
Every language in the training rows is learned. The model has ``WEIGHTS`` weights at
most: the more languages, the fewer buckets the n-grams are hashed into.

Predictions see the whole text and nothing else. Texts that are null or have no
letter are ``und`` with score 0, and so is every text if there is nothing to learn
from. A text without any feature known has all languages alike. Rows without lang
don't teach. Ties go to the language that sorts first. Repeated rows and null ids
are rows like others; columns named ``lang_pred`` or ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import extended, fold
from .textkernel import characters, lean, slices, tune, utf8

BITS = 15
#: Bound of the labelled sample that the classifier is fitted on, and of the numbers in a model.
SAMPLE, WEIGHTS = 4000, 1 << 23
_U = np.uint32
_MAP = np.arange(128, dtype=np.uint32)
_MAP[65:91] += 32
_MAP[[b for b in range(128) if not chr(b).isalpha()]] = 32


def feature_bits(languages: int) -> int:
    """Bits of a feature such that all languages' weights stay within WEIGHTS; at least 2^8 features."""
    return max(8, min(BITS, (WEIGHTS // max(1, languages)).bit_length() - 1))


def grams(points: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Feature of the 1-, 2- and 3-gram that begins at each character; n-grams over a text's end count as feature 0."""
    x = np.where(points < 128, _MAP[np.minimum(points, 127)], points) + _U(1)
    out = np.zeros((3, len(x)), np.uint16)
    key = np.zeros(len(x), np.uint32)
    some = offsets[:-1] < offsets[1:]  # an empty text has no end of its own
    begins, ends = offsets[:-1][some], offsets[1:][some]
    for n in range(3):
        key[: len(x) - n] = key[: len(x) - n] * _U(0x01000193) + x[n:]
        mixed = (key ^ _U(n)) * _U(0x9E3779B1)
        out[n] = (mixed ^ (mixed >> _U(15))) >> _U(32 - bits)
        for back in range(1, n + 1):
            out[n][np.maximum(ends - back, begins)] = 0
    return out


def vectors(column: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, counts) of each text."""
    raw, offsets = utf8(column)
    for lo, hi in slices(offsets):
        points, _, own = characters(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        keys = grams(points, own, bits) if own[-1] else np.zeros((3, 0), np.uint16)
        for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
            counts = np.bincount(keys[:, a:b].ravel(), minlength=1 << bits)
            counts[0] = 0
            found = np.flatnonzero(counts)
            yield found, counts[found]


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    return x / max(float(np.sqrt(x @ x)), 1e-12)


class Ftrl:
    """Multinomial logistic regression, one sparse example at a time."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z = self.z[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[rows])) / self.alpha + self.l2)

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        before = self.n[rows]
        after = before + g * g
        self.z[rows] += g - (np.sqrt(after) - np.sqrt(before)) / self.alpha * w
        self.n[rows] = after


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The softmax temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()
    lo, hi, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for found, _ in vectors(batch.column("text"), bits):
                seen[found] += 1
                total += 1
        seen[0] = total  # feature 0 is unused; its place holds the number of texts
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["feature", "texts"])

    return run


def _featurise(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a.astype("<u2").tobytes(), np.minimum(b, 0xFFFFFFFF).astype("<u4").tobytes()) for a, b in vectors(batch.column("text"), bits)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("mark"), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], ["lang", "mark", "features", "counts"])

    return run


def sample(train: DataFrame, each: int) -> DataFrame:
    """At most ``each`` training rows of each language, chosen by hash. Only marks and languages are shuffled.

    The caller holds the languages' names, so one row for each is small enough to send out.
    """
    mark = F.xxhash64(F.col("doc_id"), F.col("text"))
    marked = train.select("lang", "text", mark.alias("mark"))
    # The least marks of each salt, then of each language, so that no task sorts a whole language.
    first = lambda df, *by: df.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("mark"))).where(F.col("n") <= each).drop("n")
    salted = first(marked.select("lang", "mark").withColumn("salt", F.pmod("mark", F.lit(64))), "lang", "salt")
    cuts = first(salted.drop("salt"), "lang").groupBy("lang").agg(F.max("mark").alias("cut"))
    # One row a language goes to the texts. Equal rows have equal marks: one of each is enough, and keeps the bound.
    return marked.join(F.broadcast(cuts), "lang").where(F.col("mark") <= F.col("cut")).groupBy("lang", "mark").agg(F.first("text").alias("text"))


class Model:
    """What a task needs to predict: idf, weights by feature, languages, temperature."""

    def __init__(self, idf, weights, langs, heat, bits):
        self.idf, self.weights, self.langs, self.heat, self.bits = idf, weights, langs, heat, bits

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for found, counts in vectors(column, self.bits):
            p = softmax(weigh(counts, self.idf[found]) @ self.weights[found] / self.heat) if len(found) else np.full(len(self.langs), 1 / len(self.langs))
            best = int(p.argmax())
            names.append(self.langs[best]), scores.append(float(p[best]))
        return names, scores


def fit(train: DataFrame, size: int = SAMPLE, epochs: int = 2) -> Model | None:
    """Learn from doc_id, text and lang of ``train``; the driver holds the sample's features and one name a language."""
    tune(train.sparkSession)
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    langs = sorted(r.lang for r in train.select("lang").distinct().collect())
    if not langs:
        return None
    bits = feature_bits(len(langs))
    counts = train.select("text").mapInArrow(lean(_frequencies(bits)), "feature int, texts long").groupBy("feature").agg(F.sum("texts").alias("texts")).collect()
    seen = np.zeros(1 << bits)
    for r in counts:
        seen[r.feature] = r.texts
    idf = np.log((1 + seen[0]) / (1 + seen)) + 0.1
    rows = sample(train, max(1, size // len(langs))).mapInArrow(lean(_featurise(bits)), "lang string, mark long, features binary, counts binary").collect()
    rows.sort(key=lambda r: (r.mark, r.lang))
    number = {x: i for i, x in enumerate(langs)}
    data = [(f := np.frombuffer(r.features, "<u2"), weigh(np.frombuffer(r.counts, "<u4").astype(float), idf[f]), number[r.lang]) for r in rows if r.features]
    if not data:
        return None
    # A language's only text teaches; of more, about a fifth sets the temperature.
    taught: set[int] = set()
    teach, tune_on = [], []
    for i, x in enumerate(data):
        (teach if i % 5 or x[2] not in taught else tune_on).append(x)
        taught.add(x[2])
    model = Ftrl(1 << bits, len(langs))
    for _ in range(epochs):
        for x in teach:
            model.learn(*x)
    weights = model.weights()
    heat = temperature(np.array([x @ weights[f] for f, x, _ in tune_on]), np.array([y for *_, y in tune_on]))
    return Model(idf.astype(np.float32), weights.astype(np.float32), langs, heat, bits)


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with lang_pred and score; a narrow pass."""
    tune(df.sparkSession)
    kept = df.drop("lang_pred", "score")
    if model is None:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = df.sparkSession.sparkContext.broadcast(model)  # WEIGHTS floats at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = kept.withColumn("__lettered", lettered)
    out = rows.mapInArrow(lean(run), extended(rows.schema, lang_pred="string", score="double"))
    return out.withColumns({"lang_pred": F.when(F.col("__lettered"), F.col("lang_pred")).otherwise("und"), "score": F.when(F.col("__lettered"), F.col("score")).otherwise(0.0)}).drop("__lettered")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return fold(doc_id, 5) == 0


def query(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
