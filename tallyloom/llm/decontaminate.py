"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words cover all documents; they tell the rarer half
   of a passage's words.
2. Benchmark items are cut into passages and weighted by TF-IDF, with the idf of the
   passages, so that weights don't depend on how often documents copy one. A randomised
   SVD of that matrix is computed over distributed rows: a seeded test matrix, power
   iterations with partial sums by term, orthonormalised through small Gram matrices.
3. Each document is read in cells of ``CELL`` words; two neighbours are a window. Its
   cosine with each passage (put right for the share of the passage that the projection
   keeps) is fitted to the passage: the window counts with the passage's length, so that
   the words around a copy take nothing from it. A window whose terms cannot reach the
   threshold with any passage is not projected. The cosine names candidates, and so does
   each run of ``GRAM`` words (of all words in shorter passages) that a window shares
   with a passage, whatever the cosine.
4. A candidate is a leak if the longest common subsequence of words between the
   passage and a stretch of the window's surroundings covers ``OVERLAP`` of the
   passage, and the passage's answer is there too: its ``answer`` column if there is
   one, else the rarer half of its words; ``ANSWER`` of them must be in the stretch.

Documents are searched where they lie, without shuffling texts. The benchmark is
taken in chunks of ``CHUNK`` distinct passages, whose model (terms x rank, the rank three quarters
of the passages and ``RANK`` at most) is broadcast only because its size is bounded by the
chunk. One pass over the texts searches ``TOGETHER`` chunks; a benchmark of any size is
more passes, of which only the leaks found are written, and texts meet them by place.

Null and empty texts leak nothing; items without a word match nothing, and very
short ones only whole. Repeated documents are each searched; equal items under several
ids report each id, repeated rows of items count once. Extra columns pass, and a column
named ``leaks`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import PLACE, located, stored
from .textkernel import lean, mix, slices, tune, utf8, word_hashes

BITS = 18
CELL, PASSAGE = 24, 64
RANK, CHUNK, TOGETHER, POWER = 256, 1024, 4, 2
COSINE, OVERLAP, ANSWER = 0.25, 0.6, 0.5
GRAM = 3
SHORT = 8
_U = np.uint64
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("word", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("overlap", T.DoubleType()), T.StructField("answer", T.DoubleType())]))


def terms(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> _U(64 - BITS)).astype(np.int32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, total = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        for lo, hi in slices(offsets):
            words, rows = word_hashes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            pairs = np.unique((rows.astype(np.int64) << BITS) | terms(words))
            seen += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
            total += hi - lo
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], total))], ["term", "texts"])


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of each hashed term, from all documents; 2**BITS numbers."""
    rows = docs.select("text").mapInArrow(lean(_frequencies), "term int, texts long").groupBy("term").agg(F.sum("texts").alias("texts"))
    return _idf(rows.toArrow())


def _idf(counts: pa.Table) -> np.ndarray:
    term, texts = counts["term"].to_numpy(), counts["texts"].to_numpy()
    n = int(texts[term < 0].sum())
    seen = np.zeros(1 << BITS)
    seen[term[term >= 0]] = texts[term >= 0]
    return np.log((n + 1) / (seen + 1)).astype(np.float32) + np.float32(0.05)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words, answer words) of each passage: whole items, or pieces of PASSAGE words that overlap by half."""
    for batch in batches:
        out = []
        texts = [word_hashes(*utf8(batch.column(c).slice(i, 1)))[0] for i in range(batch.num_rows) for c in ("text", "answer")]
        for i, item in enumerate(batch.column("item_id").to_pylist()):
            words, answer = texts[2 * i], texts[2 * i + 1]
            for begin in range(0, max(1, len(words) - PASSAGE // 2), PASSAGE // 2):
                if len(piece := words[begin : begin + PASSAGE]):
                    out.append((item, piece.tobytes(), answer.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["item_id", "words", "answer"])


def passages(items: DataFrame) -> DataFrame:
    """item_id, chunk, words, answer; passages are numbered so that a chunk holds CHUNK of them."""
    tune(items.sparkSession)
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit("")
    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(answer, F.lit("")).alias("answer"))
    found = stored(rows.mapInArrow(lean(_passages), "item_id long, words binary, answer binary").distinct(), "passages")
    n = found.count()
    chunks = -(-n // CHUNK)
    return found.withColumn("chunk", F.pmod(F.xxhash64("item_id", "words", "answer"), F.lit(max(1, chunks))).cast("int"))


def _passage_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, total = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for words in batch.column("words").to_pylist():
            seen[np.unique(terms(np.frombuffer(words, np.uint64)))] += 1
        total += batch.num_rows
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], total))], ["term", "texts"])


def passage_frequencies(found: DataFrame) -> np.ndarray:
    """idf of each hashed term among all passages; 2**BITS numbers."""
    rows = found.select("words").mapInArrow(lean(_passage_frequencies), "term int, texts long").groupBy("term").agg(F.sum("texts").alias("texts"))
    return _idf(rows.toArrow())


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the run of ``size`` words that begins at each word, as far as there is one."""
    run = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        run = run * _U(0x9E3779B97F4A7C15) + words[j : j + len(run)]
    return mix(run)


def weights(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, TF-IDF weights of length one) of a passage."""
    at, times = np.unique(terms(words), return_counts=True)
    x = times * idf[at]
    return at, (x / np.sqrt((x * x).sum())).astype(np.float32)


def test_rows(at: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Rows of the random test matrix: signs that follow from (seed, term, column), so that none is kept or sent."""
    n = mix((at.astype(np.uint64)[:, None] << _U(20)) + np.arange(rank, dtype=np.uint64) + (_U(seed) << _U(44)))
    return np.where(n >> _U(63), np.float32(1), np.float32(-1))


def _matrix(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct terms, dense rows by passage over them) of one small batch."""
    every = np.unique(np.concatenate([a for a, _ in pairs]))
    dense = np.zeros((len(pairs), len(every)), np.float32)
    for i, (a, x) in enumerate(pairs):
        dense[i, np.searchsorted(every, a)] = x
    return every, dense


def _times(idf, basis, rank: int, seed: int):
    """One half-step: partial rows of A^T (A Q), by term; Q is the test matrix or a basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                rows = batch.column("words").slice(lo, 128).to_pylist()
                at, a = _matrix([weights(np.frombuffer(w, np.uint64), idf.value) for w in rows])
                q = test_rows(at, rank, seed) if basis is None else rows_of(basis.value, at)
                z = (a.T @ (a @ q)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), rank).cast(pa.list_(pa.float64()))], ["term", "row"])

    return run


def rows_of(basis: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    where = np.minimum(np.searchsorted(basis[0], at), len(basis[0]) - 1)
    return np.where((basis[0][where] == at)[:, None], basis[1][where], np.float32(0))


def _sum_rows(key: tuple, group: pa.Table) -> pa.Table:
    term = group["term"].to_numpy()
    rows = group["row"].combine_chunks().flatten().to_numpy().reshape(len(term), -1)
    at, back = np.unique(term, return_inverse=True)
    total = np.zeros((len(at), rows.shape[1]))
    np.add.at(total, back, rows)
    return pa.table({"term": pa.array(at, pa.int32()), "row": pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))})


def randomised_svd(rows: DataFrame, idf, rank: int = RANK, power: int = POWER, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(terms, orthonormal rows x rank) that span the leading right singular vectors of one chunk's passages.

    Passages stay distributed: tasks send partial products by term, summed by term
    range. What comes to the driver is the chunk's term table, which CHUNK bounds.
    """
    context = rows.sparkSession.sparkContext
    basis = None
    for turn in range(power + 1):
        shared = None if basis is None else context.broadcast(basis)
        parts = rows.mapInArrow(lean(_times(idf, shared, rank, seed)), "term int, row array<double>")
        summed = parts.groupBy(F.pmod("term", F.lit(16)).alias("part")).applyInArrow(_sum_rows, "term int, row array<double>").toArrow()
        if not summed.num_rows:
            return np.zeros(0, np.int32), np.zeros((0, rank), np.float32)
        term = summed["term"].to_numpy()
        z = summed["row"].combine_chunks().flatten().to_numpy().reshape(len(term), rank)
        order = np.argsort(term)
        term, z = term[order], z[order]
        # Orthonormal columns from the Gram matrix; directions without energy fall away.
        values, vectors = np.linalg.eigh(z.T @ z)
        keep = values > values[-1] * 1e-10
        q = z @ (vectors[:, keep] / np.sqrt(values[keep]))
        full = np.zeros((len(term), rank))
        full[:, : q.shape[1]] = q[:, ::-1]
        basis = (term, full.astype(np.float32))
    return basis


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if hit := row & places.get(x, 0):
            row = (row + hit) | (row - hit)
            row &= full
    return len(a) - row.bit_count()


class Index:
    """One chunk of passages in the latent space, and what checking needs."""

    def __init__(self, items: list[int], words: list[np.ndarray], answers: list[np.ndarray], basis, idf: np.ndarray, rare: np.ndarray):
        """idf weighs terms among passages, rare among documents."""
        self.items, self.words, self.idf = items, words, idf
        self.terms, self.vectors = basis
        latent = []
        self.most = np.zeros(1 << BITS, np.float32)  # what a word of that term adds to the fitted cosine with any passage, at most
        for w in words:
            at, x = weights(w, idf)
            length = float(np.linalg.norm(np.unique(terms(w), return_counts=True)[1] * idf[at]))
            y = x @ rows_of(basis, at)
            latent.append(y / (max(float(y @ y), 1e-6) * length))  # the fitted cosine is <w, y> / (|p| |y|^2)
            self.most[at] = np.maximum(self.most[at], x * idf[at] / length)
        self.latent = np.array(latent, np.float32)
        self.known = np.full(1 << BITS, -1, np.int32)
        self.known[self.terms] = np.arange(len(self.terms))
        self.scaled = self.vectors * idf[self.terms][:, None]
        self.grams = {}
        for size in range(1, GRAM + 1):
            own = [np.unique(runs(w, size)) if min(len(w), GRAM) == size else np.zeros(0, np.uint64) for w in words]
            keys = np.concatenate(own)
            if len(keys):
                order = np.argsort(keys, kind="stable")
                maybe = np.zeros(1 << BITS, bool)
                maybe[terms(keys)] = True
                self.grams[size] = (keys[order], np.repeat(np.arange(len(own)), [len(k) for k in own])[order], maybe)
        self.answers = []
        for w, a in zip(words, answers, strict=True):
            if not len(a):
                own = np.unique(w)
                a = own[np.argsort(-rare[terms(own)], kind="stable")[: max(1, len(own) // 2)]]
            self.answers.append(set(a.tolist()))

    def check(self, p: int, around: list[int]) -> tuple[float, float]:
        """(best overlap, share of the answer there) over stretches a bit longer than the passage."""
        answer = self.answers[p]
        if len(answer.intersection(around)) < ANSWER * len(answer):
            return 0.0, 0.0  # the answer is nowhere near, so no stretch has it
        words = self.words[p].tolist()
        n = len(words)
        size, best = n + n // 3 + 2, (0.0, 0.0)
        need = n if n < SHORT else OVERLAP * n
        wanted = set(words)
        hits = np.cumsum([0, *(x in wanted for x in around)])
        for begin in range(0, max(1, len(around) - size + max(1, n // 6)), max(1, n // 6)):
            end = min(len(around), begin + size)
            if hits[end] - hits[begin] < need:
                continue
            stretch = around[begin:end]
            share = len(answer.intersection(stretch)) / len(answer)
            if share >= ANSWER and (found := lcs(words, stretch)) >= need:
                best = max(best, (found / n, share))
                if found == n:
                    break
        return best

    def shared(self, words: np.ndarray, rows: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Distinct (cell, passage) where a run of words that begins in the cell is one of the passage; two columns, sorted."""
        pairs = [np.zeros((0, 2), np.int64)]
        for size, (keys, owners, maybe) in self.grams.items():
            run = runs(words, size)
            at = np.flatnonzero(maybe[terms(run)] & (rows[: len(run)] == rows[size - 1 :]))
            first, last = np.searchsorted(keys, run[at]), np.searchsorted(keys, run[at], "right")
            n = last - first
            cell = np.repeat(np.searchsorted(cut, at, "right") - 1, n)
            owner = owners[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pairs.append(np.column_stack((cell, owner)))
        return np.unique(np.concatenate(pairs), axis=0)

    def search(self, raw: np.ndarray, offsets: np.ndarray) -> dict[int, list[dict]]:
        """Leaks of each text of a slice that has any."""
        words, rows = word_hashes(raw, offsets)
        if not len(words) or not len(self.latent):
            return {}
        place = np.arange(len(words)) - np.searchsorted(rows, np.arange(len(offsets) - 1))[rows]
        cut = np.flatnonzero((place % CELL) == 0)  # cells begin anew in each text
        term = terms(words)
        at = self.known[term]
        row = rows[cut]
        pair = np.append(row[1:] == row[:-1], False)
        reach = np.add.reduceat(self.most[term].astype(np.float64), cut)
        able = reach + np.where(pair, np.append(reach[1:], 0), 0) >= COSINE * (1 - 1e-5)
        shared = self.shared(words, rows, cut)
        able[shared[:, 0]] = True
        live = able | np.append(False, able[:-1] & pair[:-1])
        # Project the cells of windows that can reach the threshold or share a run.
        cells = np.flatnonzero(live)
        if not len(cells):
            return {}
        bounds = np.append(cut, len(words))
        out: dict[int, list[dict]] = {}
        whole: set[tuple[int, int]] = set()  # found word for word; other windows can't add to it
        for lo in range(0, len(cells), 4096):
            some = cells[lo : lo + 4097]  # one more, for the last window's second half
            flat = np.concatenate([np.arange(bounds[c], bounds[c + 1]) for c in some.tolist()])
            owner = np.repeat(np.arange(len(some)), bounds[some + 1] - bounds[some])
            use = at[flat] >= 0
            flat, owner = flat[use], owner[use]
            y = np.zeros((len(some), self.vectors.shape[1]), np.float32)
            if len(flat):
                begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                y[owner[begins]] = np.add.reduceat(self.scaled[at[flat]], begins)
            follows = np.append((some[1:] == some[:-1] + 1) & pair[some[:-1]], False)
            y[:-1] += np.where(follows[:-1, None], y[1:], 0)
            scores = y @ self.latent.T
            named = (scores >= COSINE) & able[some][:, None]
            here = shared[np.searchsorted(shared[:, 0], some[0]) : np.searchsorted(shared[:, 0], some[-1], "right")]
            named[np.searchsorted(some, here[:, 0]), here[:, 1]] = True
            for i, p in zip(*np.nonzero(named), strict=True):
                if i == 4096:
                    continue  # belongs to the next part
                c, r = int(some[i]), int(row[some[i]])
                if (r, p) in whole:
                    continue
                n = len(self.words[p])
                first = max(int(np.searchsorted(rows, r)), int(cut[c]) - n)
                last = min(int(np.searchsorted(rows, r, "right")), int(cut[c]) + 2 * CELL + n)
                overlap, answer = self.check(int(p), words[first:last].tolist())
                if overlap == 1:
                    whole.add((r, p))
                if overlap:
                    out.setdefault(r, []).append({"item_id": self.items[p], "word": int(place[cut[c]]), "cosine": min(1.0, max(0.0, float(scores[i, p]))), "overlap": overlap, "answer": answer})
        return out


def best(found: list[dict]) -> list[dict]:
    """One entry an item: the largest overlap, then cosine, then the first place."""
    by: dict[int, dict] = {}
    for x in sorted(found, key=lambda x: (-x["overlap"], -x["cosine"], x["word"])):
        by.setdefault(x["item_id"], x)
    return [by[k] for k in sorted(by)]


def rank_of(n: int) -> int:
    """Rank of the latent space of n passages: below theirs, so that it joins what occurs together."""
    return min(RANK, max(8, 3 * n // 4))


def indexes(docs: DataFrame, items: DataFrame, text: str) -> list[list]:
    """Broadcast models of all chunks of the benchmark, by the pass over the texts that searches them."""
    context = docs.sparkSession.sparkContext
    rare = document_frequencies(docs.select(F.col(text).alias("text")))
    found = passages(items)
    idf = passage_frequencies(found)
    wide = context.broadcast(idf)  # 2**BITS floats
    out = []
    for chunk in sorted(r.chunk for r in found.select("chunk").distinct().collect()):
        rows = found.where(F.col("chunk") == chunk)
        held = rows.orderBy("item_id", "words", "answer").collect()  # about CHUNK distinct passages
        basis = randomised_svd(rows.select("words"), wide, rank_of(len(held)))
        out.append(context.broadcast(Index([r.item_id for r in held], [np.frombuffer(r.words, np.uint64) for r in held], [np.frombuffer(r.answer, np.uint64) for r in held], basis, idf, rare)))
    return [out[i : i + TOGETHER] for i in range(0, len(out), TOGETHER)]


def annotate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``leaks``: an array of (item_id, word, cosine, overlap, answer), empty for clean texts."""
    tune(docs.sparkSession)
    kept = docs.drop("leaks")
    passes = indexes(kept, items, text)
    none = F.array().cast(LEAKS)
    if len(passes) < 2:
        out = kept.withColumn("leaks", none)
        return out.mapInArrow(lean(_search(passes[0], text)), out.schema) if passes else out
    source = located(kept)
    hits = None
    for group in passes:
        rows = source.select(*PLACE, text).withColumn("leaks", none)
        new = stored(rows.mapInArrow(lean(_search(group, text)), rows.schema).where(F.size("leaks") > 0).select(*PLACE, F.explode("leaks").alias("leak")), "leaks")
        hits = new if hits is None else hits.unionByName(new)
    order = F.struct(-F.col("leak.overlap"), -F.col("leak.cosine"), "leak.word")
    one = hits.groupBy(*PLACE, "leak.item_id").agg(F.min_by("leak", order).alias("leak"))
    every = one.groupBy(*PLACE).agg(F.array_sort(F.collect_list("leak")).alias("leaks"))
    return source.join(every, list(PLACE), "left").withColumn("leaks", F.coalesce("leaks", none)).drop(*PLACE)


def _search(models: list, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(text))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for lo, hi in slices(offsets):
                for model in models:
                    for r, new in model.value.search(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).items():
                        found[lo + r] = best(found[lo + r] + new)
            where = batch.schema.get_field_index("leaks")
            columns = list(batch.columns)
            columns[where] = pa.array(found, pa.list_(pa.struct([("item_id", pa.int64()), ("word", pa.int64()), ("cosine", pa.float64()), ("overlap", pa.float64()), ("answer", pa.float64())])))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and item that it leaks."""
    leaks = annotate(docs.select("doc_id", "text"), items).select("doc_id", F.explode("leaks").alias("leak"))
    return leaks.select("doc_id", "leak.item_id", "leak.word", "leak.cosine", "leak.overlap", "leak.answer")
