"""Language-model scores by a weighted backoff automaton.

The model has n-grams up to ``order`` words with hierarchical Dirichlet smoothing:
P1(w) = (c(w) + 1) / (N + V + 1) and P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m),
where h' is h without its first word and m the strength of that length.

As an automaton, each context seen in training is a state (the root is the empty
one). It has an arc for each n-gram seen, with weight log10 P(w | h), to the state of
the longest context that ends there, and a failure arc to h' with weight
log10(m / (c(h) + m)); the root has an arc for every word. A text is read once from
left to right: the state is carried along, a word without an arc takes failure arcs
until it has one, and the weights of all arcs taken add up. Long texts are read in
stretches side by side, each warmed up on the order - 1 words before it, which fix
the state.

The automaton grows with the corpus, so no machine holds it whole: each block of
texts asks for the counts of the n-grams in it (see blocks.py) and is then read
through its own part. Counts cover all training texts and all n-grams. A block is
what files and places in them say (``located``), so that both passes agree on it
however their scans are split; a text far longer than others is a block of its own.

Null and empty texts have one token, the end. The end and the start are keys of
strings with a separator, which no word of a text has. Ties and repeated rows are
scored row by row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, bucket_cuts, merge_counts, pack_counts, pack_sorted, ranked, runs, unpack_counts, unpack_sorted
from .shared import buckets, collect_shuffles, fold, located, parts, stored
from .textkernel import hash_word, lean, mix, release, slices, tune, utf8, word_hashes

_U = np.uint64
END, START = _U(hash_word("\n</s>")), _U(hash_word("\n<s>"))
#: Longest n-grams; each length more costs a 64-bit key for nearly every word in the shuffle. Dirichlet masses of contexts of one word, of two, ...
ORDER = 2
STRENGTHS = (20.0, 4.0)
#: Bytes of input files for each key range; words that are read side by side in one stretch.
RANGE_BYTES, STRETCH = 3 << 20, 64
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, place in its row, row) of each position; every row ends with END."""
    words, rows = word_hashes(raw, offsets)
    n = len(offsets) - 1
    each = np.bincount(rows, minlength=n) + 1
    last = np.cumsum(each) - 1
    out = np.empty(len(words) + n, np.uint64)
    out[np.arange(len(words)) + rows] = words
    out[last] = END
    row = np.repeat(np.arange(n), each)
    return out, np.arange(len(out)) - (last - each + 1)[row], row


def gram_keys(word: np.ndarray, place: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1: (keys of the n-grams that end at the positions, the positions).

    An n-gram may begin with the start of a text, before its first word.
    """
    out = [(word, np.arange(len(word)))]
    key = word
    for n in range(2, order + 1):
        at = np.flatnonzero(place >= n - 2)
        starts = place[at] == n - 2
        # The key of the first n - 1 words is that of the n-gram one shorter which ends a position before.
        before = np.where(starts, START, key[at - 1]) if n == 2 else key[at - 1]
        longer = np.zeros(len(word), np.uint64)
        longer[at] = mix(before * _U(0xD6E8FEB86659FD93) + word[at] + _U(n))
        key = longer
        out.append((key[at], at))
    return out


def _distinct_counts(keys: list[np.ndarray], trained: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each is in training positions."""
    every, flags = np.concatenate(keys), np.concatenate(trained)
    found = np.unique(every)
    seen, times = np.unique(every[flags], return_counts=True)
    out = np.zeros(len(found), np.int64)
    out[np.searchsorted(found, seen)] = times
    return found, out


def _asked(order: int) -> str:
    return "file long, part long, lo long, bucket int, " + ", ".join(f"k{n} binary, c{n} binary" for n in range(1, order + 1))


def _answered(order: int) -> str:
    return "file long, part long, lo long, bucket int, " + ", ".join(f"c{n} binary" for n in range(1, order + 1)) + ", tokens long, distinct_words long"


def _ask(n_buckets: int, order: int):
    """Of each piece (rows of one block that lie together in this task): its distinct n-grams and their counts, by key range."""

    def rows_of(file: int, part: int, lo: int, keys: list[list], trained: list[list]) -> Iterator[pa.RecordBatch]:
        found = [_distinct_counts(k, t) for k, t in zip(keys, trained, strict=True)]
        cuts = [bucket_cuts(k, n_buckets) for k, _ in found]
        some = np.flatnonzero(np.logical_or.reduce([np.diff(c) > 0 for c in cuts])).tolist()
        columns = [pa.array([x] * len(some), pa.int64()) for x in (file, part, lo)] + [pa.array(some, pa.int32())]
        for (k, c), cut in zip(found, cuts, strict=True):
            columns.append(pa.array([pack_sorted(k[cut[b] : cut[b + 1]]) for b in some], pa.binary()))
            columns.append(pa.array([pack_counts(c[cut[b] : cut[b + 1]]) for b in some], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in _asked(order).split(", ")])

    def add(piece: tuple, raw: np.ndarray, offsets: np.ndarray, taught: np.ndarray) -> None:
        word, place, row = tokens(raw, offsets)
        for n, (key, at) in enumerate(gram_keys(word, place, order)):
            piece[3][n].append(key), piece[4][n].append(taught[row[at]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = lambda file, part, lo: (file, part, lo, [[] for _ in range(order)], [[] for _ in range(order)])
        open_, last = None, -1
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            file, part, at = (batch.column(c).to_numpy() for c in ("file", "part", "at"))
            taught = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for a, b in runs(file, part, np.cumsum(np.diff(at, prepend=at[:1]) < 0)):
                alone = part[a] < 0
                piece = new(file[a], part[a], at[a]) if alone or open_ is None or open_[:2] != (file[a], part[a]) or at[a] < last else open_
                if not alone and piece is not open_:
                    if open_ is not None:
                        yield from rows_of(*open_)
                    open_ = piece
                last = at[b - 1]
                for lo, hi in slices(offsets[a : b + 1] - offsets[a]):
                    lo, hi = lo + a, hi + a
                    add(piece, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], taught[lo:hi])
                if alone:
                    yield from rows_of(*piece)
        if open_ is not None:
            yield from rows_of(*open_)

    return run


def _answer(order: int):
    """Totals of one key range, for each piece that asked."""

    def run(group: pa.Table) -> pa.Table:
        answers = []
        for n in range(1, order + 1):
            _, totals, found = merge_counts([unpack_sorted(x) for x in group[f"k{n}"].to_pylist()], [unpack_counts(x) for x in group[f"c{n}"].to_pylist()])
            answers.append(pa.array([pack_counts(x) for x in found], pa.binary()))
            if n == 1:
                words = totals
        release()
        once = lambda x: pa.array([x, *[0] * (group.num_rows - 1)], pa.int64())  # noqa: E731  totals of the range ride on its first row
        names = ["file", "part", "lo", "bucket"]
        return pa.table([*(group[c] for c in names), *answers, once(int(words.sum())), once(int((words > 0).sum()))], names=[*names, *(f"c{n}" for n in range(1, order + 1)), "tokens", "distinct_words"])

    return run


class Automaton:
    """States, arcs and failure arcs that the texts of one piece can meet.

    State 0 is the root. arcs: sorted numbers state * words + word, with the weight and
    the state that each leads to; fail: the state and weight of each state's failure arc.
    """

    def __init__(self, word: np.ndarray, place: np.ndarray, counts: list[np.ndarray], n: int, v: int, strengths: tuple[float, ...]):
        """word, place: the tokens that will be read; counts: by length, of their distinct n-grams in order of key."""
        order, grams = len(counts), gram_keys(word, place, len(counts))
        self.words, _, self.word = ranked(word)
        if len(self.words) != len(counts[0]):
            raise ValueError("the texts differ from those that were counted")
        self.width, self.start = len(self.words), 1
        self.counts, p1 = counts[0], (counts[0] + 1) / (n + v + 1)
        self.root = np.log10(p1)
        # Contexts of one word: the start of a text, which is as frequent as the end, and each word that training has.
        seen = np.flatnonzero(counts[0])
        state = np.zeros(self.width, np.int64)
        state[seen] = np.arange(len(seen)) + 2
        size = np.concatenate(([0, counts[0][np.searchsorted(self.words, END)]], counts[0][seen]))
        fail, mass = [np.zeros(len(size), np.int64)], [np.zeros(1), np.log10(strengths[0] / (size[1:] + strengths[0]))]
        arcs, weights, targets = [np.arange(self.width)], [self.root], [state]
        ends = state[self.word]  # by position: the state of the longest context that ends there, of those made so far
        chance = p1[self.word]  # by position: the smoothed chance of its word after the context so far
        for length in range(2, order + 1):
            key, at = grams[length - 1]
            _, first, back = ranked(key)
            c, m, pos = counts[length - 1], strengths[length - 2], at[first]
            if len(c) != len(pos):
                raise ValueError("the texts differ from those that were counted")
            h = np.where(place[pos] > 0, ends[pos - 1], self.start)
            # Where the longest context before is a shorter one, this context is new to training: a count of zero.
            whole = (place[pos] == 0) | (self._length(fail, h) == length - 1)
            p = (c + m * chance[pos]) / (np.where(whole, size[h], 0) + m)
            real = np.flatnonzero(c > 0)
            arcs.append(h[real] * self.width + self.word[pos[real]])
            weights.append(np.log10(p[real]))
            if length == order:
                targets.append(ends[pos[real]])
            else:
                # The n-grams seen are contexts of this length, and fail to the context without the first word.
                made = np.full(len(c), -1)
                made[real] = len(size) + np.arange(len(real))
                size = np.concatenate((size, c[real]))
                fail.append(ends[pos[real]])
                mass.append(np.log10(strengths[length - 1] / (c[real] + strengths[length - 1])))
                targets.append(made[real])
                known = made[back] >= 0
                ends = ends.copy()
                ends[at[known]] = made[back[known]]
            chance = chance.copy()
            chance[at] = p[back]
        del grams, ends, chance
        by = np.argsort(np.concatenate(arcs))
        self.arcs, self.weights, self.targets = (np.concatenate(x)[by] for x in (arcs, weights, targets))
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(mass)

    @staticmethod
    def _length(fail: list[np.ndarray], state: np.ndarray) -> np.ndarray:
        """Words in the context of a state: states are numbered by length."""
        borders = np.cumsum([len(x) for x in fail])
        return np.where(state == 0, 0, np.searchsorted(borders, state, "right") + 1)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after the word, weights of the failure arcs and the arc taken), for many texts at once."""
        state, total = state.copy(), np.zeros(len(state))
        todo = np.arange(len(state))
        while len(todo):
            want = state[todo] * self.width + word[todo]
            at = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)
            hit = self.arcs[at] == want
            there, lost = todo[hit], todo[~hit]
            total[there] += self.weights[at[hit]]
            state[there] = self.targets[at[hit]]
            total[lost] += self.fail_weight[state[lost]]
            state[lost] = self.fail[state[lost]]
            todo = lost
        return state, total

    def read(self, place: np.ndarray, warm: int, stretch: int = STRETCH) -> np.ndarray:
        """Weight at each position, in one pass from left to right over all stretches side by side."""
        out = np.zeros(len(place))
        begin = np.flatnonzero(place % stretch == 0)
        size = np.diff(np.append(begin, len(place)))
        by = np.argsort(-size, kind="stable")
        begin, size = begin[by], size[by]
        state = np.where(place[begin] == 0, self.start, 0)
        inside = np.flatnonzero(place[begin] > 0)
        for back in range(warm, 0, -1):
            state[inside], _ = self.step(state[inside], self.word[begin[inside] - back])
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -k))  # stretches longer than k
            state[:live], out[begin[:live] + k] = self.step(state[:live], self.word[begin[:live] + k])
        return out


def _score(n: int, v: int, order: int, strengths: tuple[float, ...]):
    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        names = [f.split(" ")[0] for f in SCORED.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not texts.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        texts, answers = texts.sort_by("at"), answers.sort_by([("lo", "ascending"), ("bucket", "ascending")])
        at, lo = texts["at"].to_numpy(), answers["lo"].to_numpy()
        pieces = np.searchsorted(np.unique(lo), at, "right") - 1
        out = []
        for a, b in runs(pieces):
            own = texts.slice(a, b - a)
            raw, offsets = utf8(own["text"].combine_chunks())
            word, place, row = tokens(raw, offsets)
            begin = np.unique(lo)[pieces[a]]
            first, last = np.searchsorted(lo, begin), np.searchsorted(lo, begin, "right")
            mine = answers.slice(int(first), int(last - first))
            counts = [np.concatenate([unpack_counts(x) for x in mine[f"c{k}"].to_pylist()]) for k in range(1, order + 1)]
            machine = Automaton(word, place, counts, n, v, strengths)
            total = lambda x, rows=b - a, row=row: np.bincount(row, x, rows)
            c = machine.counts[machine.word]
            del counts, mine, raw
            columns = [own["doc_id"], own["held_out"], np.bincount(row, minlength=b - a), total(c > 0).astype(np.int64), np.full(b - a, n), total(machine.root[machine.word]), total(machine.read(place, order - 1))]
            out.append(pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names))
        release()
        return pa.concat_tables(out)

    return run


def score_texts(docs: DataFrame, held_out: Column, order: int = ORDER, strengths: tuple[float, ...] = STRENGTHS, block: int = BLOCK_BYTES // 2) -> DataFrame:
    """Base and model scores of all texts; learns from rows where ``held_out`` is false.

    docs: doc_id, text. strengths: Dirichlet masses of contexts of one word and more.
    Shuffles each text once and one row of sorted keys for each (piece, key range).
    """
    tune(docs.sparkSession)
    rows = located(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"), F.col("__file").alias("file"), F.col("__at").alias("at"))
    size = F.octet_length("text") + 16
    count, mean = rows.agg(F.count("*"), F.coalesce(F.avg(size), F.lit(16.0))).first()
    each = max(1, int(block / mean))
    rows = rows.withColumn("part", F.when(size > F.lit(max(16 * mean, block / 8)), -1 - F.col("at")).otherwise(F.floor(F.col("at") / each)).cast("long"))
    n_ranges = buckets(rows, RANGE_BYTES)
    asked = rows.mapInArrow(lean(_ask(n_ranges, order)), _asked(order)).repartition(n_ranges, "bucket")
    answers = stored(asked.groupBy("bucket").applyInArrow(_answer(order), _answered(order)), "lm-counts")
    del asked
    n, v = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct_words"), F.lit(0))).first()
    collect_shuffles(docs.sparkSession)
    n_blocks = max(parts(docs.sparkSession), 2 * int(count * mean / block))  # so many that few blocks share a task
    texts = rows.repartition(n_blocks, "file", "part").groupBy("file", "part")
    counts = answers.drop("tokens", "distinct_words").repartition(n_blocks, "file", "part").groupBy("file", "part")
    return texts.cogroup(counts).applyInArrow(_score(n, v, order, strengths), SCORED)


def query(docs: DataFrame) -> DataFrame:
    return score_texts(docs, fold("doc_id", 7) == 2)
