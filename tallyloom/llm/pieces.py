"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is cut into marked words: a run of spaces goes with the word after it, and a
line break is a piece of text of its own, since no piece of the vocabulary reaches
over either border. The distinct words of a slice are sorted into a trie and visited
depth first. Each trie node holds the forward state of its prefix: the last piece of
the best path that ends there and, for unigram vocabularies, the path's score. Words
with a common prefix reuse the states of the prefix, and encodings met before come
from a bounded table keyed by the word's hash.

Arcs of the lattice are the pieces that end at a prefix. For a unigram vocabulary the
best of them is the one whose score, added to that of the prefix before it, is the
highest. A vocabulary of merge type has ranks and no path scores: its best path is the
one that merging makes, on which every two neighbours must be what merging makes of
their own text (see bpe.py). At most one arc into each prefix passes that test, so the
maximum is over one arc. Characters without a piece become byte pieces.

Null and empty texts have no pieces and decode to the empty text. Runs of spaces,
control characters and unknown characters survive a round trip; the mark character
itself decodes as a space, as in the library. Repeated rows are encoded alike. Other
columns pass; those named like a result are replaced. Ties go to the shorter last piece.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import TextTrellis, common_prefix
from .shared import extended
from .textkernel import lean, mix, _powers, tune

MARK = "▁"
SLICE = 1 << 20
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


#: Model types of the file format.
UNIGRAM, MERGE = 1, 2
#: Ids that the table of words may hold before it begins anew; what a character without a piece costs a unigram path.
TABLE, UNKNOWN = 4_000_000, 10.0


@dataclass
class Vocabulary:
    """Ordinary pieces and their scores by id, ids of the 256 byte pieces, number of ids and type."""

    pieces: dict[int, str]
    scores: dict[int, float]
    byte_ids: list[int]
    size: int
    kind: int


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the protocol-buffer wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


def read_model(path: str) -> Vocabulary:
    """The parts of a model file that coding needs. Types other than unigram and merge are refused."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    trainer = next((v for k, v in _fields(model.serialized_model_proto()) if k == 2), b"")
    kind = next((v for k, v in _fields(trainer) if k == 3), UNIGRAM)
    n = model.get_piece_size()
    ordinary = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Vocabulary({i: model.id_to_piece(i) for i in ordinary}, {i: model.get_score(i) for i in ordinary}, byte_ids, n, kind)


class Codec:
    """Pieces of one vocabulary, with the states shared by the words read so far."""

    def __init__(self, source: str | Vocabulary):
        vocabulary = read_model(source) if isinstance(source, str) else source
        pieces, self.scores, self.kind = vocabulary.pieces, vocabulary.scores, vocabulary.kind
        if self.kind not in (UNIGRAM, MERGE):
            raise ValueError(f"vocabularies of type {self.kind} are not supported")
        if any(MARK in v.lstrip(MARK) or ("\n" in v and v != "\n") for v in pieces.values()):
            raise ValueError("a piece reaches over the border of a word")
        self.byte_ids = np.array(vocabulary.byte_ids, np.int64)
        self.by_text = {v: k for k, v in pieces.items()}
        self.sizes = {k: len(v) for k, v in pieces.items()}
        if self.kind == MERGE:
            ranks = {}
            for i, text in pieces.items():
                if set(text) == {MARK} and len(text) > 1:
                    continue  # runs of marks are cut greedily, after all other merges
                for cut in range(1, len(text)):
                    if text[:cut] in self.by_text and text[cut:] in self.by_text:
                        ranks[self.by_text[text[:cut]], self.by_text[text[cut:]]] = (int(-self.scores[i]), i)
            self.trellis = TextTrellis({k: tuple(v) for k, v in pieces.items() if len(v) == 1 or set(v) != {MARK}}, ranks)
            self.runs = sorted((len(v) for v in self.by_text if set(v) == {MARK}), reverse=True)
            self.run_id = {len(v): k for v, k in self.by_text.items() if set(v) == {MARK}}
        else:
            self.longest = max(map(len, self.by_text), default=1)
            self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN
        surface = {i: v.encode() for i, v in pieces.items()} | {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        table = [surface.get(i, b"") for i in range(vocabulary.size)]
        self.surface_sizes = np.array([len(x) for x in table], np.int64)
        self.surface_begins = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.surface = np.frombuffer(b"".join(table), np.uint8)
        self.path, self.last, self.forward = "", [], []
        self.keys, self.begins, self.counts, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def run_pieces(self, n: int) -> list[int]:
        """Pieces of a run of n marks: the longest that still fits, again and again."""
        out = []
        for size in self.runs:
            out += [self.run_id[size]] * (n // size)
            n %= size
        return out

    def _states(self, word: str) -> None:
        """Forward states of all prefixes of ``word``, from those that it shares with the word before."""
        same = common_prefix(self.path, word)
        del self.last[same:], self.forward[same:]
        reach = self._merged if self.kind == MERGE else self._scored
        for n in range(same + 1, len(word) + 1):
            reach(word, n)
        self.path = word

    def _merged(self, word: str, n: int) -> None:
        self.last.append(self.trellis.step_text(word, n, self.last) if word[n - 1] in self.trellis.base else -ord(word[n - 1]) - 1)

    def _scored(self, word: str, n: int) -> None:
        best, piece = -math.inf, 0
        for begin in range(n - 1, max(-1, n - 1 - self.longest), -1):
            found = self.by_text.get(word[begin:n])
            if found is not None:
                arc = self.scores[found]
            elif begin == n - 1:
                found, arc = -ord(word[n - 1]) - 1, self.unknown
            else:
                continue
            score = arc + (self.forward[begin - 1] if begin else 0.0)
            if score > best:
                best, piece = score, found
        self.forward.append(best)
        self.last.append(piece)

    def _path(self, word: str) -> list[int]:
        """Pieces of the best path of a word, read backwards from its last state."""
        self._states(word)
        ids, at = [], len(word)
        while at:
            piece = self.last[at - 1]
            ids.append(piece)
            at -= self.sizes.get(piece, 1)
        ids.reverse()
        return ids

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of marked words in sorted order, that is, of the trie's leaves depth first."""
        for word in words:
            if self.kind == UNIGRAM:
                ids = self._path(word)
            else:
                bare = word.lstrip(MARK)
                marks = len(word) - len(bare)
                ids = self._path(MARK + bare if marks else bare) if bare else []
                if not bare:
                    ids = self.run_pieces(marks)
                elif marks and ids[0] == self.run_id[1]:
                    ids[:1] = self.run_pieces(marks)
                elif marks > 1:
                    ids[:0] = self.run_pieces(marks - 1)
            if min(ids) < 0:
                ids = [x for i in ids for x in ([i] if i >= 0 else self.byte_ids[list(chr(-i - 1).encode())].tolist())]
            yield ids

    def _table(self, keys: np.ndarray, words: list[str]) -> None:
        """Encode new words and add them to the table."""
        if len(self.flat) > TABLE:  # bounded memory; words come back when met again
            self.keys, self.begins, self.counts, self.flat = self.keys[:0], self.begins[:0], self.counts[:0], self.flat[:0]
        order = sorted(range(len(words)), key=words.__getitem__)
        found = list(self.encode_sorted([words[k] for k in order]))
        sizes = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))
        begins = len(self.flat) + np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        keys = np.concatenate((self.keys, keys[order]))
        place = np.argsort(keys, kind="stable")
        self.keys = keys[place]
        self.begins, self.counts = np.concatenate((self.begins, begins))[place], np.concatenate((self.counts, sizes))[place]
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts)."""
        parts = [" " + t.replace(MARK, " ") if t else "" for t in texts]
        data = "".join(parts).encode("utf-8", "surrogatepass")
        lengths = np.array([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in parts], np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        blank, line = raw == 32, raw == 10
        begin = np.zeros(len(raw), bool)
        begin[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
        begin[offsets[:-1][lengths > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(raw))
        up, down = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[raw] * up[: len(raw)], out=total[1:])
        spans = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        distinct, first, back = np.unique(spans, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            if len(self.flat) > TABLE:
                new = np.arange(len(distinct))
            spots = first[new]
            words = [data[a:b].decode("utf-8", "surrogatepass").replace(" ", MARK) for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)]
            self._table(distinct[new], words)
            at = np.searchsorted(self.keys, distinct)
        which = at[back]
        sizes = self.counts[which]
        before = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.begins[which] - before[:-1], sizes) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, offsets)]

    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of sequences of ids; ids without a piece are skipped, damaged byte sequences become replacement characters."""
        flat = np.where((flat >= 0) & (flat < len(self.surface_sizes)), flat, 0)
        sizes = self.surface_sizes[flat]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        data = self.surface[np.repeat(self.surface_begins[flat] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = ends[offsets].tolist()
        texts = [data[a:b].decode("utf-8", "replace").replace(MARK, " ") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [t[1:] if t.startswith(" ") else t for t in texts]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    return _CODECS.get(path) or _CODECS.setdefault(path, Codec(path))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > SLICE:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the array of piece ids of each text; one narrow pass. Null texts have an empty array."""
    tune(df.sparkSession)
    kept = df.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for lo, hi in _slices(texts):
                flat, offsets = codec(model).encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), lists], [*batch.schema.names, ids])

    return kept.mapInArrow(lean(run), T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each array of ids. Null arrays give the empty text; ids without a piece are skipped."""
    tune(df.sparkSession)
    kept = df.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.fill_null(batch.column(ids), [])
            flat = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            found = []
            for lo in range(0, batch.num_rows, 200):
                own = offsets[lo : lo + 201]
                found += codec(model).decode(flat[own[0] : own[-1]], own - own[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, text])

    return kept.mapInArrow(lean(run), T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())]))


def digest(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """df without the text, with n_pieces, ids_sha256 (of the ids as four-byte little-endian numbers) and round_trip.

    Encodes and decodes each text in one pass, so that ids don't leave the task.
    """
    tune(df.sparkSession)
    kept = df.drop("n_pieces", "ids_sha256", "round_trip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for lo, hi in _slices(texts):
                flat, offsets = codec(model).encode(texts[lo:hi])
                back = codec(model).decode(flat, offsets)
                sums = [hashlib.sha256(flat[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                same = [(t or "") == b for t, b in zip(texts[lo:hi], back, strict=True)]
                own = {n: c.slice(lo, hi - lo) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != text}
                yield pa.RecordBatch.from_arrays([*own.values(), pa.array(np.diff(offsets)), pa.array(sums), pa.array(same)], [*own, "n_pieces", "ids_sha256", "round_trip"])

    return kept.mapInArrow(lean(run), extended(kept.drop(text).schema, n_pieces="long", ids_sha256="string", round_trip="boolean"))


def query(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 and round_trip of each document."""
    return digest(docs.select("doc_id", "text"), model)
