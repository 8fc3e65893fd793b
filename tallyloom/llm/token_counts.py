"""Token counts by a compiled finite-state transducer, without building tokens.

Two machines run one after the other. The first splits normalised text into
words; its states are classes of the last character (space, letter, number,
other), and it is evaluated for all characters of a slice at once. The second
reads one word: states are prefixes in a trie, made when first met, and each
transition is annotated with the change of the token count, the end-of-word
transition too. A word's count is the sum of what its path emits.

Every text is cut into chunks of ``CHUNK`` characters, anywhere. The state between two
chunks is the word that is unfinished there, a node of the trie. A chunk is compiled to
its map from state to (state, count): without white space it lengthens the word; else
it ends the word with the chunk's head, adds the count of the words inside and leaves
the chunk's tail. Such maps compose associatively; a prefix scan does so level by
level, for all texts of a slice at once, and the whole text's map is applied to the
empty word.

Null and empty texts have no token. Special strings in a text count as one token
each, as the library does by default. Very long texts cost memory in proportion
to the slice, a single unbroken word to its own length. Repeated rows are counted
alike; extra columns pass, one named like the count is replaced.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TextTrellis, byte_symbols, common_prefix, read_word_bpe, split_suffix
from .shared import extended
from .textkernel import lean, span_hashes, tune

#: Characters of a chunk and of a slice; words whose counts a task keeps.
CHUNK, SLICE, TABLE = 1 << 16, 1 << 18, 3_000_000
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The contractions that are words of their own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points that the pattern's \s matches.
SPACES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[list(SPACES)] = SPACE
    return out


@functools.cache
def _symbol_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)


def normalise(text: str) -> str:
    """NFC and lower case, character by character (no contextual final sigma)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


class Transducer:
    """Compiled from a vocabulary; counts the tokens of words."""

    def __init__(self, path: str):
        spec = read_word_bpe(path)
        vocab, suffix = spec["vocab"], spec["suffix"]
        self.special_texts = spec["specials"]
        self.specials = re.compile("|".join(map(re.escape, spec["specials"])))
        # The end mark becomes one private character, so that a symbol with it is text of length two at most.
        ends: dict[str, str] = {}

        def symbols(token: str) -> tuple[str, ...]:
            body = split_suffix(token, suffix)
            if body and body[-1].endswith(suffix) and len(body[-1]) > len(suffix):
                last = body[-1]
                ends.setdefault(last, chr(0xE000 + len(ends)))
                return (*body[:-1], ends[last])
            return body

        for x in byte_symbols():
            symbols(x + suffix)
        ids = {k: v for k, v in vocab.items()}
        ranks = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(spec["pairs"]) if a in ids and b in ids and a + b in ids}
        self.trellis = TextTrellis({v: symbols(k) for k, v in ids.items()}, ranks)
        self.ends = {k.removesuffix(suffix): v for k, v in ends.items()}
        self.bytes = byte_symbols()
        self.path: list[str] = []
        self.last: list[int] = []
        self.counts: list[int] = []
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def count_sorted(self, words: list[str]) -> list[int]:
        """Counts of distinct words in sorted order; neighbours share the states of common prefixes."""
        out, step = [], self.trellis.step_text
        for word in words:
            text = word if word.isascii() and word.isprintable() else "".join([self.bytes[b] for b in word.encode()])
            body = text[:-1]
            same = common_prefix(self.path, body)
            del self.path[same:], self.last[same:], self.counts[same:]
            for n in range(same + 1, len(body) + 1):
                token = step(body, n, self.last)
                before = n - self.trellis.sizes[token]
                self.last.append(token)
                self.counts.append(1 + (self.counts[before - 1] if before else 0))
                self.path.append(body[n - 1])
            token = step(body + self.ends[text[-1]], len(text), self.last)
            before = len(text) - self.trellis.sizes[token]
            out.append(1 + (self.counts[before - 1] if before else 0))
        return out

    def lookup(self, joined: str, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Counts of the words joined[start:end] with these hashes; new ones are compiled."""
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        got = np.zeros(len(distinct), np.int32)
        got[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            spots = first[new]
            words = [joined[a:b] for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)]
            order = sorted(range(len(words)), key=words.__getitem__)
            for k, n in zip(order, self.count_sorted([words[k] for k in order]), strict=True):
                got[new[k]] = n
            if len(self.keys) > TABLE:  # bounded memory; words come back when met again
                self.keys, self.values = self.keys[:0], self.values[:0]
            keys = np.concatenate((self.keys, distinct[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.values = keys[order], np.concatenate((self.values, got[new]))[order]
        return got[back]


def split_words(joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends) of the words in normalised text."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes()[points]
    if not len(points):
        return points, np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = kinds != SPACE
    begins[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
    quotes = np.flatnonzero(begins & (points == 39))
    for i in quotes.tolist():
        if not begins[i]:
            continue
        for tail in CONTRACTIONS:
            n = len(tail)
            if joined.startswith(tail, i + 1):
                begins[i + 1] = False
                if i + 1 + n < len(points) and kinds[i + 1 + n] == LETTER:
                    begins[i + 1 + n] = True
                break
    starts = np.flatnonzero(begins)
    gap = np.flatnonzero((kinds == SPACE) & np.concatenate(([False], kinds[:-1] != SPACE)))
    bounds = np.concatenate((starts[1:], [len(points)]))
    if len(gap):
        at = np.searchsorted(gap, starts, "right")
        near = np.where(at < len(gap), gap[np.minimum(at, len(gap) - 1)], len(points))
        bounds = np.minimum(bounds, near)
    return points, starts, bounds


def counts_of(machine: Transducer, texts: list[str]) -> np.ndarray:
    """Tokens of each normalised text without special strings."""
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = "\n".join(texts)
    points, starts, ends = split_words(joined)
    if not len(starts):
        return np.zeros(len(texts), np.int64)
    keys = span_hashes(_symbol_values()[points & np.uint32(0xFFFF)] + (points >> np.uint32(16)).astype(np.uint64), starts, ends)
    counts = machine.lookup(joined, keys, starts, ends)
    offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return np.bincount(rows, counts, len(texts)).astype(np.int64)


_SPACE_TEXT = "".join(map(chr, SPACES))
_FIRST = re.compile(f"[{re.escape(_SPACE_TEXT)}]")


@dataclass(frozen=True)
class ChunkMap:
    """From the word that is unfinished before a chunk to the one unfinished after it, and the tokens in between.

    closed: whether the chunk has white space; else all of it is head.
    """

    head: str
    count: int
    tail: str
    closed: bool

    def apply(self, machine: Transducer, word: str) -> tuple[str, int]:
        """(state after, count) for the state before."""
        if not self.closed:
            return word + self.head, 0
        return self.tail, int(counts_of(machine, [word + self.head])[0]) + self.count


def state_maps(machine: Transducer, chunks: list[str]) -> list[ChunkMap]:
    """The map of each chunk; the words inside all chunks are counted together."""
    cuts = []
    for chunk in chunks:
        first = _FIRST.search(chunk)
        cuts.append((first.start(), _last_space(chunk)) if first else None)
    inner = counts_of(machine, [x[c[0] : c[1]] if c else "" for x, c in zip(chunks, cuts, strict=True)]).tolist()
    return [ChunkMap(x[: c[0]], n, x[c[1] + 1 :], True) if c else ChunkMap(x, 0, "", False) for x, c, n in zip(chunks, cuts, inner, strict=True)]


def _last_space(chunk: str) -> int:
    size = 64
    while True:  # from the end on, in growing steps, so that a search costs no more than the tail
        found = None
        for found in _FIRST.finditer(chunk, max(0, len(chunk) - size)):
            pass
        if found:
            return found.start()
        size *= 8


def compose(machine: Transducer, pairs: list[tuple[ChunkMap, ChunkMap]]) -> list[ChunkMap]:
    """first, then second, for each pair; the words that end at the seams are counted together."""
    seams = counts_of(machine, [a.tail + b.head if a.closed and b.closed else "" for a, b in pairs]).tolist()
    out = []
    for (a, b), n in zip(pairs, seams, strict=True):
        if a.closed and b.closed:
            out.append(ChunkMap(a.head, a.count + n + b.count, b.tail, True))
        elif a.closed:
            out.append(ChunkMap(a.head, a.count, a.tail + b.head, True))
        else:
            out.append(ChunkMap(a.head + b.head, b.count, b.tail, b.closed))
    return out


def scan(machine: Transducer, rows: list[list[ChunkMap]]) -> list[ChunkMap]:
    """The composition of each row's maps: neighbours first, as in the up-sweep of a parallel scan."""
    while any(len(r) > 1 for r in rows):
        done = iter(compose(machine, [(r[i], r[i + 1]) for r in rows for i in range(0, len(r) - 1, 2)]))
        rows = [[next(done) if i + 1 < len(r) else r[i] for i in range(0, len(r), 2)] for r in rows]
    return [r[0] for r in rows]


def count_normalised(machine: Transducer, texts: list[str], chunk: int | None = None) -> np.ndarray:
    """Tokens of each normalised text without special strings, through the maps of its chunks."""
    chunk = chunk or CHUNK
    cut = [[t[i : i + chunk] for i in range(0, max(len(t), 1), chunk)] for t in texts]
    maps = iter(state_maps(machine, [x for row in cut for x in row]))
    whole = scan(machine, [[next(maps) for _ in row] for row in cut])
    # From the empty word: the head ends one word and the end of the text another.
    ends = counts_of(machine, [x for m in whole for x in (m.head, m.tail)]).reshape(-1, 2).sum(1)
    return ends + np.array([m.count for m in whole], np.int64)


_MACHINES: dict[str, Transducer] = {}


def count_texts(path: str, texts: list[str | None]) -> list[int]:
    """Token counts of texts, as the vocabulary's library gives them without added tokens."""
    machine = _MACHINES.get(path) or _MACHINES.setdefault(path, Transducer(path))
    out = np.zeros(len(texts), np.int64)
    pieces: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pieces:
            np.add.at(out, owner, count_normalised(machine, pieces))
            pieces.clear(), owner.clear()
        size = 0

    for row, text in enumerate(texts):
        if not text:
            continue
        parts = [text]
        if any(x in text for x in machine.special_texts):
            parts = machine.specials.split(text)
            out[row] += len(parts) - 1
        for part in map(normalise, parts):
            if part:
                pieces.append(part), owner.append(row)
                size += len(part)
                if size > SLICE:
                    flush()
    flush()
    return out.tolist()


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """df with a column of token counts; one narrow pass, no shuffle.

    vocabulary: place of the tokenizer file on each machine. Other columns pass
    unchanged; a column named like ``count`` is replaced.
    """
    tune(df.sparkSession)
    kept = df.drop(count)
    schema = extended(kept.schema, **{count: "long"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = count_texts(vocabulary, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64())], [*batch.schema.names, count])

    return kept.mapInArrow(lean(run), schema)


def query(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document."""
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"), "text")
    out = token_counts(rows, vocabulary)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
