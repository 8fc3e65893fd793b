"""Byte-pair encoding as a forward pass over prefixes instead of a merge queue.

A sequence of tokens is what BPE makes of its text exactly if every two
neighbours are what BPE makes of theirs (Berglund and van der Merwe, 2023). So
each prefix has one possible last token: the vocabulary entry that ends there and
fits the last token of the prefix before it. That gives a trellis whose forward
state at a position depends on the prefix alone, and words that share a prefix
share its states.
"""

from __future__ import annotations

import json
from collections.abc import Iterable


class Trellis:
    """Forward states over symbols for one vocabulary.

    tokens: text of each token that merges can make, by id; ranks: the order in
    which a pair of ids merges, and the id it makes. A token without a merge of
    its own is a base symbol.
    """

    def __init__(self, tokens: dict[int, tuple[str, ...]], ranks: dict[tuple[int, int], tuple[int, int]]):
        self.ranks = ranks
        self.made: dict[int, tuple[int, int, int]] = {}
        self.base = {v[0]: k for k, v in tokens.items() if len(v) == 1}
        self.ids: dict[tuple[str, ...], int] = {}
        self.longest = 1
        self.fits_memo: dict[tuple[int, int], bool] = {}
        for k, v in tokens.items():
            if len(v) == 1:
                self.ids[v] = k
            elif all(x in self.base for x in v):
                # Only tokens that merging can reach; the last merge made tells how.
                ids, last = self.merge([self.base[x] for x in v])
                if ids == [k]:
                    self.ids[v], self.made[k] = k, last
                    self.longest = max(self.longest, len(v))

    def merge(self, ids: list[int]) -> tuple[list[int], tuple[int, int, int]]:
        """Plain merging, best rank first and leftmost among equals, for short inputs: (ids, last merge)."""
        ids, last = list(ids), (0, 0, 0)
        while len(ids) > 1:
            best = min((self.ranks[p][0], i) if (p := (ids[i], ids[i + 1])) in self.ranks else (1 << 60, i) for i in range(len(ids) - 1))
            if best[0] == 1 << 60:
                break
            i = best[1]
            last = (best[0], ids[i], ids[i + 1])
            ids[i : i + 2] = [self.ranks[ids[i], ids[i + 1]][1]]
        return ids, last

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps these two neighbours apart."""
        key = (left, right)
        known = self.fits_memo.get(key)
        if known is None:
            if len(self.fits_memo) > 100_000:
                self.fits_memo.clear()
            known = self.fits_memo[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Undo merges latest first, on either side of the border. The two symbols at
        # the border must not have had a merge due before the later one was made.
        # Equal ranks go to the leftmost pair, so the left side's own merge wins a tie.
        until = (1 << 60, 0)
        while True:
            across = self.ranks.get((left, right))
            if across is not None and (across[0], 1) < until:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                until, left = (a[0], 1), a[2]
            else:
                until, right = (b[0], 2), b[1]


class TextTrellis(Trellis):
    """The same over plain strings: one character a symbol, with a faster step."""

    def __init__(self, tokens, ranks):
        super().__init__(tokens, ranks)
        self.by_text = {"".join(k): v for k, v in self.ids.items()}
        self.sizes = {v: len(k) for k, v in self.by_text.items()}
        self.ids = {}  # the texts are enough from here on

    def step_text(self, text: str, n: int, last: list[int]) -> int:
        by_text, fits = self.by_text, self.fits
        for begin in range(max(0, n - self.longest), n):
            token = by_text.get(text[begin:n])
            if token is not None and (begin == 0 or fits(last[begin - 1], token)):
                return token
        raise ValueError("no token ends here")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others take code points from 256 on in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def read_word_bpe(path: str) -> dict:
    """The parts of a tokenizer .json with an end-of-word suffix that the transducer needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
    return {"vocab": vocab, "suffix": suffix, "pairs": pairs, "specials": [x["content"] for x in spec["added_tokens"] if not x["normalized"]]}


def split_suffix(token: str, suffix: str) -> tuple[str, ...]:
    """Symbols of a token; the last one carries the end-of-word mark."""
    if token.endswith(suffix) and len(token) > len(suffix):
        body = token[: -len(suffix)]
        return (*body[:-1], body[-1] + suffix)
    return tuple(token)


def common_prefix(a: Iterable, b: Iterable) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n
