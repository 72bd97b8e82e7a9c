"""Vectorised tokenisation: whole batches of texts become numpy arrays, with no Python work per token.

A token is a maximal run of letters, numbers and combining marks (Unicode classes L, N, M), lowercased code point by
code point, so that offsets into the original text stay valid. Each token gets a 64-bit hash: a polynomial over its
code points, taken from prefix sums, and then mixed.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Code points handled at once; a longer single text is a chunk of its own.
CHUNK_CHARS = 400_000


class Tokens(NamedTuple):
    """Tokens of texts ``first`` to ``first + len(base) - 1`` of a batch; offsets count from the start of the chunk."""

    first: int
    base: np.ndarray  # where each text starts
    doc: np.ndarray  # text of each token, counted from ``first``
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    cp: np.ndarray  # lowercased code points of the chunk


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of all code points: whether they belong to tokens, and their lower case where that is one code point."""
    word, lower = np.zeros(0x110000, dtype=bool), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        if kind in "LNM":
            word[i] = True
            if kind == "L" and len(low := c.lower()) == 1:
                lower[i] = ord(low)
    return word, lower


_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        size = max(n + 1, CHUNK_CHARS + 1)
        for k, base in (("p", _P), ("q", _PINV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, start of each text and the end, code points) of runs of texts; a line feed follows every text."""
    i, n = 0, len(texts)
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + len(texts[j] or "") <= CHUNK_CHARS):
            size += len(texts[j] or "") + 1
            j += 1
        part = [t or "" for t in texts[i:j]]
        base = np.zeros(j - i + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in part], out=base[1:])
        yield i, base, codepoints("\n".join(part) + "\n")
        i = j


def tokenize(texts: Sequence[str | None]) -> Iterator[Tokens]:
    """Tokens of every text, chunk by chunk. None counts as the empty text."""
    word, lower = _tables()
    for first, base, raw in chunks(texts):
        cp = lower[raw]
        inside = word[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]  # the last code point is a line feed, so runs always close
        p, q = _pow(len(cp))
        sums = np.zeros(len(cp) + 1, dtype=np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * p[: len(cp)], out=sums[1:])
        hashed = mix((sums[end] - sums[start]) * q[start])
        doc = np.searchsorted(base, start, side="right") - 1
        yield Tokens(first, base[:-1], doc, start, end, hashed, cp)


def hash_word(word: str) -> int:
    """The hash that ``tokenize`` gives a single token."""
    for t in tokenize([word]):
        if len(t.hash) == 1:
            return int(t.hash[0])
    raise ValueError(f"not one token: {word!r}")


def word_of(t: Tokens, i: int) -> str:
    """The i-th token of a chunk as text."""
    return t.cp[t.start[i] : t.end[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])
