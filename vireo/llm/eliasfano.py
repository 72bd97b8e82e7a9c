"""Elias-Fano sequences over numpy arrays, so that they can be memory-mapped and queried in bulk.

A non-decreasing sequence of n values below u keeps the low bits of each value packed, and the high bits in unary: bit
(v >> low) + i is set for the i-th value v. The ones and the zeros before each 64-bit word are kept beside, so that either
is found by binary search; within a word, counts of its bytes and a table of bytes lead to the bit.
"""

from __future__ import annotations

import json
import mmap
from typing import NamedTuple

import numpy as np

#: In each byte a one, and the top bit; the position of the r-th one of byte b at 8 b + r.
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for b in range(256) for r in range(8)], dtype=np.uint8)


def _u(x) -> np.ndarray:
    return np.asarray(x).astype(np.uint64)


class Sequence(NamedTuple):
    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    rank: np.ndarray  # ones before each word, and all ones
    zeros: np.ndarray  # zeros before each word, and all zeros


def build(values: np.ndarray) -> Sequence:
    """The sequence of non-decreasing values."""
    v = _u(values)
    n = len(v)
    top = int(v[-1]) + 1 if n else 1
    low_bits = max(0, (top // max(1, n)).bit_length() - 1)
    words = (n * low_bits + 63) // 64 + 2
    low = np.zeros(words, dtype=np.uint64)
    if low_bits and n:
        part = v & _u((1 << low_bits) - 1)
        bit = np.arange(n, dtype=np.int64) * low_bits
        at, shift = bit >> 6, _u(bit & 63)
        # values that start in the same word do not overlap, so adding is setting
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        low[at[first]] += np.add.reduceat(part << shift, first)
        spill = np.flatnonzero((bit & 63) + low_bits > 64)
        low[at[spill] + 1] += part[spill] >> (_u(64) - shift[spill])
    size = n + (top >> low_bits) + 2
    bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
    bits[(v >> _u(low_bits)).astype(np.int64) + np.arange(n)] = 1
    high = np.packbits(bits, bitorder="little").view(np.uint64)
    rank = np.zeros(len(high) + 1, dtype=np.int64)
    np.cumsum(np.bitwise_count(high), out=rank[1:])
    kind = np.uint32 if len(bits) < 1 << 32 else np.int64
    return Sequence(n, low_bits, low, high, rank.astype(kind), (np.arange(len(rank)) * 64 - rank).astype(kind))


def where(true: np.ndarray) -> np.ndarray:
    """As np.flatnonzero, which takes longer to call than to answer where a look-up is small."""
    return true.nonzero()[0]


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th one (from 0) of each word, which has more ones than that."""
    r = r.astype(np.uint64)
    upto = np.bitwise_count(word.view(np.uint8)).view(np.uint64) * _ONES  # in each byte, the ones of it and of the lower ones
    shift = np.bitwise_count(((r * _ONES | _TOPS) - upto) & _TOPS).astype(np.uint64) << 3  # bytes that end before that one
    r -= (upto << 8) >> shift & 255
    return (shift + _IN_BYTE[(((word >> shift) & 255) << 3) | r]).astype(np.int64)


def _select(count: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The word that holds the k-th of what ``count`` counts."""
    return count.searchsorted(k.astype(count.dtype), side="right") - 1  # of like type, or all counts would be converted


def _ones_below_first(word: np.ndarray) -> np.ndarray:
    """Position of the lowest one of each word; 64 if there is none."""
    return np.bitwise_count((word & (~word + 1)) - 1).astype(np.int64)


def _low(s: Sequence, i: np.ndarray) -> np.ndarray:
    if not s.low_bits:
        return np.zeros(len(i), dtype=np.int64)
    low = s.low.view(np.int64)
    bit = i * s.low_bits
    at, shift = bit >> 6, bit & 63
    x = low[at] >> shift
    over = where(shift > 64 - s.low_bits)
    if len(over):  # the rest of these is in the next word; shifting has spread the sign
        rest = 64 - shift[over]
        x[over] = x[over] & ((1 << rest) - 1) | low[at[over] + 1] << rest
    x &= (1 << s.low_bits) - 1
    return x


def _value(s: Sequence, i: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values at positions i, whose bits are ``at``."""
    return (at - i) << s.low_bits | _low(s, i)


def _bit(s: Sequence, i: np.ndarray) -> np.ndarray:
    word = _select(s.rank, i)
    return word * 64 + _select_in_word(s.high[word], i - s.rank[word])


def get(s: Sequence, i: np.ndarray) -> np.ndarray:
    """The values at positions i."""
    i = np.asarray(i, dtype=np.int64)
    if not len(i):
        return np.zeros(0, dtype=np.int64)
    return _value(s, i, _bit(s, i))


def get_two(s: Sequence, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values at positions i and i + 1."""
    i = np.asarray(i, dtype=np.int64)
    if not len(i):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = _bit(s, i)
    rest = s.high[at >> 6] >> (at & 63).astype(np.uint64) >> 1
    after = at + 1 + _ones_below_first(rest)
    far = where(rest == 0)  # the next one is in another word
    if len(far):
        after[far] = _bit(s, i[far] + 1)
    return _value(s, i, at), _value(s, i + 1, after)


def _run(s: Sequence, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values with high bits h begin and end."""
    h = np.minimum(h, int(s.zeros[-1]) - 1)  # two zeros at least end the bits, so nothing lies between the last two

    def end(k: np.ndarray) -> np.ndarray:  # the bit of the k-th zero
        word = _select(s.zeros, k)
        return word * 64 + _select_in_word(~s.high[word], k - s.zeros[word])

    # the zero that ends run h-1 is where run h begins
    first = np.zeros(len(h), dtype=np.int64)
    some = where(h > 0)
    first[some] = end(h[some] - 1) + 1
    rest = ~s.high[first >> 6] >> (first & 63).astype(np.uint64)
    last = first + _ones_below_first(rest)
    far = where(rest == 0)
    if len(far):
        last[far] = end(h[far])
    return first - h, last - h


def find(s: Sequence, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
    """Position of each x in its part [lo, hi) of the sequence, found as the last value up to it; -1 where it is not there."""
    x = np.asarray(x, dtype=np.int64)
    if not len(x) or not s.n:
        return np.full(len(x), -1, dtype=np.int64)
    a, z = _run(s, x >> s.low_bits)
    if lo is not None:
        a, z = np.maximum(a, lo), np.minimum(z, hi)
    want = x & ((1 << s.low_bits) - 1)
    ok = where(a < z)
    live = where(a + 1 < z)
    lower, upper, sought = a[live], z[live], want[live]
    while len(live):
        mid = (lower + upper) >> 1
        more = _low(s, mid) > sought
        lower, upper = np.where(more, lower, mid), np.where(more, mid, upper)
        on = lower + 1 < upper
        if 2 * np.count_nonzero(on) <= len(live):  # to go on with those that are found changes nothing
            a[live] = lower
            live, lower, upper, sought = live[on], lower[on], upper[on], sought[on]
    ok = ok[_low(s, a[ok]) == want[ok]]
    out = np.full(len(x), -1, dtype=np.int64)
    out[ok] = a[ok]
    return out


def save(path: str, arrays: dict[str, np.ndarray | Sequence]) -> None:
    """Arrays and sequences in one file: the length of a JSON header, the header, the arrays at multiples of 8 bytes."""
    flat: dict[str, np.ndarray] = {}
    head: dict[str, dict] = {}
    for k, a in arrays.items():
        if isinstance(a, Sequence):
            head[k] = {"n": a.n, "low_bits": a.low_bits}
            flat |= {f"{k}.{p}": getattr(a, p) for p in ("low", "high", "rank", "zeros")}
        else:
            flat[k] = np.asarray(a)
    at = 0
    for k, a in flat.items():
        head.setdefault(k, {}).update({"dtype": a.dtype.str, "at": at, "size": len(a)})
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with open(path, "wb") as f:
        f.write(np.uint64(len(text)).tobytes() + text)
        for a in flat.values():
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * (-a.nbytes % 8))


def load(path: str) -> dict[str, np.ndarray | Sequence]:
    """What ``save`` wrote, memory-mapped."""
    with open(path, "rb") as f:
        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int(np.frombuffer(m, np.uint64, 1)[0])
    head = json.loads(m[8 : 8 + size])
    array = lambda h: np.frombuffer(m, h["dtype"], h["size"], 8 + size + h["at"])
    out: dict[str, np.ndarray | Sequence] = {}
    for k, h in head.items():
        if "n" in h:
            out[k] = Sequence(h["n"], h["low_bits"], *(array(head[f"{k}.{p}"]) for p in ("low", "high", "rank", "zeros")))
        elif k.rpartition(".")[0] not in head:
            out[k] = array(h)
    return out
