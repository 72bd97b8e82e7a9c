"""Benchmark decontamination.

The normalised n-grams of all test items form a hash set that is broadcast; every window of n tokens of every document
is looked up in it, hits are verified on the tokens themselves, and the hit tokens are removed. A document of which
hits cover at least ``drop_share`` is removed whole.

Defined results: a null or empty text has no tokens and stays as it is (null stays null); an item shorter than ``n``
tokens is one gram of its own length (of less than ``least``, by default 1, it is ignored); null items and items without
tokens are ignored; repeated items and rows change nothing; with no items every document stays. Texts of any length are
scanned whole. Other columns pass through ``cleaned`` untouched; ``decontaminate`` returns columns of its own.
"""

from __future__ import annotations

import functools
import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm import common, textnum

N, LEAST, DROP_SHARE = 8, 1, 0.5
#: Grams that are broadcast; a larger set is written to the shared folder and memory-mapped.
BROADCAST_GRAMS = 2_000_000
_Q = np.uint64(0xD6E8FEB86659FD93)


class Grams(NamedTuple):
    length: int
    hashes: np.ndarray  # sorted
    ends: np.ndarray  # where each gram's tokens end in ``blob``
    blob: np.ndarray  # the tokens of all grams, joined by spaces, as UTF-8 bytes
    seen: np.ndarray  # bitmap over the hashes' top bits
    bits: int  # how many


def bitmap_bits(count: int) -> int:
    """Top bits of a hash by which a bitmap of ``count`` grams stays at most about a sixteenth full, up to 2 GB."""
    return min(34, max(22, count.bit_length() + 4))


def _window(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n tokens."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * _Q + h[k : len(h) - n + 1 + k]
    return textnum.mix(out)


def _gram_rows(n: int, least: int):
    def run(batches):
        for b in batches:
            size, hashes, grams = [], [], []
            for t in textnum.tokenize(b.column("text").to_pylist()):
                words = [textnum.word_of(t, i) for i in range(len(t.hash))]
                first = np.searchsorted(t.doc, np.arange(len(t.base) + 1))
                for a, z in zip(first[:-1], first[1:]):
                    m = min(n, z - a)
                    if m >= least:
                        h = _window(t.hash[a:z], m)
                        size += [m] * len(h)
                        hashes += h.view(np.int64).tolist()
                        grams += [" ".join(words[i : i + m]) for i in range(a, z - m + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(hashes, pa.int64()), pa.array(grams, pa.string())], ["size", "hash", "gram"])

    return run


def _pack(length: int, rows: list, bits: int) -> Grams:
    rows = sorted(((h % (1 << 64), g.encode("utf-8", "surrogatepass")) for h, g in rows))
    hashes = np.array([h for h, _ in rows], dtype=np.uint64)
    seen = np.zeros(1 << bits - 3, dtype=np.uint8)
    _mark(seen, hashes, bits)
    blob = np.frombuffer(b"".join(g for _, g in rows), dtype=np.uint8)
    return Grams(length, hashes, np.cumsum([len(g) for _, g in rows], dtype=np.int64), blob, seen, bits)


def _mark(seen: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    top = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    np.bitwise_or.at(seen, top >> 3, np.uint8(128) >> (top & 7).astype(np.uint8))


def gram_index(benchmark: DataFrame, n: int = N, least: int = LEAST, limit: int = BROADCAST_GRAMS):
    """A function that gives the grams by length: from a broadcast, or beyond ``limit`` from mapped files, to which
    the driver writes one slice of hashes after the other."""
    spark = benchmark.sparkSession
    rows = (
        benchmark.where(F.col("text").isNotNull())
        .select("text")
        .mapInArrow(_gram_rows(n, least), "size int, hash bigint, gram string")
        .distinct()
    )
    rows = common.written(rows, "grams")
    count = rows.count()
    sizes = sorted(r[0] for r in rows.select("size").distinct().collect())
    if count <= limit:
        found = rows.collect()
        held = spark.sparkContext.broadcast([_pack(s, [(r[1], r[2]) for r in found if r[0] == s], bitmap_bits(count)) for s in sizes])
        return lambda: held.value
    folder = common.local_path(common.shared_path(spark, "gramset"))
    os.makedirs(folder)
    slices = -(-count // limit)
    width = -(-(1 << 63) // slices)
    top = F.shiftrightunsigned("hash", 1)
    for s in sizes:
        bits, offset = bitmap_bits(count), 0
        seen = np.memmap(f"{folder}/{s}.seen", dtype=np.uint8, mode="w+", shape=(1 << bits - 3,))
        with open(f"{folder}/{s}.hashes", "wb") as a, open(f"{folder}/{s}.ends", "wb") as b, open(f"{folder}/{s}.blob", "wb") as c:
            for k in range(slices):
                part = rows.where((F.col("size") == s) & (top >= k * width) & (top <= min((k + 1) * width, 1 << 63) - 1))
                g = _pack(s, [(r[1], r[2]) for r in part.collect()], 22)
                a.write(g.hashes.tobytes())
                b.write((g.ends + offset).tobytes())
                c.write(g.blob.tobytes())
                offset += len(g.blob)
                _mark(seen, g.hashes, bits)
        seen.flush()
    return functools.partial(_mapped, folder, tuple(sizes), bitmap_bits(count))


@functools.cache
def _mapped(folder: str, sizes: tuple[int, ...], bits: int) -> list[Grams]:
    kinds = (("hashes", np.uint64), ("ends", np.int64), ("blob", np.uint8), ("seen", np.uint8))
    return [Grams(s, *(np.memmap(f"{folder}/{s}.{k}", dtype=d, mode="r") for k, d in kinds), bits) for s in sizes]


def _hit_tokens(t: textnum.Tokens, grams: list[Grams]) -> np.ndarray:
    """Which tokens of a chunk lie in a verified hit."""
    hit = np.zeros(len(t.hash) + 1, dtype=np.int32)
    for g in grams:
        m = g.length
        h = _window(t.hash, m)
        top = (h >> np.uint64(64 - g.bits)).astype(np.int64)
        at = np.flatnonzero((g.seen[top >> 3] >> (7 - (top & 7)).astype(np.uint8)) & 1)
        at = at[t.doc[at] == t.doc[at + m - 1]]
        if not len(at):
            continue
        k = np.searchsorted(g.hashes, h[at])
        ok = k < len(g.hashes)
        at, k = at[ok], k[ok]
        ok = g.hashes[k] == h[at]
        for i, j in zip(at[ok].tolist(), k[ok].tolist()):
            words = " ".join(textnum.word_of(t, x) for x in range(i, i + m)).encode("utf-8", "surrogatepass")
            while j < len(g.hashes) and g.hashes[j] == h[i]:  # equal hashes of other tokens are told apart here
                if bytes(g.blob[(g.ends[j - 1] if j else 0) : g.ends[j]]) == words:
                    hit[i] += 1
                    hit[i + m] -= 1
                    break
                j += 1
    return np.cumsum(hit[:-1]) > 0


def clean_texts(texts: list[str | None], grams: list[Grams]) -> list[tuple[str | None, int, int, int]]:
    """For each text: what is left (None where nothing was hit), its tokens, the hit tokens, the spans removed."""
    out: list[tuple[str | None, int, int, int]] = [(None, 0, 0, 0)] * len(texts)
    for t in textnum.tokenize(texts):
        hit = _hit_tokens(t, grams)
        size = np.bincount(t.doc, minlength=len(t.base))
        hits = np.bincount(t.doc[hit], minlength=len(t.base))
        for d, n in enumerate(size.tolist()):
            out[t.first + d] = (None, n, 0, 0)
        first = np.searchsorted(t.doc, np.arange(len(t.base) + 1))
        for d in np.flatnonzero(hits).tolist():
            a, z = first[d], first[d + 1]
            text, left, at, spans = texts[t.first + d], [], 0, 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:z].astype(np.int8), [0]])))
            for i, j in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                left.append(text[at : (t.end[a + i - 1] - t.base[d]) if i else 0])
                at, spans = t.end[a + j - 1] - t.base[d], spans + 1
            left.append(text[at:])
            out[t.first + d] = ("".join(left), int(size[d]), int(hits[d]), spans)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = N, least: int = LEAST, drop_share: float = DROP_SHARE
) -> DataFrame:
    """A row per document: doc_id, text (what is left; null for a removed document), n_tokens, n_hit, n_spans and
    action: keep, trim or drop. A hit token goes with the characters between it and the token before."""
    index = gram_index(benchmark, n, least)
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            found = clean_texts(texts, index())
            action = ["keep" if not h else "drop" if h >= drop_share * size else "trim" for _, size, h, _ in found]
            left = [None if a == "drop" else t if a == "keep" else f[0] for t, f, a in zip(texts, found, action)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(left, pa.string()), *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3)), pa.array(action, pa.string())],
                ["doc_id", "text", "n_tokens", "n_hit", "n_spans", "action"],
            )

    schema = "doc_id bigint, text string, n_tokens bigint, n_hit bigint, n_spans bigint, action string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def cleaned(
    docs: DataFrame, benchmark: DataFrame, n: int = N, least: int = LEAST, drop_share: float = DROP_SHARE
) -> DataFrame:
    """The documents without removed ones, with trimmed texts and, where there is such a column, their new n_chars;
    all columns stay."""
    index = gram_index(benchmark, n, least)

    def change(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        found = clean_texts(texts, index())
        keep = pa.array([not h or h < drop_share * size for _, size, h, _ in found], pa.bool_())
        if any(h for _, _, h, _ in found):
            new = [t if f[0] is None else f[0] for t, f in zip(texts, found)]
            b = _replace(b, "text", pa.array(new, b.schema.field("text").type))
            if "n_chars" in b.schema.names:
                old = b.column("n_chars").to_pylist()
                count = [o if f[0] is None else len(f[0]) for o, f in zip(old, found)]
                b = _replace(b, "n_chars", pa.array(count, b.schema.field("n_chars").type))
        return b.filter(keep)

    return common.pass_rows(docs, change)


def _replace(b: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = b.schema.get_field_index(name)
    return pa.RecordBatch.from_arrays([values if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)
