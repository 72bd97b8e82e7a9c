"""SimHash near-duplicate removal by multi-index hashing.

Each document gets a 256-bit SimHash of its distinct tokens. Fingerprints that are equal collapse first. The others are
cut into eleven blocks of 23 bits (for ``max_distance`` 40; a quarter as many blocks as the distance plus one, rounded up), and
each block into four pieces. 41 pieces are more than 40 flips, so two fingerprints within the distance have a block that
differs in three bits at most, and in it a piece that is equal: they meet in the table of that block and piece, where every
block within three flips is looked up and the full 256-bit distance decides. So no pair within the distance is left out, and
no number of partners is capped. A run of equal blocks is first compared with its first row; where all are near it, they are
connected, and other runs need to be near that row alone; elsewhere every row is compared with every other. So the connected
groups are those of all pairs, at a cost linear in a group of copies.

A fingerprint has one row per block and piece, and rows are split by the leading bits of that piece. So every fingerprint is
shuffled ``2 * SEGMENTS`` times, whatever the number of splits: more documents mean more splits, up to the values of a piece,
not other results. Rows carry the fingerprint, as by chance every row meets many others to be verified.

Defined results: a null doc_id or a text without tokens has no fingerprint, is in no group and stays; rows that repeat a
doc_id are one document, which belongs to the groups of all its texts, and of which one row stays (of the smallest
fingerprint); of a group the smallest doc_id stays; empty tables give empty results; texts of any length are read whole;
columns of any other name pass through ``deduplicated`` and are ignored by ``groups``.
"""

from __future__ import annotations

import functools
import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vireo.llm import common, textnum

WORDS, WIDTH, MAX_DISTANCE = 4, 24, 40
#: Halves of the blocks that ``MAX_DISTANCE`` needs: at most WIDTH bits a block.
SEGMENTS = 2 * -(-(MAX_DISTANCE + 1) // 4)
#: Room for the leading bits of a piece in the number of a split.
PIECE = 12
#: Distinct fingerprints that one split of a table holds, about; only the split depends on it.
SPLIT_ROWS = 100_000
#: Distinct blocks with an equal piece up to which all pairs are compared bit by bit, not by flips; pairs held before they are folded.
PAIRWISE, FOUND = 400, 1 << 20
_F = [f"f{i}" for i in range(WORDS)]
_FP = ", ".join(f"{f} bigint" for f in _F)
_SALT = [np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(WORDS)]


def simhash(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(whether a text has tokens, its fingerprint as four words) for each text."""
    has, out = np.zeros(len(texts), dtype=bool), np.zeros((len(texts), WORDS), dtype=np.uint64)
    for t in textnum.tokenize(texts):
        order = np.argsort(t.hash, kind="stable")
        order = order[np.argsort(t.doc[order], kind="stable")]
        h, d = t.hash[order], t.doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        at = textnum.runs(d)
        if not len(at):
            continue
        size = np.diff(np.append(at, len(d)))
        has[t.first + d[at]] = True
        for k in range(WORDS):
            bits = np.unpackbits(textnum.mix(h + _SALT[k]).view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
            out[t.first + d[at], k] = np.packbits(2 * ones > size[:, None], axis=1).view(np.uint64)[:, 0]
    return has, out


def fingerprints(docs: DataFrame, *carry: Column) -> DataFrame:
    """doc_id and the four words of the SimHash, null where the text has no tokens; and the bigints ``c0``, ``c1``, ... to
    carry."""
    common.small_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(carry))]

    def run(batches):
        for b in batches:
            has, fp = simhash(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(fp[:, k].view(np.int64), pa.int64(), mask=~has) for k in range(WORDS)), *(b.column(c) for c in names)], ["doc_id", *_F, *names]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *(c.alias(n) for c, n in zip(carry, names)))
    return rows.mapInArrow(run, ", ".join(["doc_id bigint", _FP, *(f"{n} bigint" for n in names)]))


def _blocks(max_distance: int) -> tuple[int, np.ndarray]:
    """(number of blocks, edges of a block's four pieces) for the distance."""
    n = -(-(max_distance + 1) // 4)
    return n, np.linspace(0, min(WIDTH, 64 * WORDS // n), 5).astype(np.int64)


def _segments(fp: np.ndarray, max_distance: int = MAX_DISTANCE) -> np.ndarray:
    """The halves of the blocks of each fingerprint as integers: (rows, 2 * blocks)."""
    n, edge = _blocks(max_distance)
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1)[:, : n * edge[4]]
    bits = bits.reshape(len(fp), n, edge[4]).astype(np.int64)
    half = [bits[:, :, a:z] @ (1 << np.arange(z - a - 1, -1, -1)) for a, z in ((0, edge[2]), (edge[2], edge[4]))]
    return np.stack(half, axis=2).reshape(len(fp), 2 * n)


def _spread(prefix: int, max_distance: int = MAX_DISTANCE):
    """Rows of the tables, one per piece: (split, block with the piece in front, rep, fingerprint)."""
    n, edge = _blocks(max_distance)
    width = int(edge[4])

    def run(batches):
        for b in batches:
            half = _segments(np.stack([b.column(f).to_numpy() for f in _F], axis=1), max_distance)
            for s in range(n):
                key = half[:, 2 * s] << int(edge[4] - edge[2]) | half[:, 2 * s + 1]
                for q in range(4):
                    size, left = int(edge[q + 1] - edge[q]), int(edge[q])
                    key_q = (key << left | key >> (width - left)) & ((1 << width) - 1)  # rotated until the piece is in front
                    split = ((4 * s + q) << PIECE) | (key_q >> (width - min(prefix, size)))
                    yield pa.RecordBatch.from_arrays([pa.array(split), pa.array(key_q.astype(np.int32)), b.column("rep"), *(b.column(f) for f in _F)], ["split", "key", "rep", *_F])

    return run


class Runs(NamedTuple):
    """Rows in runs of equal keys; the first row of a run is its pivot."""

    rows: np.ndarray
    start: np.ndarray
    size: np.ndarray
    key: np.ndarray
    tight: np.ndarray  # every row is within the distance of the pivot


def _within(fp: np.ndarray, x: np.ndarray, y: np.ndarray, most: int, found: list) -> np.ndarray:
    """Which of the pairs are near; two words rule nearly all others out."""
    some = np.flatnonzero(np.bitwise_count(fp[:, 0][x] ^ fp[:, 0][y]) + np.bitwise_count(fp[:, 1][x] ^ fp[:, 1][y]) <= most)
    some = some[np.bitwise_count(fp[x[some]] ^ fp[y[some]]).sum(axis=1, dtype=np.int64) <= most]
    found.append((x[some], y[some]))
    ok = np.zeros(len(x), dtype=bool)
    ok[some] = True
    return ok


def _products(m: np.ndarray, block: int = 1 << 20):
    """(pair, index) for every index below each pair's m, in blocks."""
    total = np.concatenate([[0], np.cumsum(m)])
    for a in range(0, int(total[-1]), block):
        at = np.arange(a, min(a + block, int(total[-1])))
        pair = np.searchsorted(total, at, side="right") - 1
        yield pair, at - total[pair]


def _runs(fp: np.ndarray, key: np.ndarray, rows: np.ndarray, most: int, found: list) -> Runs:
    """Runs of equal keys; pivots are compared with their runs."""
    rows = rows[np.argsort(key[rows], kind="stable")]
    k = key[rows]
    start = textnum.runs(k)
    size = np.diff(np.append(start, len(k)))
    of = np.repeat(np.arange(len(start)), size)
    rest = np.flatnonzero(np.arange(len(k)) != start[of]) if len(k) else np.zeros(0, dtype=np.int64)
    ok = _within(fp, rows[start[of[rest]]], rows[rest], most, found)
    return Runs(rows, start, size, k[start], np.bincount(of[rest[~ok]], minlength=len(start)) == 0)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node): each node of the edges with the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for w in (u, v, label[u], label[v]):
            np.minimum.at(new, w, low)
        new = new[new]
        if (new == label).all():
            return nodes[label], nodes
        label = new


def _fold(found: list, most: int = FOUND) -> tuple[np.ndarray, np.ndarray] | None:
    """Put the pairs found so far, if they are more than ``most``, as one star per component, so that they stay few."""
    if sum(len(x) for x, _ in found) <= most and most:
        return None
    x, y = (np.concatenate([np.zeros(0, dtype=np.int64), *c]) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2
    root, node = _stars(x, y)
    found[:] = [(root[root != node], node[root != node])]
    return found[0]


def _cross(fp: np.ndarray, p: Runs, q: Runs, i: np.ndarray, j: np.ndarray, most: int, found: list) -> None:
    """Compare runs i of p with runs j of q. If both are tight and their pivots are near, all their rows are connected
    already; else every row is compared with every other."""
    ok = _within(fp, p.rows[p.start[i]], q.rows[q.start[j]], most, found)
    rest = np.flatnonzero(~(ok & p.tight[i] & q.tight[j]) & (p.size[i] * q.size[j] > 1))
    i, j = i[rest], j[rest]
    for pair, at in _products(p.size[i] * q.size[j]):
        n = q.size[j[pair]]
        _within(fp, p.rows[p.start[i[pair]] + at // n], q.rows[q.start[j[pair]] + at % n], most, found)
        _fold(found)
    _fold(found)


def _close(key: np.ndarray, low: int):
    """(i, j) of all pairs of the distinct ``key``, which rise, that agree but for one to three of their ``low`` low bits, in
    blocks, each pair once."""
    edge = np.append(textnum.runs(key >> low), len(key))
    table, flips = None, None
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
        k = (key[a:z] & ((1 << low) - 1)).astype(np.int32)
        if z - a <= PAIRWISE:
            near = np.bitwise_count(k[:, None] ^ k[None, :]) <= 3
            i, j = np.nonzero(near)
            up = i < j
            yield i[up] + a, j[up] + a
            continue
        if table is None:
            table = np.full(1 << low, -1, dtype=np.int32)
            flips = [np.array([1 << h, *(1 << h | 1 << x for x in range(h)), *(1 << h | 1 << x | 1 << y for x in range(h) for y in range(x))], dtype=np.int32) for h in range(low)]
        table[k] = np.arange(a, z, dtype=np.int32)
        for h in range(low):
            mine = np.flatnonzero(~(k >> h) & 1)  # each pair from the side that has 0 in the highest bit that differs
            step = max(1, (1 << 18) // max(1, len(mine)))
            for f in range(0, len(flips[h]), step):
                part = flips[h][f : f + step]
                to = table[part[:, None] ^ k[mine]].ravel()
                hit = np.flatnonzero(to >= 0)
                yield mine[hit % max(1, len(mine))] + a, to[hit].astype(np.int64)
        table[k] = -1


def _match(max_distance: int):
    """The components of one split of one table: pairs within three flips of a block and ``max_distance`` in all connect."""
    _, edges = _blocks(max_distance)

    def run(t: pa.Table) -> pa.Table:
        q = (t.column("split")[0].as_py() >> PIECE) % 4
        fp = np.stack([t.column(f).to_numpy().view(np.uint64) for f in _F]).T  # each word in a row of its own
        key, rep = t.column("key").to_numpy().astype(np.int64), t.column("rep").to_numpy()
        found: list = []
        own = _runs(fp, key, np.arange(len(key)), max_distance, found)
        if not q:  # equal blocks meet here alone
            loose = np.flatnonzero(~own.tight)
            _cross(fp, own, own, loose, loose, max_distance, found)
        for i, j in _close(own.key, int(edges[4] - edges[q + 1] + edges[q])):
            _cross(fp, own, own, i, j, max_distance, found)
        x, y = _fold(found, 0)
        root, node = _stars(rep[x], rep[y])
        some = root != node
        return pa.table({"a": root[some], "b": node[some]})

    return run


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Edges (a < b) between ``rep`` ids that connect all near fingerprints: of each split of each table a star per
    component, so that there are never more edges than rows, however large a group of copies is."""
    n = distinct.count()
    prefix = min(PIECE, max(2, int(np.ceil(np.log2(max(1, n) / split_rows)))))
    rows = distinct.mapInArrow(_spread(prefix, max_distance), f"split bigint, key int, rep bigint, {_FP}")
    return rows.groupBy("split").applyInArrow(_match(max_distance), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root the smallest node of its component: alternating large and
    small stars until nothing changes. Every round is written to the shared folder."""
    e = common.written(edges.select("a", "b").where("a <> b"), "stars")
    state = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x")
        new = small.select(F.col("m").alias("a"), F.col("y").alias("b")).union(low.select("m", "x")).where("a <> b").distinct()
        new = common.written(new, "stars")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        common.drop_written(e)
        e = new
        if now == state:
            return e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        state = now


def _grouped(fps: DataFrame, max_distance: int) -> DataFrame:
    """Written fingerprints with ``root``: the smallest doc_id of the group, null where there is no fingerprint."""
    some = fps.where(F.col("doc_id").isNotNull() & F.col("f0").isNotNull())
    distinct = common.written(some.groupBy(*_F).agg(F.min("doc_id").alias("rep")), "distinct")
    edges = links(distinct, max_distance)
    again = some.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not again.isEmpty():  # a doc_id with several texts is one node: it connects them
        own = fps.join(again, "doc_id", "left_semi").join(distinct, _F).where("doc_id <> rep")
        edges = edges.unionByName(own.select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")))
    roots = components(edges)
    reps = distinct.join(roots, distinct["rep"] == roots["node"], "left").select(*_F, F.coalesce("root", "rep").alias("root"))
    return fps.join(reps, _F, "left")


def groups(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """A row per row of ``docs``: doc_id, keep_id (the smallest doc_id of its group, itself where it has none) and is_kept,
    which is true for one row of each group."""
    rows = common.written(fingerprints(docs, F.monotonically_increasing_id()), "fingerprints")
    found = _grouped(rows, max_distance)
    keep = F.coalesce(F.col("root") == F.col("doc_id"), F.lit(True))
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.struct(*_F, "c0"))["c0"].alias("first")).where("n > 1")
    if not again.isEmpty():
        found = found.join(again.select("doc_id", "first"), "doc_id", "left")
        keep = keep & (F.col("first").isNull() | (F.col("first") == F.col("c0")))
    return found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("keep_id"), keep.alias("is_kept"))


@functools.lru_cache(maxsize=64)
def _vector(path: str) -> np.ndarray:
    return np.fromfile(path, dtype=np.int64)


def _save_vectors(folder: str):
    def run(t: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        file, rows = t.column("c0")[0].as_py(), np.sort(t.column("c1").to_numpy())
        path = f"{folder}/{file & (1 << 64) - 1:016x}"
        own = f"{path}.{TaskContext.get().taskAttemptId()}"
        rows.tofile(own)
        os.replace(own, path)
        return pa.table({"file": pa.array([file])})

    return run


def deduplicated(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The documents without those that another of their group stands for; all columns stay.

    Texts are never moved: the rows that go are noted as row numbers, one small file of them per file of ``docs`` in the
    shared folder, and a second scan leaves them out. A frame that is not just a scan of files is written first: another
    reading of it could give other rows."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = common.written(docs, "documents")
    own = docs.metadataColumn("_metadata")
    row, path = own["row_index"], own["file_path"]
    place = [F.xxhash64(path), row]
    found = common.written(_grouped(common.written(fingerprints(docs, *place), "fingerprints"), max_distance).select("doc_id", "root", *_F, "c0", "c1"), "groups")
    gone = found.where("root <> doc_id")
    kept = found.where("doc_id is not null and (root is null or root = doc_id)")
    if not kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # one row of each doc_id stays
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(*_F, "c0", "c1"))
        gone = gone.unionByName(kept.withColumn("nth", nth).where("nth > 1").drop("nth"))
    folder = common.local_path(common.shared_path(docs.sparkSession, "gone"))
    os.makedirs(folder, exist_ok=True)
    # which data files lose rows: of these a missing file of row numbers is an error
    saved = gone.select("c0", "c1").groupBy("c0").applyInArrow(_save_vectors(folder), "file bigint").collect()
    files = docs.sparkSession.sparkContext.broadcast(frozenset(r["file"] for r in saved))
    width, schema = len(docs.columns), docs.schema
    names = docs.columns

    def run(batches):
        for b in batches:
            file, at = b.column(width).to_numpy(), b.column(width + 1).to_numpy()
            keep = np.ones(b.num_rows, dtype=bool)
            for f in files.value.intersection(np.unique(file).tolist()):
                mine = np.flatnonzero(file == f)
                keep[mine] = ~np.isin(at[mine], _vector(f"{folder}/{int(f) & (1 << 64) - 1:016x}"))
            out = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(out.columns[:width], names)

    common.small_batches(docs.sparkSession)
    free = [n for n in (f"__{i}" for i in range(width + 2)) if n not in map(str.lower, names)]
    return docs.select("*", place[0].alias(free[0]), place[1].alias(free[1])).mapInArrow(run, schema)
