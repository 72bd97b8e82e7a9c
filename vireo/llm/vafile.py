"""Exact top-k search with vector-approximation files.

Every vector is stored twice in the shared folder: as one cell number (one byte) per dimension, with cell bounds at the
dimension's quantiles, and exactly. The distance of a vector to its cell's centre is kept with the cells. Let c be that
centre and r that distance: then |q - c| - r and |q - c| + r bound |q - x|. A query scans all cells, block by block, keeps
every vector whose lower bound does not exceed the kth smallest upper bound so far, and then reads exact vectors in
lower-bound order until the kth exact distance is below the next lower bound. So the result is exact.

Files are memory-mapped: memory does not grow with the table, and queries are split over all tasks without a shuffle. The
scan works on values divided by a power of two near the largest absolute value, so that single precision neither overflows
nor vanishes; what it rounds off, the bounds allow for.

Defined results: exact distances are computed in double precision; where the largest absolute value is beyond 1e150 or
below 1e-150, on values divided by that power, so that squares stay finite and above 0 (differences below 1e-150 of the
largest value then count as none, and a distance beyond the largest double is infinite, but ranked); a row with a null id or vector, a vector of another length than the most common one, or with a value
that is null or not finite, is neither query nor answer; a row is no answer to itself, but rows that repeat its vector
are; rows that repeat an id are separate; equal distances rank by id; with fewer than k others all are returned.
"""

from __future__ import annotations

import functools
import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vireo.llm import common

K, CELLS, BLOCK = 10, 64, 8192
#: Beyond this absolute value squares would overflow, below its inverse they would vanish.
HUGE = 1e150
#: Queries that are scanned together.
QUERIES = 256


class File(NamedTuple):
    ids: np.ndarray
    cells: np.ndarray  # (vectors, dimensions), uint8
    radius: np.ndarray  # distance to the cell's centre
    exact: np.ndarray
    asks: np.ndarray  # positions of the queries


class Scale(NamedTuple):
    unit: float  # power of two by which the scan multiplies
    exact: float  # by which exact distances are multiplied: 1 unless all values are huge or tiny

    @staticmethod
    def of(largest: float) -> Scale:
        unit = 2.0 ** -min(max(int(np.frexp(largest)[1]) - 1, -1000), 1000) if largest else 1.0
        return Scale(unit, 1.0 if 1 / HUGE <= largest <= HUGE else unit)


def _clean(vectors: DataFrame, id_: str, vector: str, asked: Column | None) -> tuple[DataFrame, int]:
    asked = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    v = vectors.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), asked.alias("asked"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad)
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = sizes["n"] if sizes else 0
    return v.where(F.size("v") == n), n


def _cell_bounds(v: DataFrame, dims: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dimensions, cells - 1) quantiles over all vectors, and each dimension's least and greatest value."""
    shares = [i / cells for i in range(1, cells)]
    values = v.select(F.posexplode("v").alias("d", "x")).groupBy("d")
    rows = sorted(values.agg(F.percentile_approx("x", shares, 10_000).alias("q"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
    return np.array([r["q"] for r in rows]), np.array([r["lo"] for r in rows]), np.array([r["hi"] for r in rows])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _centres(bounds: np.ndarray, low: np.ndarray, high: np.ndarray, unit: float) -> np.ndarray:
    edges = np.concatenate([low[:, None], bounds, high[:, None]], axis=1) * unit
    return ((edges[:, 1:] + edges[:, :-1]) / 2).astype(np.float32)


def write_files(v: DataFrame, dims: int, bounds: np.ndarray, centres: np.ndarray, scale: Scale, folder: str) -> list[tuple[str, int, int]]:
    """Cells and exact vectors of each partition, as raw files; (name, vectors, queries) of each. A file is written under a name
    of its own and then renamed, so a repeated or parallel attempt replaces it by the same bytes."""

    def run(batches):
        from pyspark import TaskContext

        name = f"{TaskContext.get().partitionId():06d}"
        own = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}"
        total = asks = 0
        files = [open(f"{own}.{k}", "wb") for k in File._fields]
        for b in batches:
            x = _matrix(b.column("v"), dims)
            cells = np.stack([np.searchsorted(bounds[d], x[:, d], side="right") for d in range(dims)], axis=1).astype(np.uint8)
            centre = centres[np.arange(dims), cells].astype(np.float64)
            radius = np.sqrt(((x * scale.unit - centre) ** 2).sum(axis=1))
            asked = np.flatnonzero(b.column("asked").to_numpy(zero_copy_only=False)) + total
            for f, a in zip(files, (b.column("id").to_numpy(), cells, radius, x, asked)):
                f.write(np.ascontiguousarray(a).tobytes())
            total += len(x)
            asks += len(asked)
        for f, k in zip(files, File._fields):
            f.close()
            os.replace(f"{own}.{k}", f"{folder}/{name}.{k}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total]), pa.array([asks])], ["name", "total", "asks"])

    return sorted(tuple(r) for r in v.mapInArrow(run, "name string, total bigint, asks bigint").collect())


@functools.cache
def _open(folder: str, name: str, total: int, asks: int, dims: int) -> File:
    m = lambda k, kind, shape: np.memmap(f"{folder}/{name}.{k}", dtype=kind, mode="r", shape=shape)
    return File(m("ids", np.int64, (total,)), m("cells", np.uint8, (total, dims)), m("radius", np.float64, (total,)), m("exact", np.float64, (total, dims)), m("asks", np.int64, (asks,)) if asks else np.zeros(0, np.int64))


def search(files: list[File], centres: np.ndarray, scale: Scale, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, distances) of the k nearest of each query; ``own`` is each query's position over all files, left out."""
    dims = q.shape[1]
    upper = np.full((len(q), k), np.inf)  # the k smallest upper bounds
    rows, at, lows = [], [], []
    start, q32 = 0, (q * scale.unit).astype(np.float32)
    qq = (q32.astype(np.float64) ** 2).sum(axis=1)
    rounded = 1e-4 * (1 + np.sqrt(qq))[:, None]  # covers rounding of the scan in single precision
    for f in files:
        for a in range(0, len(f.ids), BLOCK):
            z = min(a + BLOCK, len(f.ids))
            c = centres[np.arange(dims), f.cells[a:z]]
            cc = (c.astype(np.float64) ** 2).sum(axis=1)
            d2 = qq[:, None] + cc[None, :] - 2.0 * (q32 @ c.T).astype(np.float64)
            slack = rounded * (1 + np.sqrt(cc))[None, :]
            d = np.sqrt(np.maximum(d2, 0))
            # |sqrt(x + e) - sqrt(x)| <= min(sqrt(e), e / sqrt(x))
            err = np.minimum(np.sqrt(slack), slack / np.maximum(d, 1e-9))
            lo, hi = d - f.radius[None, a:z] - err, d + f.radius[None, a:z] + err
            mine = (own >= start + a) & (own < start + z)
            hi[mine, own[mine] - start - a] = np.inf
            lo[mine, own[mine] - start - a] = np.inf
            limit = upper.max(axis=1)
            if np.isinf(limit).any():  # no bound yet: the block's own smallest upper bounds
                part = np.partition(hi, k - 1, axis=1)[:, :k] if hi.shape[1] > k else hi
                upper = np.partition(np.concatenate([upper, part], axis=1), k - 1, axis=1)[:, :k]
                limit = upper.max(axis=1)
                r, j = np.nonzero((lo <= limit[:, None]) & np.isfinite(lo))
            else:  # only vectors that may come in can lower a bound
                r, j = np.nonzero((lo <= limit[:, None]) & np.isfinite(lo))
                if len(r):
                    first = np.searchsorted(r, np.arange(len(q) + 1))
                    few = np.full((len(q), int(np.diff(first).max())), np.inf)
                    few[r, np.arange(len(r)) - first[r]] = hi[r, j]
                    upper = np.partition(np.concatenate([upper, few], axis=1), k - 1, axis=1)[:, :k]
                    limit = upper.max(axis=1)
                    some = lo[r, j] <= limit[r]
                    r, j = r[some], j[some]
            rows.append(r)
            at.append(j + start + a)
            lows.append(lo[r, j])
        start += len(f.ids)
    rows, at, lows = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (rows, at, lows))
    limit = upper.max(axis=1)
    ok = lows <= limit[rows]
    rows, at, lows = rows[ok], at[ok], lows[ok]
    order = np.lexsort((lows, rows))
    rows, at, lows = rows[order], at[order], lows[order]
    first = np.searchsorted(rows, np.arange(len(q) + 1))
    begins = np.cumsum([0] + [len(f.ids) for f in files])
    out = []
    for i in range(len(q)):
        ids, dist, p, end = np.zeros(0, dtype=np.int64), np.zeros(0), int(first[i]), int(first[i + 1])
        step, ratio = k + 6, scale.exact / scale.unit  # from the scan's distances to exact ones
        while p < end and not (len(dist) >= k and lows[p] * ratio > dist[k - 1]):
            pos = at[p : min(p + step, end)]
            p += step
            which = np.searchsorted(begins, pos, side="right") - 1
            x, new = np.empty((len(pos), dims)), np.empty(len(pos), dtype=np.int64)
            for w in np.unique(which):
                m = which == w
                x[m], new[m] = files[w].exact[pos[m] - begins[w]], files[w].ids[pos[m] - begins[w]]
            d = np.sqrt(((x * scale.exact - q[i] * scale.exact) ** 2).sum(axis=1))
            ids, dist = np.concatenate([ids, new]), np.concatenate([dist, d])
            best = np.lexsort((ids, dist))[:k]
            ids, dist = ids[best], dist[best]
        out.append((ids, dist / scale.exact))
    return out


def _rounded(d: np.ndarray) -> np.ndarray:
    """Six decimals; a double beyond 1e9 has none to round to 1e-6."""
    return np.where(d < 1e9, np.round(np.minimum(d, 1e9), 6), d)


def top_k(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", k: int = K, cells: int = CELLS, asked: Column | None = None) -> DataFrame:
    """For every query its k nearest other rows by Euclidean distance: id, rank from 1, neighbour, distance. All rows are
    searched; queries are those for which ``asked`` is true, by default all."""
    spark = vectors.sparkSession
    v, dims = _clean(vectors, id_, vector, asked)
    schema = f"{id_} bigint, rank int, neighbour bigint, distance double"
    if not dims:
        return spark.createDataFrame([], schema)
    v = common.written(v, "vectors")
    bounds, low, high = _cell_bounds(v, dims, cells)
    scale = Scale.of(float(max(np.abs(low).max(), np.abs(high).max())))
    centres = _centres(bounds, low, high, scale.unit)
    folder = common.local_path(common.shared_path(spark, "cells"))
    os.makedirs(folder, exist_ok=True)
    names = [n for n in write_files(v, dims, bounds, centres, scale, folder) if n[1]]
    begins = np.cumsum([0] + [t for _, t, _ in names])
    work = [(n, int(a), int(min(a + QUERIES, m)), int(s)) for (n, _, m), s in zip(names, begins) for a in range(0, m, QUERIES)]
    slices = max(1, min(len(work), 4 * spark.sparkContext.defaultParallelism))
    tasks = spark.createDataFrame(work, "name string, a bigint, z bigint, start bigint").repartition(slices)

    def run(batches):
        files = [_open(folder, n, t, m, dims) for n, t, m in names]
        where = {n: i for i, (n, _, _) in enumerate(names)}
        for b in batches:
            for name, a, z, start in zip(*(b.column(c).to_pylist() for c in ("name", "a", "z", "start"))):
                f = files[where[name]]
                at = np.asarray(f.asks[a:z])
                found = search(files, centres, scale, np.asarray(f.exact[at]), start + at, k)
                size = [len(i) for i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(f.ids[at], size)),
                        pa.array(np.concatenate([np.arange(1, n + 1) for n in size]).astype(np.int32)),
                        pa.array(np.concatenate([i for i, _ in found])),
                        pa.array(_rounded(np.concatenate([d for _, d in found]))),
                    ],
                    [id_, "rank", "neighbour", "distance"],
                )

    return tasks.mapInArrow(run, schema)
