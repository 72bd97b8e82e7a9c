"""Sharding by histogram sort.

Splitters are found by probing: every round counts, over all partitions, the exact bytes of rows below each candidate
key, and narrows each splitter's interval, until the bytes below it are within ``tolerance`` (a share of a shard) of its
target or no other key is left between. Only (key, bytes) is read in those rounds. Then the rows move once, each shard
into its own partition, sorted by key.

Splitter k is the smallest key that at least k/n of all bytes lie below; with a tolerance, any key near enough. Rows
with equal keys share a shard, however many there are. Defined results: null keys sort first; a null text has 0 bytes;
without bytes everything is in shard 0; an existing column ``shard_id`` is replaced, all others stay; a key that is not an
integer column, or is named ``shard_id``, is an error before anything runs; texts of any length count whole; an empty table
gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm import common

#: Shards at least; beyond this many bytes in each there are more.
SHARDS, SHARD_BYTES, PROBES = 64, 1 << 28, 15
#: The query asks for exact splitters: its result then depends on the rows alone.
TOLERANCE = 0.0


def bytes_below(keys: DataFrame, probes: list[int]) -> list[int]:
    """For each of the sorted probes, the bytes of all rows whose key is less (null keys are less than any)."""
    at = np.array(probes, dtype=np.int64)

    def run(batches):
        total = np.zeros(len(at) + 1, dtype=np.int64)
        for b in batches:
            key, size = b.column("key"), b.column("bytes").to_numpy(zero_copy_only=False)
            slot = np.where(np.asarray(key.is_null()), 0, np.searchsorted(at, key.fill_null(0).to_numpy(zero_copy_only=False), side="right"))
            order = np.argsort(slot, kind="stable")
            slot, size = slot[order], size[order]
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else []
            if len(slot):
                total[slot[first]] += np.add.reduceat(size, first)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "bytes"])

    found = keys.mapInArrow(run, "slot bigint, bytes bigint").groupBy("slot").agg(F.sum("bytes").alias("bytes"))
    count = [0] * (len(probes) + 1)
    for slot, size in found.collect():
        count[slot] = size
    return [sum_ for sum_ in np.cumsum(np.array(count, dtype=object))[:-1]]


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[int]:
    """shards - 1 keys, rising; a row belongs to the shard with as many splitters at or below its key."""
    low, high, total = keys.agg(F.min("key"), F.max("key"), F.sum("bytes")).first()
    if low is None or not total:
        return []
    slack = tolerance * total / shards
    # bytes below `lo` are under the target, bytes below `hi` are not
    state = {k: (low, high + 1) for k in range(1, shards)}
    done: dict[int, int] = {}
    null_bytes = total - (keys.where("key is not null").agg(F.sum("bytes")).first()[0] or 0)
    for k in list(state):
        if null_bytes * shards >= k * total:
            done[k] = low
            del state[k]
    while state:
        wanted = set()
        for lo, hi in set(state.values()):
            wanted |= {lo + (hi - lo) * i // (probes + 1) for i in range(1, probes + 1)}
        at = sorted(wanted)
        below = dict(zip(at, bytes_below(keys, at)))
        for k, (lo, hi) in list(state.items()):
            inside = [p for p in at if lo < p < hi]
            near = [p for p in inside if abs(below[p] * shards - k * total) <= slack * shards]
            if slack and near:
                done[k] = min(near, key=lambda p: (abs(below[p] * shards - k * total), p))
                del state[k]
                continue
            under = [p for p in inside if below[p] * shards < k * total]
            over = [p for p in inside if below[p] * shards >= k * total]
            lo, hi = max(under, default=lo), min(over, default=hi)
            state[k] = (lo, hi)
            if hi - lo <= 1:
                done[k] = hi
                del state[k]
    return np.maximum.accumulate(np.array([done[k] for k in range(1, shards)], dtype=object)).tolist() if done else []


def sharded(docs: DataFrame, key: str = "doc_id", shards: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """All rows with their shard_id, shard k in partition k, sorted by key. The number of shards follows from the bytes of all
    texts unless it is given."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint") or key.lower() == "shard_id":
        raise ValueError(f"the key of sharding must be an integer column of another name than shard_id, not {key} {kind}")
    keys = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"))
    keys = common.written(keys, "keys")
    if shards is None:
        shards = max(SHARDS, -(-(keys.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))
    cut = spark.sparkContext.broadcast(np.array([min(x, (1 << 63) - 1) for x in splitters(keys, shards, tolerance)], dtype=np.int64))

    @F.pandas_udf("int")
    def shard_of(k: pd.Series) -> pd.Series:
        some = k.fillna(0).astype("int64").to_numpy()
        return pd.Series(np.where(k.isna(), 0, np.searchsorted(cut.value, some, side="right")), dtype="int32")

    # nulls are kept apart from the rest, so that pandas does not turn long keys into floats
    placed = docs.withColumn("shard_id", F.when(F.col(key).isNull(), 0).otherwise(shard_of(F.coalesce(F.col(key).cast("bigint"), F.lit(0)))).cast("int"))
    return placed.repartitionById(shards, "shard_id").sortWithinPartitions("shard_id", key)
