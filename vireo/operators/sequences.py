"""Order-sensitive operators as windows: carry forward, islands, offsets, collapse, interval merge, first-seen groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vireo.session import written


def _window(keys: list[str], order: list):
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return w.orderBy(*order)


def _ranged(df: DataFrame, order: list, slices: int = 0) -> DataFrame:
    """The frame in a total order without one big window: range-partitioned, sorted, with each row's partition ``_part`` and
    its place in it, ``_place``. It is written, so that all readers see the same partitions."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    return written(ranged.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranged")


def _earlier(each: DataFrame, fold: Column) -> DataFrame:
    """(_part, _before) of (_part, _v): the fold of all earlier partitions. One row per partition, hence window and broadcast."""
    before = fold.over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(each.select("_part", before.alias("_before")))


def number_rows(df: DataFrame, order: list, start: int = 1, keys: list[str] | None = None, name: str = "n") -> DataFrame:
    """Rows numbered from ``start`` within their keys."""
    if not keys:
        return dense_ids(df, order, name).withColumn(name, F.col(name) + start)
    return df.withColumn(name, F.row_number().over(_window(keys, order)) + (start - 1))


def dense_ids(df: DataFrame, order: list, name: str = "id", slices: int = 0) -> DataFrame:
    """Numbers 0, 1, ... in a total order: each row gets the rows of the partitions before plus its place in its own."""
    ranged = _ranged(df, order, slices)
    offsets = _earlier(ranged.groupBy("_part").agg(F.count("*").alias("_v")), F.sum("_v"))
    return ranged.join(offsets, "_part", "left").withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_place")).drop("_part", "_place", "_before")


def carry_forward(df: DataFrame, value: Column, order: list, keys: list[str], name: str) -> DataFrame:
    """The last value that is not null, up to and with this row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def islands(df: DataFrame, marker: Column, order: list, keys: list[str], name: str = "island") -> DataFrame:
    """A group number that rises at every marker row; rows before the first marker are island 0."""
    return df.withColumn(name, F.sum(marker.cast("int")).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def prefix_offsets(df: DataFrame, size: Column, order: list, keys: list[str] | None = None, name: str = "at") -> DataFrame:
    """The sum of all sizes before a row."""
    if not keys:
        return _offsets(df, size, order, name, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _offsets(df: DataFrame, size: Column, order: list, name: str, end: int) -> DataFrame:
    """Running sums over the whole frame: each partition's own, and the sums of those before."""
    ranged = _ranged(df.withColumn("_size", size), order)
    earlier = _earlier(ranged.groupBy("_part").agg(F.sum("_size").alias("_v")), F.sum("_v"))
    own = F.sum("_size").over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, end))
    total = F.coalesce(own, F.lit(0)) + F.coalesce("_before", F.lit(0))
    return ranged.join(earlier, "_part", "left").withColumn(name, total).drop("_part", "_place", "_before", "_size")


def inclusive_offsets(df: DataFrame, size: Column, order: list, keys: list[str] | None = None, name: str = "end") -> DataFrame:
    if not keys:
        return _offsets(df, size, order, name, 0)
    return df.withColumn(name, F.sum(size).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def collapse(df: DataFrame, key: str, order: list, keys: list[str]) -> DataFrame:
    """Of consecutive rows with equal keys the last."""
    after = F.lead(F.struct(key)).over(_window(keys, order))
    return df.withColumn("_next", after).where(F.col("_next").isNull() | ~F.struct(key).eqNullSafe(F.col("_next"))).drop("_next")


def merge_intervals(df: DataFrame, lo: str, hi: str, keys: list[str]) -> DataFrame:
    """Overlapping intervals (bounds included) as one; neighbours that only adjoin stay apart."""
    w = _window(keys, [lo, hi])
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col(lo) > reach)).cast("int")
    island = F.sum(F.col("_new")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_new", new).withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def range_semi_join(df: DataFrame, point: str, ranges: DataFrame, lo: str, hi: str, keys: list[str]) -> DataFrame:
    """Rows whose point lies in some range of their keys: an equi-join on the keys with a range condition."""
    r = merge_intervals(ranges, lo, hi, keys)
    on = [df[k] == r[k] for k in keys] + [df[point] >= r[lo], df[point] <= r[hi]]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return df.join(r, condition, "left_semi")


def point_in_ranges(df: DataFrame, point: str, ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """The same without keys: a point is inside if, of all ranges that begin at or before it, the furthest end reaches it.
    Distinct points and beginnings are range-partitioned together; a running maximum within each partition and the maximum
    of those before decide. Rows then meet their points by an equi-join, however many share one."""
    points = df.select(F.col(point).alias("_x")).where("_x is not null").distinct()
    ends = ranges.where(F.col(lo).isNotNull()).groupBy(F.col(lo).alias("_x")).agg(F.max(hi).alias("_hi"))
    both = points.withColumns({"_hi": F.lit(None).cast(ends.schema["_hi"].dataType), "_point": F.lit(True)}).unionByName(ends.withColumn("_point", F.lit(False)))
    ranged = _ranged(both, ["_x", "_point"])
    earlier = _earlier(ranged.groupBy("_part").agg(F.max("_hi").alias("_v")), F.max("_v"))
    reach = F.max("_hi").over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    inside = ranged.withColumn("_reach", reach).join(earlier, "_part", "left").where(F.col("_point") & (F.greatest("_reach", "_before") >= F.col("_x")))
    return df.join(inside.select(F.col("_x").alias(point)), point, "left_semi")


def first_occurrence(df: DataFrame, key: list[str], order: str, carry: list[str] | None = None) -> DataFrame:
    """Each key once, with the order of its first row and that row's other columns."""
    carry = carry or []
    first = F.min_by(F.struct(*carry), order).alias("_first") if carry else F.lit(None).alias("_first")
    out = df.groupBy(*key).agg(F.min(order).alias(order), first)
    return out.select(*key, order, *[F.col(f"_first.{c}").alias(c) for c in carry])


def dedupe_take(df: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """Groups in first-seen order, until the nth distinct key appears: earlier groups hold the rows up to there, the nth
    holds one. Gives key, group_ord from 1, and the ``rows`` (their orders)."""
    first = df.groupBy(*key).agg(F.min(order).alias("_first"))
    heads = first.orderBy("_first").limit(n)
    heads = heads.withColumn("group_ord", F.row_number().over(Window.orderBy("_first")))  # n rows
    cut = heads.agg(F.when(F.count("*") == n, F.max("_first")).alias("_cut"))
    rows = df.join(F.broadcast(heads), key).crossJoin(F.broadcast(cut))
    rows = rows.where(F.col("_cut").isNull() | (F.col(order) <= F.col("_cut")))
    return rows.groupBy(*key, "group_ord").agg(F.array_sort(F.collect_list(order)).alias("rows"))


def provenance(rows: DataFrame, group: str, package: str, module: str, rank: str) -> DataFrame:
    """In each group, packages in first-seen order with their modules in first-seen order."""
    modules = rows.groupBy(group, package, module).agg(F.min(rank).alias("r"))
    packages = modules.groupBy(group, package).agg(F.min("r").alias("r"), F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(module).alias("m")))), lambda x: x["m"]).alias("modules"))
    pairs = F.array_sort(F.collect_list(F.struct("r", F.col(package).alias("package"), "modules")))
    return packages.groupBy(group).agg(F.transform(pairs, lambda x: F.struct(x["package"].alias("package"), x["modules"].alias("modules"))).alias("packages"))


def top_k(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_k_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(_window(keys, order))).where(F.col("_rank") <= n).drop("_rank")


def first_by(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def last_by(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def share_of_total(df: DataFrame, label: str, value: str) -> DataFrame:
    """Sum and share per label, largest first, after a first row for all."""
    each = df.groupBy(F.col(label).alias("label")).agg(F.sum(value).alias("total"))
    whole = df.agg(F.lit("Total").alias("label"), F.sum(value).alias("total"))
    out = whole.withColumn("block", F.lit(0)).unionByName(each.withColumn("block", F.lit(1)))
    return out.crossJoin(F.broadcast(whole.select(F.col("total").alias("_all")))).select("label", "total", (F.col("total") / F.col("_all")).alias("share"), "block").orderBy("block", F.desc("total"), "label").drop("block")
