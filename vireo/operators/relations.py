"""Joins, set operations, popularity and orders of packages, modules and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vireo.functions.scalars import wildcard_pattern

#: Small reference tables are broadcast up to this many rows; larger ones join by shuffle.
BROADCAST_ROWS = 1_000_000
#: Edges whose distinct ones one task finds, about.
EDGES = 250_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it is small; only a number goes to the driver."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def distinct_edges(depends: DataFrame) -> DataFrame:
    """(package, dependency), each pair once. Pairs are spread over as many tasks as their number asks for and are not gathered before,
    so a task's memory does not grow with the input."""
    tasks = max(1, -(-depends.count() // EDGES))
    return depends.select("package", "dependency").repartition(tasks, "package", "dependency").distinct()


# joins


def materialise(hits: DataFrame, items: DataFrame, rank: str = "rank") -> DataFrame:
    """Hits (ids with a rank, already limited) with their items, in rank order: the hits are the broadcast side while they are few."""
    return items.join(small(hits), "item_id").orderBy(rank)


def name_and_type(by_type: DataFrame, by_name: DataFrame, id_: str = "item_id") -> DataFrame:
    """Type hits that are name hits too; rank and order are the type search's."""
    return by_type.join(by_name.select(id_).distinct(), id_, "left_semi")


def expand_targets(hits: DataFrame, targets: DataFrame, rank: str = "rank") -> DataFrame:
    """Signature hits to the items that have them, in (rank, position) order."""
    out = hits.join(targets, "sig_ord")
    return out.withColumn("hit_ord", F.row_number().over(Window.orderBy(rank, "pos")))  # hits are limited


def membership_tags(packages: DataFrame, sets: dict[str, DataFrame], name: str = "package") -> DataFrame:
    """Packages with ``tags``: a set tag for every set that holds them, in the order of the sets."""
    flags = []
    for label, members in sets.items():
        packages = packages.join(small(members.select(name).distinct().withColumn(f"_{label}", F.lit(f"set:{label}"))), name, "left")
        flags.append(f"_{label}")
    tags = F.array_compact(F.array(*[F.col(f) for f in flags])) if flags else F.array().cast("array<string>")
    return packages.withColumn("tags", tags).drop(*flags)


def missing(wanted: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(seen.select(key), key, "left_anti")


def missing_dependencies(depends: DataFrame, packages: DataFrame) -> DataFrame:
    """(dependency, first_user, others, message) of dependencies (package, dependency) on unknown packages. Of the users
    the last in name order is named, as a fold that prepends leaves it first."""
    bad = distinct_edges(depends).join(packages.select(F.col("package").alias("dependency")), "dependency", "left_anti")
    users = bad.groupBy("dependency").agg(F.max("package").alias("first_user"), (F.count("*") - 1).alias("others"))
    more = F.when(F.col("others") > 0, F.concat(F.lit("; so do "), F.col("others").cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return users.withColumn("message", F.concat("first_user", F.lit(" depends on unknown package "), "dependency", more))


def module_priority(modules: DataFrame, settings: DataFrame) -> DataFrame:
    """(package, module, priority): the last setting (package_pattern, module_pattern, priority, ord) whose wildcards match
    both, else 0. Settings are lines of a file that people write; they are broadcast while they are few."""
    on = F.like("package", wildcard_pattern(F.col("package_pattern"))) & F.like("module", wildcard_pattern(F.col("module_pattern")))
    hits = modules.join(small(settings), on).groupBy("package", "module").agg(F.max_by("priority", "ord").alias("priority"))
    return modules.join(hits, ["package", "module"], "left").withColumn("priority", F.coalesce("priority", F.lit(0)))


def rename_tags(tags: DataFrame, renames: DataFrame, column: str = "value") -> DataFrame:
    """Values replaced by the last rename of (old, new, ord); renamed to nothing they go."""
    last = renames.groupBy(F.col("old").alias(column)).agg(F.max_by("new", "ord").alias("_new"))
    return tags.join(small(last), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").where(F.col(column) != "").select(*tags.columns)


def left_biased_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of the first, and of the second those with other keys."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(*first.columns))


def wanted_only(df: DataFrame, wanted: DataFrame, key: str = "package") -> DataFrame:
    return df.join(small(wanted.select(key).distinct()), key, "left_semi")


# sets


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti").distinct()


def ordered_union(blocks: list[DataFrame], order: str = "ord") -> DataFrame:
    """All rows, block after block, with (block, order) to sort by."""
    out = None
    for i, b in enumerate(blocks):
        b = b.withColumn("block", F.lit(i))
        out = b if out is None else out.unionByName(b)
    return out


def intersection_in_order(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first whose key all others hold; the first's order columns stay."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.select(key).distinct(), key, "left_semi")
    return out


def with_placeholders(items: DataFrame, packages: DataFrame) -> DataFrame:
    """Items and, for library packages without any, a placeholder item that has the synopsis as docs."""
    gone = packages.where("is_library").join(items.select("package").distinct(), "package", "left_anti")
    made = gone.select("package", F.lit("package").alias("kind"), F.col("package").alias("name"), F.col("synopsis").alias("docs"))
    have = items.select("package", "kind", "name", "docs", F.lit(False).alias("placeholder"))
    return have.unionByName(made.withColumn("placeholder", F.lit(True)))


# popularity


def popularity(depends: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, users): how many packages depend directly on each known package."""
    known = packages.select(F.col("package").alias("dependency"))
    users = distinct_edges(depends).groupBy("dependency").agg(F.count("package").alias("users"))  # counts are fewer than edges, so they are joined
    return users.join(known, "dependency", "left_semi").select(F.col("dependency").alias("package"), "users")


def package_rank(packages: DataFrame, users: DataFrame, canonical: str | None = None, copies: tuple[str, ...] = ()) -> DataFrame:
    """(package, pop): minus its users, 1 if unknown; the canonical package just before the first of its copies."""
    ranked = packages.select("package").distinct().join(users, "package", "left").select("package", F.coalesce(-F.col("users"), F.lit(1)).cast("bigint").alias("pop"))
    if not canonical:
        return ranked
    best = users.where(F.col("package").isin(*copies)).agg(F.min(-F.col("users")).alias("_copies"))
    floor = F.least("pop", F.coalesce(F.col("_copies"), F.lit(1)) - 1)
    return ranked.crossJoin(F.broadcast(best)).select("package", F.when(F.col("package") == canonical, floor).otherwise(F.col("pop")).alias("pop"))


def popularity_order(items: DataFrame, ranks: DataFrame, priorities: DataFrame) -> DataFrame:
    """Items with what they sort by: packages by (pop, name); modules by (-priority, name), where the package's own
    header has an empty module name; in a module the header first, then names, null first, in original order.

    ``items`` has package, module, is_header, name, ord."""
    rows = items.withColumn("module", F.coalesce("module", F.lit(""))).join(ranks, "package", "left")
    rows = rows.join(priorities.select("package", "module", "priority"), ["package", "module"], "left")
    return rows.withColumns({"pop": F.coalesce("pop", F.lit(1)), "mod_rank": -F.coalesce("priority", F.lit(0)), "after_header": F.when(F.col("is_header"), 0).otherwise(1)}).drop("priority")


def popularity_keys() -> list[Column]:
    return [F.col("pop"), F.col("package"), F.col("mod_rank"), F.col("module"), F.col("after_header"), F.col("name").asc_nulls_first(), F.col("ord")]


def merge_packages(rows: DataFrame) -> DataFrame:
    """Rows of one package as one, in ``ord``: tags appended, library if any is, first texts that are not empty, distinct
    dependencies, first docs."""
    first = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("ord"))), F.lit("")).alias(c)
    lists = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("x")))), lambda p: p["x"]))
    return rows.groupBy("package").agg(
        lists("tags").alias("tags"), F.bool_or("is_library").alias("is_library"), first("synopsis"), first("version"), F.array_distinct(lists("depends")).alias("depends"), F.min_by("docs_dir", F.when(F.col("docs_dir").isNotNull(), F.col("ord"))).alias("docs_dir")
    )


def latest_version(rows: DataFrame, package: str = "package", version: str = "version") -> DataFrame:
    """Per package the row of the greatest version, compared number by number."""
    parts = F.split(version, r"\.").try_cast("array<int>")
    return rows.groupBy(package).agg(F.max_by(F.struct(*[c for c in rows.columns if c != package]), F.struct(parts, F.col(version))).alias("r")).select(package, "r.*")


# paging


def page(df: DataFrame, order: list, start: int = 1, count: int = 100, cap: int = 500) -> DataFrame:
    """Rows from the start-th (1 or more) on, at most ``count`` and never over ``cap``."""
    return df.orderBy(*order).offset(max(1, start) - 1).limit(min(max(0, count), cap))


def first_packages(packages: DataFrame, n: int) -> DataFrame:
    return packages.orderBy("package").limit(n)
