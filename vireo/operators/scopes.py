"""Scope filters. Items carry their package, module and category values; scopes become one Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vireo.functions.querylang import Query, Scope, parse_tag
from vireo.operators import sequences


def module_matches(module: Column, value: str) -> Column:
    """``.x.`` the whole name; ``.x`` its start; else its start or after a dot; all in lower case."""
    v, m = value.lower(), F.lower(module)
    if len(v) > 1 and v.startswith(".") and v.endswith("."):
        return m == v[1:-1]
    if v.startswith("."):
        return F.startswith(m, F.lit(v[1:]))
    return F.startswith(m, F.lit(v)) | F.contains(m, F.lit("." + v))


def resolve_package(packages: DataFrame, value: str, name: str = "name", order: str = "ord") -> DataFrame:
    """The one package that has the value as a prefix: the shortest, of equally short ones the most popular."""
    return packages.where(F.startswith(F.col(name), F.lit(value))).orderBy(F.octet_length(name), order).limit(1)


def resolve(packages: DataFrame, scopes: list[Scope], name: str = "name", order: str = "ord") -> tuple[list[tuple[Scope, Scope | None]], list[str]]:
    """Each scope with its canonical form (None where it can't be read), and the texts of the ignored ones. Package
    prefixes become the package they resolve to."""
    out, ignored = [], []
    for s in scopes:
        tag = parse_tag(s.category, s.value)
        if not tag:
            ignored.append(f"{'' if s.include else '-'}{s.category}:{s.value}")
            out.append((s, None))
            continue
        value = tag[1]
        if tag[0] == "package":
            row = resolve_package(packages, value, name, order).first()
            value = row[name] if row else "\0" + value  # names hold no NUL: nothing matches
        out.append((s, Scope(s.include, tag[0], value)))
    return out, ignored


def condition(scope: Scope, package: str = "package", module: str = "module", kind: str = "kind", categories: str = "categories") -> Column | None:
    """Whether an item lies in a canonical scope; None where the scope restricts nothing."""
    if scope.category == "is":
        return None if scope.value == "exact" else F.coalesce(F.col(kind) == scope.value, F.lit(False))
    if scope.category == "package":
        return F.coalesce(F.col(package) == scope.value, F.lit(False))
    if scope.category == "module":
        return F.coalesce(module_matches(F.col(module), scope.value), F.lit(False))
    return F.coalesce(F.array_contains(categories, f"{scope.category}:{scope.value}"), F.lit(False))


def combined(resolved: list[tuple[Scope, Scope | None]], **columns: str) -> Column:
    """Scopes are grouped by their category as written. In a group, an item must lie in a positive scope, if there is a
    restricting one, and in no negative one; all groups must agree."""
    groups: dict[str, tuple[list[Column], list[Column]]] = {}
    for raw, tag in resolved:
        pos, neg = groups.setdefault(raw.category, ([], []))
        c = condition(tag, **columns) if tag else None
        if c is not None:
            (pos if raw.include else neg).append(c)
    parts = []
    for pos, neg in groups.values():
        if pos:
            parts.append(reduce(Column.__or__, pos))
        parts += [~c for c in neg]
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def is_exact(scopes: list[Scope]) -> bool:
    return any(s.include and parse_tag(s.category, s.value) == ("is", "exact") for s in scopes)


def listing(containers: DataFrame, resolved: list[tuple[Scope, Scope | None]], **columns: str) -> DataFrame:
    """Without name and type: the containers (packages and modules, one row each in popularity order) that every positive
    scope lists; without positive scopes all packages. Scopes that list nothing give nothing."""
    positive = [tag for raw, tag in resolved if raw.include]
    kind = F.col(columns.get("kind", "kind"))
    if not positive:
        return containers.where(kind == "package")
    conditions = []
    for tag in positive:
        c = condition(tag, **columns) if tag else None
        if c is None:
            return containers.limit(0)
        # a package or category lists packages, a module scope modules
        own = {"module": "module", "is": tag.value}.get(tag.category, "package")
        conditions.append(c & (kind == own))
    return containers.where(reduce(Column.__and__, conditions))


def facets(hits: DataFrame, selected: list[Scope], package: str = "package", kind: str = "kind", rank: str = "rank") -> DataFrame:
    """(ord, category, value) to narrow a result by: exactness, kinds that occur, packages in first-seen order; without
    those selected already."""
    packages = hits.where(F.col(package).isNotNull()).groupBy(F.col(package).alias("value")).agg(F.min(rank).alias("ord"))
    kinds = hits.where(F.col(kind).isin("package", "module")).select(F.col(kind).alias("value")).distinct()
    spark = hits.sparkSession
    exact = spark.createDataFrame([(-3, "is", "exact")], "ord bigint, category string, value string")
    kinds = kinds.select(F.when(F.col("value") == "package", -2).otherwise(-1).cast("bigint").alias("ord"), F.lit("is").alias("category"), "value")
    packages = packages.select(F.col("ord").cast("bigint"), F.lit("package").alias("category"), "value")
    out = exact.unionByName(kinds).unionByName(packages)
    for s in selected:
        out = out.where(~((F.col("category") == s.category) & (F.col("value") == s.value)))
    return out.orderBy("ord")


def category_weight(category: Column, value: Column) -> Column:
    """Sets first, the two well-known ones ahead; then package, category, license, the rest."""
    return (
        F.when(category == "set", F.when(value == "stackage", 0.0).when(value == "haskell-platform", 0.1).otherwise(0.9))
        .when(category == "package", 1.0)
        .when(category == "category", 2.0)
        .when(category == "license", 3.0)
        .otherwise(4.0)
    )


def container_ranges(items: DataFrame, container: list[str], id_: str = "item_id") -> DataFrame:
    """(lo, hi) of the ids of every container occurrence; containers without ids or name are left out."""
    named = items.where(F.col(id_).isNotNull() & (F.coalesce(F.col(container[-1]), F.lit("")) != ""))
    return named.groupBy(*container).agg(F.min(id_).alias("lo"), F.max(id_).alias("hi"))


def category_ranges(ranges: DataFrame, tags: DataFrame) -> DataFrame:
    """Category values with the ranges of their packages, in package order; ``ranges`` has (package, ord, lo, hi)."""
    rows = ranges.join(tags, "package")
    pairs = F.array_sort(F.collect_list(F.struct("ord", "lo", "hi")))
    return rows.groupBy("category", "value").agg(F.transform(pairs, lambda p: F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"))).alias("ranges"))


def completions(packages: DataFrame, tags: DataFrame) -> DataFrame:
    """(ord, text): set tags of all packages, then kept package names without regard to case, then the other tags of kept
    packages. ``packages`` has (package, keep), ``tags`` (package, category, value)."""
    w = category_weight(F.col("category"), F.col("value"))
    row = lambda block, weight, a, b, text: (F.lit(block).alias("block"), weight.alias("w"), a.alias("a"), b.alias("b"), text.alias("text"))
    pair = F.concat_ws(":", "category", "value")
    none = F.lit(0.0)
    sets = tags.where("category = 'set'").select(*row(0, w, F.lower("category"), F.lower("value"), pair)).distinct()
    names = packages.where("keep").select(*row(1, none, F.lower("package"), F.col("package"), F.concat(F.lit("package:"), F.col("package")))).distinct()
    other = tags.where("category <> 'set'").join(packages.where("keep").select("package").distinct(), "package", "left_semi")
    other = other.select(*row(2, w, F.lower("category"), F.lower("value"), pair)).distinct()
    out = sets.unionByName(names).unionByName(other)
    return sequences.number_rows(out, ["block", "w", "a", "b", "text"], 1, name="ord").select(F.col("ord").cast("int").alias("ord"), "text")


def apply(items: DataFrame, packages: DataFrame, q: Query, name: str = "name", order: str = "ord", **columns: str) -> tuple[DataFrame, Query]:
    """Items filtered by the query's scopes, and the query with canonical scopes."""
    resolved, ignored = resolve(packages, q.scopes, name, order)
    refined = Query(q.names, q.type, [Scope(t.include, t.category, t.value.lstrip("\0")) for _, t in resolved if t], ignored)
    return items.where(combined(resolved, **columns)), refined
