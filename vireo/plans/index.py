"""Build an index of declarations as Parquet tables, open it, and search it.

Tables: ``items`` (one row per documented thing), ``names`` (searchable names in popularity order, with what scopes look
at, so that a scope filter needs no join), ``sigs`` (distinct signatures, encoded, with fingerprints), ``sig_targets``
(the items of each signature), ``ctor_names`` (the dictionary), ``containers`` (packages and modules with the range of
their item ids), ``categories`` (category values with the ranges of their packages), ``completions`` and ``warnings``.
``manifest.json`` holds the format's version, every table's schema, the number of warnings and the seconds of each phase.
It is written last: a folder without one is no index, and a failed build removes what it wrote.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vireo.functions import scalars as X
from vireo.functions.querylang import Query, parse_query
from vireo.functions.signatures import Sig, parse_type, preorder, to_signature
from vireo.operators import names, relations, scopes, sequences, typesearch
from vireo.session import written
from vireo.sources import files as sources

VERSION = 2
TABLES = ("items", "names", "sigs", "sig_targets", "ctor_names", "containers", "categories", "completions", "warnings")
METADATA = "package string, version string, synopsis string, is_library boolean, depends array<string>, tags array<struct<category:string,value:string>>, docs_dir string, ok boolean"


class IndexError_(ValueError):
    """A folder that holds no index, one of another version, or a damaged one."""


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _order(rows: DataFrame, metadata: DataFrame, settings: DataFrame, canonical: str | None, copies: tuple[str, ...]) -> DataFrame:
    """Parts with ``popularity_ord``."""
    packages = metadata.select("package").unionByName(rows.select("package").where("package is not null")).distinct()
    depends = metadata.select("package", F.explode("depends").alias("dependency"))
    ranks = relations.package_rank(packages, relations.popularity(depends, metadata), canonical, copies)
    modules = rows.select("package", F.coalesce("module", F.lit("")).alias("module")).distinct()
    keyed = relations.popularity_order(rows, ranks, relations.module_priority(modules, settings))
    keyed = keyed.withColumn("sort_name", F.coalesce(F.concat(F.lit(" "), "name"), F.lit("")))  # null names first
    return sequences.dense_ids(keyed, ["pop", "package", "mod_rank", "module", "after_header", "sort_name", "ord", "part_no"], "popularity_ord")


def build(
    spark: SparkSession,
    files: DataFrame,
    path: str,
    metadata: DataFrame | None = None,
    sets: dict[str, DataFrame] | None = None,
    wanted: DataFrame | None = None,
    settings: str = "",
    canonical: str | None = None,
    copies: tuple[str, ...] = (),
) -> Index:
    """Parse declaration files (path, body, and base where urls do not start at the package's page) and write the index to
    ``path``.

    ``metadata`` describes packages (see sources.parse_metadata), ``sets`` are package sets by label, ``wanted`` the
    packages to keep (all if None), ``settings`` renames of tags and module priorities."""
    for t in ("manifest.json", *TABLES):
        p, fs = _path(spark, f"{path}/{t}")
        if fs.exists(p):
            raise IndexError_(f"{path} holds {t} already: build into a new folder")
    try:
        return _build(spark, files, path, metadata, sets, wanted, settings, canonical, copies)
    except BaseException:
        for t in TABLES:
            p, fs = _path(spark, f"{path}/{t}")
            fs.delete(p, True)
        raise


def _build(spark, files, path, metadata, sets, wanted, settings, canonical, copies) -> Index:
    phases, began = {}, time.time()

    def phase(name: str) -> None:
        nonlocal began
        phases[name], began = round(time.time() - began, 3), time.time()

    metadata = metadata if metadata is not None else spark.createDataFrame([], METADATA)
    renames, priorities = sources.settings_frames(spark, settings)
    metadata = written(metadata, "metadata")
    entries = sources.parse_files(files)
    if "base" in files.columns:
        entries = entries.join(relations.small(files.select("path", "base").distinct()), "path", "left")
    entries = written(entries, "entries")  # parsed once
    phase("parse")
    parts = sources.hierarchy(entries)
    if wanted is not None:
        keep = wanted.select(F.col("package").alias("_wanted")).distinct()
        parts = parts.join(keep, parts["package.name"] == keep["_wanted"], "left_semi")
        metadata = metadata.join(keep, metadata["package"] == keep["_wanted"], "left_semi")
    parts = written(parts, "parts")

    tags = metadata.select("package", F.explode("tags").alias("t")).select("package", "t.category", "t.value")
    authors = relations.rename_tags(tags.where("category = 'author'"), renames).where("value <> ''")
    tags = tags.where("category <> 'author'").unionByName(authors.select("package", "category", "value"))
    for label, members in (sets or {}).items():
        tags = tags.unionByName(members.select("package", F.lit("set").alias("category"), F.lit(label).alias("value")).distinct())
    tags = written(tags.distinct(), "tags")
    categories = tags.groupBy("package").agg(F.array_sort(F.collect_set(F.concat_ws(":", "category", "value"))).alias("categories"))

    # a row per documented thing, and placeholders for libraries that document nothing
    key = ["path", "line_no", "entry_no"]
    seen = parts.where("entry = 'package'").select(F.col("name").alias("package")).distinct()
    gone = metadata.where("is_library").join(seen, "package", "left_anti")
    item = F.concat(F.lit("<b>package</b> <span class=name><s0>"), X.escape_html(F.col("package")), F.lit("</s0></span>"))
    made = gone.select(
        F.concat(F.lit("￿"), "package").alias("path"), F.lit(1).alias("line_no"), F.lit(0).alias("entry_no"), F.lit("package").alias("entry"), X.package_url(F.col("package")).alias("url"), F.lit(None).cast("struct<name:string,url:string>").alias("own_package"),
        F.lit(None).cast("struct<name:string,url:string>").alias("own_module"), item.alias("item"), F.coalesce("synopsis", F.lit("")).alias("docs"), F.col("package").alias("in_package"), F.lit(None).cast("string").alias("in_module"),
    )
    columns = made.columns
    firsts = parts.where("has_target and part_no = 0").withColumns({"in_package": F.col("package.name"), "in_module": F.when(F.col("entry") != "package", F.col("module.name"))})
    firsts = firsts.select(*columns).unionByName(made).withColumn("path_ord", sources.path_order(F.col("path")))
    items = sequences.dense_ids(firsts, ["path_ord", *key], "item_id")
    kind = F.when(F.col("entry").isin("package", "module"), F.col("entry")).otherwise(F.lit(""))
    base = F.coalesce(F.col("own_package.url"), F.lit(""))
    module_url = F.when(F.col("own_module").isNotNull(), X.expand_url(F.col("own_module.url"), F.lit(None).cast("string"), base))
    url = X.expand_url(F.col("url"), F.col("own_module.url"), base)
    items = items.select(*key, "item_id", kind.alias("kind"), url.alias("url"), F.col("own_package").alias("package"), F.when(F.col("own_module").isNotNull(), F.struct(F.col("own_module.name").alias("name"), module_url.alias("url"))).alias("module"), "item", "docs", "in_package", "in_module")
    items = written(items.join(categories.withColumnRenamed("package", "in_package"), "in_package", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>"))), "items")
    items.select("item_id", "kind", "url", "package", "module", "item", "docs", "in_package", "in_module", "categories").repartitionByRange("in_package", "item_id").sortWithinPartitions("in_package", "item_id").write.parquet(f"{path}/items")

    phase("items")
    ids = items.select("item_id", "kind", F.coalesce(F.col("in_package"), F.lit("")).alias("package"), F.col("in_module").alias("module"))
    packages = scopes.container_ranges(ids, ["package"])
    modules = scopes.container_ranges(ids, ["package", "module"])
    packages.select("package", F.lit(None).cast("string").alias("module"), "lo", "hi").unionByName(modules).orderBy("lo", F.col("module").asc_nulls_first()).write.parquet(f"{path}/containers")
    scopes.category_ranges(packages.withColumn("ord", F.col("lo")), tags).write.parquet(f"{path}/categories")

    # parts in popularity order
    own = parts.where("has_target").select(*key, "part_no", F.col("kind").alias("part_kind"), F.col("part_name").alias("name"), "ctx", "tree", "n_types")
    headers = gone.select(F.concat(F.lit("￿"), "package").alias("path"), F.lit(1).alias("line_no"), F.lit(0).alias("entry_no"), F.lit(0).alias("part_no"), F.lit("package").alias("part_kind"), F.col("package").alias("name"))
    rows = own.unionByName(headers, allowMissingColumns=True).join(items, key)
    rows = rows.select("item_id", "part_no", "part_kind", "name", "ctx", "tree", "n_types", "kind", "categories", F.col("in_package").alias("package"), F.col("in_module").alias("module"), F.col("kind").isin("package", "module").alias("is_header"), F.col("item_id").alias("ord"))
    ordered = written(_order(rows, metadata, priorities, canonical, copies), "ordered")
    named = ordered.withColumn("name", X.searchable_name(F.col("part_kind"), F.col("name"))).where("name <> ''")
    scope = [F.col("package"), F.nullif(F.col("module"), F.lit("")).alias("module"), F.col("kind"), F.col("categories")]
    named.select(F.col("popularity_ord").alias("ord"), "item_id", "name", *scope).repartitionByRange("ord").sortWithinPartitions("ord").write.parquet(f"{path}/names")

    phase("names")

    # signatures, once each
    sigs = ordered.where("part_kind = 'signature'").select("ctx", "tree", "n_types", "popularity_ord", "item_id")
    distinct = typesearch.duplicates_index(sigs, ["ctx", "tree", "n_types"], "popularity_ord", "item_id")
    distinct = written(sequences.dense_ids(distinct, ["first_ord"], "sig_ord"), "sigs")
    instances = parts.where("is_instance and kind = 'instance'").select("tree", "n_types")
    dictionary = typesearch.spread_names(typesearch.constructor_frequency(distinct, instances))
    dictionary.write.parquet(f"{path}/ctor_names")
    encoded = typesearch.encode(distinct.select("sig_ord", "ctx", "tree", "n_types"), dictionary)
    fp = typesearch.fingerprint(F.col("ctx"), F.col("tree"), F.col("n_types"))
    encoded.withColumn("fp", fp).select("sig_ord", "ctx", "tree", "n_types", "fp").repartitionByRange("sig_ord").write.parquet(f"{path}/sigs")
    distinct.select("sig_ord", F.posexplode("ids").alias("pos", "item_id")).write.parquet(f"{path}/sig_targets")

    phase("signatures")
    known = rows.where("kind = 'package'").select("package").distinct().withColumn("keep", F.lit(True))
    scopes.completions(known, tags).write.parquet(f"{path}/completions")
    sources.warnings(entries).write.parquet(f"{path}/warnings")
    phase("tags")

    manifest = {"version": VERSION, "warnings": spark.read.parquet(f"{path}/warnings").count(), "phases": phases, "tables": {t: json.loads(spark.read.parquet(f"{path}/{t}").schema.json()) for t in TABLES}}
    p, fs = _path(spark, f"{path}/manifest.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """The index at ``path``; IndexError_ says what is wrong with it."""
    p, fs = _path(spark, f"{path}/manifest.json")
    if not fs.exists(p):
        raise IndexError_(f"no index at {path}: build one first")
    try:
        manifest = json.loads("\n".join(r[0] for r in spark.read.text(str(p.toString())).collect()))
        version, schemas = manifest["version"], manifest["tables"]
    except (ValueError, KeyError, TypeError) as e:
        raise IndexError_(f"{path}: the manifest is damaged") from e
    if version != VERSION:
        raise IndexError_(f"{path}: format {version}; this library reads {VERSION}")
    if lost := [t for t in TABLES if t not in schemas]:
        raise IndexError_(f"{path}: lacks {', '.join(lost)}")
    tables = {}
    for t in TABLES:
        if not fs.exists(_path(spark, f"{path}/{t}/_SUCCESS")[0]):
            raise IndexError_(f"{path}: table {t} is incomplete")
        tables[t] = spark.read.schema(StructType.fromJson(schemas[t])).parquet(f"{path}/{t}")
    return Index(spark, path, **tables, n_warnings=int(manifest.get("warnings", 0)), phases=manifest.get("phases", {}))


@dataclass
class Index:
    spark: SparkSession
    path: str
    items: DataFrame
    names: DataFrame
    sigs: DataFrame
    sig_targets: DataFrame
    ctor_names: DataFrame
    containers: DataFrame
    categories: DataFrame
    completions: DataFrame
    warnings: DataFrame
    n_warnings: int
    phases: dict[str, float]

    def _signature(self, query: str | Query) -> Sig | None:
        if isinstance(query, Query):
            return query.signature
        return to_signature(parse_type(query, query=True))

    def _ids(self, sig: Sig) -> dict[str, int]:
        """Numbers of the names a query uses."""
        wanted = {"->", "Maybe", *("~" + c for c, _ in sig.ctx), *(n for tag, n, _ in preorder(sig.types) if tag == "con")}
        return {r["name"]: r["id"] for r in self.ctor_names.where(F.col("name").isin(*wanted)).collect()}

    def search_types(self, query: str | Query, n: int = typesearch.RESULTS) -> DataFrame:
        """(rank, item_id, variant, total) of a type."""
        sig = self._signature(query)
        return typesearch.search_types(self.sigs, self.sig_targets, sig, self._ids(sig), n)

    def explain_types(self, query: str | Query) -> DataFrame:
        """Every signature with the parts of its fingerprint cost."""
        sig = self._signature(query)
        return typesearch.explain(self.sigs, typesearch.encode_query(sig, self._ids(sig)))

    def compare_types(self, query: str | Query, others: list[str]) -> DataFrame:
        """Given types instead of those of the index: text, fingerprint, the parts of its cost, and the work of unifying."""
        sig = self._signature(query)
        rest = [self._signature(o) for o in others]
        ids = self._ids(Sig((*sig.ctx, *(c for s in rest for c in s.ctx)), (*sig.types, *(t for s in rest for t in s.types))))
        q, arrow = typesearch.encode_query(sig, ids), ids.get("->", 0)
        rows = []
        for i, (text, s) in enumerate(zip(others, rest)):
            e = typesearch.encode_query(s, ids)
            rows.append((i, text, typesearch.unify(q, e, arrow), [{"cls": c, "var": v} for c, v in e.ctx], [{"tag": t, "name": n, "nargs": k} for t, n, k in preorder(e.types)], len(e.types)))
        frame = self.spark.createDataFrame(rows, f"sig_ord bigint, text string, work bigint, ctx {typesearch.CTX}, tree {typesearch.NODE}, n_types int")
        return typesearch.explain(frame, q)

    def timing(self) -> DataFrame:
        """(label, total, share): the seconds of each phase of the build, and their sum."""
        return sequences.share_of_total(self.spark.createDataFrame([(k, float(v)) for k, v in self.phases.items()], "label string, seconds double"), "label", "seconds")

    def _containers(self) -> DataFrame:
        return self.names.where("kind <> ''")

    def hits(self, text: str) -> tuple[Query, DataFrame]:
        """(the query with canonical scopes, ids of its results with their ``rank``). Limits of type search come before
        scope filters and the intersection with names, which so narrow the best results instead of refilling them."""
        q = parse_query(text)
        packages = self.names.where("kind = 'package'").select("name", "ord")
        resolved, ignored = scopes.resolve(packages, q.scopes)
        found = Query(q.names, q.type, [t for _, t in resolved if t], ignored)
        inside = scopes.combined(resolved)
        exact = scopes.is_exact(q.scopes)
        if q.type is not None:
            hits = self.search_types(q).select("item_id", "rank")
            if q.names:
                hits = relations.name_and_type(hits, names.search_names(self.names, q.names, exact))
            # of an item's names any will do: scopes look at the item
            own = self.items.select("item_id", F.col("in_package").alias("package"), F.col("in_module").alias("module"), "kind", "categories")
            return found, own.join(F.broadcast(hits), "item_id").where(inside).select("item_id", "rank")
        if q.names:
            hits = names.search_names(self.names.where(inside), q.names, exact)
            return found, hits.select("item_id", F.struct("score", "ord").alias("rank"))
        hits = scopes.listing(self._containers().where(inside), resolved)
        return found, hits.select("item_id", F.struct(F.lit(0).alias("score"), "ord").alias("rank"))

    def search(self, text: str, n: int | None = 100, start: int = 1) -> DataFrame:
        """(rank, url, package, module, kind, item, docs) of the results from the start-th on, at most n; all if None."""
        _, hits = self.hits(text)
        if n is None:
            ranked = sequences.number_rows(hits.withColumnRenamed("rank", "_rank"), ["_rank"], 1, name="rank").where(F.col("rank") >= start)
            return relations.materialise(ranked.withColumn("rank", F.col("rank").cast("int")), self.items).select("rank", "url", "package", "module", "kind", "item", "docs")
        best = hits.orderBy("rank").offset(max(1, start) - 1).limit(n)
        best = best.withColumn("rank", F.row_number().over(Window.orderBy("rank")) + (max(1, start) - 1))  # over at most n rows
        return relations.materialise(best, self.items).select("rank", "url", "package", "module", "kind", "item", "docs")

    def facets(self, text: str, groups: int = 25) -> DataFrame:
        """(ord, category, value) to narrow the groups by that are shown, the first ``groups``, without the scopes that the
        query has."""
        selected = [t for _, t in scopes.resolve(self.names.where("kind = 'package'").select("name", "ord"), parse_query(text).scopes)[0] if t]
        found = written(self.search(text, None), "found")
        shown = sequences.dedupe_take(found, ["item", "docs"], "rank", groups).select(F.explode("rows").alias("rank"))
        return scopes.facets(found.select(F.col("package.name").alias("package"), "kind", "rank").join(shown, "rank", "left_semi"), selected)

    def sizes(self) -> DataFrame:
        """(label, total, share): the bytes of every table, those of the rest (the overhead), and their sum."""
        rows = []
        p, fs = _path(self.spark, self.path)
        whole = float(fs.getContentSummary(p).getLength())
        for t in TABLES:
            p, fs = _path(self.spark, f"{self.path}/{t}")
            rows.append((t, float(fs.getContentSummary(p).getLength())))
        rows.append(("overhead", whole - sum(b for _, b in rows)))
        return sequences.share_of_total(self.spark.createDataFrame(rows, "label string, bytes double"), "label", "bytes")
