"""Whole sources of an index: declaration files with the address their urls start from, package descriptions, the packages
that are wanted, and the sets they are members of. ``plans.index.build`` takes the four as they are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.sources import files

SOURCE = "path string, body binary, base string"


@dataclass
class Source:
    files: DataFrame  # path, body, and base where urls do not start at the package's page
    metadata: DataFrame | None
    wanted: DataFrame | None  # package; None wants all
    sets: dict[str, DataFrame] = field(default_factory=dict)

    def limited(self, packages: list[str] | None = None, count: int | None = None) -> Source:
        """The same with other wanted packages, or of the wanted ones the first ``count`` by name."""
        wanted = self.wanted
        if packages:
            wanted = self.files.sparkSession.createDataFrame([(p,) for p in packages], "package string")
        if count is not None:
            wanted = (self.all_packages() if wanted is None else wanted.distinct()).orderBy("package").limit(count)
        return Source(self.files, self.metadata, wanted, self.sets)

    def all_packages(self) -> DataFrame:
        own = self.files.select(F.regexp_extract("path", r"([^/]*?)(?:\.[a-z]+)?$", 1).alias("package"))
        return (own if self.metadata is None else own.unionByName(self.metadata.select("package"))).distinct()


def _slashed(c):
    return F.when(F.endswith(c, F.lit("/")), c).otherwise(F.concat(c, F.lit("/")))


def published(spark: SparkSession, declarations: str, descriptions: str, constraints: list[str] = (), release: str | None = None, labels: tuple[str, str, str] = ("curated", "platform", "bundled"), always: tuple[str, ...] = ()) -> Source:
    """What a package archive publishes: a tar of declaration files and a tar of descriptions, of which the latest versions
    count; wanted are the packages of the constraints files, of the release, those bundled with the compiler, and ``always``."""
    described = files.archive(spark, descriptions)
    latest = files.latest_files(described).select("path", "body")
    sets, wanted = {}, spark.createDataFrame([(p,) for p in always], "package string")
    for path in constraints:
        found = files.constraint_set(spark, path)
        sets[labels[0]] = found if labels[0] not in sets else sets[labels[0]].unionByName(found).distinct()
    if release:
        sets[labels[1]], sets[labels[2]] = files.release_set(spark, release), files.release_set(spark, release, bundled=True)
    for members in sets.values():
        wanted = wanted.unionByName(members)
    return Source(files.archive(spark, declarations), files.parse_metadata(latest), wanted.distinct(), sets)


def directories(spark: SparkSession, folders: list[str]) -> Source:
    """Folders of ``name.txt`` files that declare the package of that name, with descriptions beside them. A package without
    a description is a member of the set ``all`` and of its folder's set."""
    texts = described = None
    for folder in folders:
        own = files.declaring(files.folder(spark, folder, "*.txt")).withColumn("_set", F.lit(folder.rstrip("/").rsplit("/", 1)[-1]))
        texts = own if texts is None else texts.unionByName(own)
        found = files.folder(spark, folder, "*.cabal")
        described = found if described is None else described.unionByName(found)
    base = F.concat(F.lit("file://"), F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), r"[^/]*$", ""))
    metadata = files.parse_metadata(described)
    bare = texts.select("package", "_set").distinct().join(metadata.select("package"), "package", "left_anti")
    sets = {"all": bare.select("package").distinct()}
    for folder in folders:
        label = folder.rstrip("/").rsplit("/", 1)[-1]
        sets[label] = bare.where(F.col("_set") == label).select("package").distinct()
    return Source(texts.select("path", "body", base.alias("base"), "package"), metadata, texts.select("package").distinct(), sets)


def _documented(spark: SparkSession, metadata: DataFrame, file, base) -> DataFrame:
    """(path, body, base) of the files that exist. There is one per installed package, so the list is a machine's."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = metadata.where(file.isNotNull()).select(file.alias("file"), base.alias("base")).collect()
    found = []
    for r in rows:
        p = jvm.org.apache.hadoop.fs.Path(r["file"])
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            found.append((fs.resolvePath(p).toString(), r["base"]))
    if not found:
        return spark.createDataFrame([], SOURCE)
    content = spark.read.format("binaryFile").load([p for p, _ in found]).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("content").alias("body"))
    bases = spark.createDataFrame([(p.removeprefix("file:").replace("//", "/"), b) for p, b in found], "path string, base string")
    return content.join(F.broadcast(bases), "path")


def _installed_sets(metadata: DataFrame, labels: tuple[str, ...]) -> dict[str, DataFrame]:
    return {label: metadata.select("package") for label in labels}


def installed(spark: SparkSession, dump: str, labels: tuple[str, ...] = ("curated", "installed")) -> Source:
    """The packages of a machine, from the dump of their records, with the declaration files in their docs folders."""
    metadata = files.installed(spark, dump)
    docs = F.regexp_replace("docs_dir", "/+$", "")
    base = F.concat(F.lit("file://"), F.when(F.startswith("docs_dir", F.lit("/")), F.lit("")).otherwise(F.lit("/")), _slashed(F.col("docs_dir")))
    return Source(_documented(spark, metadata, F.concat(docs, F.lit("/"), "package", F.lit(".txt")), base), metadata, metadata.select("package"), _installed_sets(metadata, labels))


def relocatable(spark: SparkSession, dump: str, root: str, labels: tuple[str, ...] = ("curated", "installed")) -> Source:
    """The same packages with docs below ``root``, in a folder of name and version each; urls are relative to the root."""
    metadata = files.installed(spark, dump)
    docs = F.concat_ws("-", "package", "version")
    file = F.concat(F.lit(root.rstrip("/") + "/"), docs, F.lit("/"), "package", F.lit(".txt"))
    return Source(_documented(spark, metadata, file, _slashed(docs)), metadata, metadata.select("package"), _installed_sets(metadata, labels))


def single(spark: SparkSession, path: str, package: str, base: str) -> Source:
    """One file of another language's declarations, as one package without a description."""
    body = spark.read.format("binaryFile").load(path).select(F.lit(f"{package}.txt").alias("path"), F.col("content").alias("body"), F.lit(base).alias("base"))
    return Source(body, None, spark.createDataFrame([(package,)], "package string"))
