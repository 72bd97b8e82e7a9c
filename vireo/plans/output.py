"""Results as text, JSON and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vireo.functions import scalars as X
from vireo.operators import sequences

LINES, GROUPS, JSON_COUNT, JSON_CAP = 10, 25, 100, 500
_PAIR = "struct<name:string,url:string>"
TARGET = f"struct<url:string,package:{_PAIR},module:{_PAIR},type:string,item:string,docs:string>"


def _pair(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.lit("{}")).otherwise(F.to_json(F.col(c)))


def to_json(results: DataFrame) -> DataFrame:
    """(rank, json) of results; an absent package or module is an empty object."""
    text = lambda c: F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x")))
    value = lambda c: F.substring(text(F.col(c)), F.lit(6), F.length(text(F.col(c))) - 6)  # noqa: E731 - {"x":...}
    parts = [F.lit('{"url":'), value("url"), F.lit(',"package":'), _pair("package"), F.lit(',"module":'), _pair("module"), F.lit(',"type":'), value("kind"), F.lit(',"item":'), value("item"), F.lit(',"docs":'), value("docs"), F.lit("}")]
    return results.select("rank", F.concat(*parts).alias("json"))


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Results from JSON; empty objects become null."""
    t = rows.withColumn("_t", F.from_json(column, TARGET))
    pair = lambda c: F.when(F.col(f"_t.{c}.name").isNotNull(), F.col(f"_t.{c}")).alias(c)
    return t.select(*[c for c in rows.columns if c != column], F.col("_t.url").alias("url"), pair("package"), pair("module"), F.col("_t.type").alias("kind"), F.col("_t.item").alias("item"), F.col("_t.docs").alias("docs"))


def json_array(results: DataFrame) -> str:
    """The page as one JSON array."""
    return "[" + "\n,".join(r["json"] for r in to_json(results).orderBy("rank").collect()) + "]"


def json_page(results_of, start: int = 1, count: int = JSON_COUNT) -> DataFrame:
    """The JSON of ``results_of(n, start)`` from the start-th result on, at most ``count`` and never over the cap."""
    return to_json(results_of(min(max(0, count), JSON_CAP), max(1, start)))


def write_jsonl(results: DataFrame, path: str) -> None:
    """One JSON object per line, in rank order."""
    to_json(results).orderBy("rank").select("json").write.text(path)


def distinct_lines(results: DataFrame, n: int = LINES, link: bool = False) -> tuple[list[str], bool]:
    """(the first n distinct result lines, whether there are more); with ``link`` lines end with the url."""
    line = X.result_line(F.col("module.name"), F.col("item"))
    lines = results.select("rank", (F.concat(line, F.lit(" -- "), F.coalesce("url", F.lit(""))) if link else line).alias("line"))
    rows = lines.groupBy("line").agg(F.min("rank").alias("rank")).orderBy("rank").limit(n + 1).collect()
    return [r["line"] for r in rows[:n]], len(rows) > n


def coloured(text: str, names: list[str]) -> str:
    """Query names marked for a terminal in a line of text."""
    return X.highlighted(text, names, "\033[93m", "\033[0m")


def info(results: DataFrame) -> DataFrame:
    """(rank, text): a result with where it comes from and its docs."""
    line = X.result_line(F.col("module.name"), F.col("item"))
    return results.select("rank", X.info_block(line, F.col("package.name"), F.col("module.name"), F.col("docs")).alias("text"))


def grouped(results: DataFrame, n: int = GROUPS) -> DataFrame:
    """Results that show the same item and docs as one group, the first n groups, with the packages and modules each
    comes from."""
    rows = sequences.dedupe_take(results, ["item", "docs"], "rank", n).select("item", "docs", "group_ord", F.explode("rows").alias("rank"))
    full = rows.join(results.select("rank", F.col("package.name").alias("package"), F.col("module.name").alias("module")), "rank")
    where = sequences.provenance(full, "group_ord", "package", "module", "rank")
    heads = rows.groupBy("group_ord").agg(F.min_by("item", "rank").alias("item"), F.min_by("docs", "rank").alias("docs"))
    return heads.join(where, "group_ord").orderBy("group_ord")
