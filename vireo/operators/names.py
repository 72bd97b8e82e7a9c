"""Scored name search: every needle must occur; a needle at the start of a name lowers its score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vireo.functions.scalars import starts_upper

EXACT, WORST = 0, 4


def clean_needles(needles: list[str]) -> list[str]:
    return [n.strip() for n in needles if n and n.strip()]


def name_score(name: Column, needles: list[str]) -> Column:
    """0 to 4: the least over the needles found at the start of (whole name ? 0 : 2) + (same initial case ? 0 : 1)."""
    low, upper = F.lower(name), starts_upper(name)
    options = [F.lit(WORST)]
    for n in needles:
        n_low, n_upper = n.lower(), bool(n) and (n[0].isupper() or n[0].istitle())
        cost = F.when(low == n_low, 0).otherwise(2) + F.when(upper == F.lit(n_upper), 0).otherwise(1)
        options.append(F.when(F.startswith(low, F.lit(n_low)), cost))
    return (F.least(*options) if len(options) > 1 else options[0]).cast("int")


def search_names(items: DataFrame, needles: list[str], exact: bool = False, name: str = "name", order: str = "ord") -> DataFrame:
    """Rows whose name contains all needles, with their ``score``; without needles every row, in index order. Names that
    are null or empty are never found. The result is ordered by (score, order)."""
    needles = clean_needles(needles)
    named = items.where(F.length(name) > 0)
    conditions = [F.contains(F.lower(name), F.lit(n.lower())) for n in needles]
    found = named.where(reduce(Column.__and__, conditions)) if conditions else named
    found = found.withColumn("score", name_score(F.col(name), needles) if needles else F.lit(WORST).cast("int"))
    if exact and needles:
        found = found.where(F.col("score") == EXACT)
    return found.orderBy("score", order)


def top_names(items: DataFrame, needles: list[str], n: int, exact: bool = False, name: str = "name", order: str = "ord") -> DataFrame:
    """The best n: a bounded heap per task instead of a sort."""
    return search_names(items, needles, exact, name, order).limit(n)


def shared_character_bound(items: DataFrame, name: str = "name") -> DataFrame:
    """The largest number of names that share one character: an upper bound of any search's result."""
    chars = items.where(F.length(name) > 0).select(F.explode(F.array_distinct(F.split(F.lower(name), ""))).alias("char")).where("char <> ''")
    return chars.groupBy("char").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("bound"))
