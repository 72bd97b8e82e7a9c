"""Request logs: lenient parsing, daily summaries, health."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vireo.functions.scalars import day_of, duration_seconds

LINE = r"^\s*(\S+)\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+([\s\S]*?))?\s*$"


def interesting(query: Column, marker: str = "q=", ignored: str = "is:ping") -> Column:
    """Requests that are searches, without the pings of monitors."""
    return F.contains(query, F.lit(marker)) & ~F.contains(query, F.lit(ignored))


def parse_lines(lines: DataFrame, column: str = "value", marker: str = "q=", ignored: str = "is:ping") -> DataFrame:
    """(day, user, seconds, query, is_use, is_error) of the lines that count; malformed ones, those of user ``-`` and those
    that are neither search nor error are dropped."""
    part = lambda i: F.regexp_extract(column, LINE, i)
    rows = lines.where(F.col(column).rlike(LINE)).select(part(1).alias("time"), part(2).alias("user"), part(3).alias("took"), part(4).alias("query"), part(5).alias("err"))
    rows = rows.select(
        day_of(F.col("time")).alias("day"), "user", duration_seconds(F.col("took")).alias("seconds"), "query", interesting(F.col("query"), marker, ignored).alias("is_use"), F.col("err").rlike(r"^ERROR:(\s|$)").alias("is_error")
    )
    return rows.where((F.col("is_use") | F.col("is_error")) & (F.col("user") != "-") & F.col("day").isNotNull())


def summary_columns(exact: bool = True) -> list[Column]:
    """Users, uses, slowest, average and errors of rows (user, seconds, is_use, is_error). An error that is no use adds
    nothing to the sum of seconds but one to the average's count."""
    use = F.col("is_use")
    users = F.when(use, F.xxhash64("user"))
    seconds = F.when(use, F.col("seconds")).otherwise(F.lit(0.0))
    return [
        (F.count_distinct(users) if exact else F.approx_count_distinct(users)).alias("users"),
        F.sum(use.cast("bigint")).alias("uses"),
        F.max(seconds).alias("slowest"),
        (F.sum(seconds) / F.count("*")).alias("average"),
        F.sum(F.col("is_error").cast("bigint")).alias("errors"),
    ]


def daily_summary(rows: DataFrame, exact: bool = True) -> DataFrame:
    return rows.groupBy("day").agg(*summary_columns(exact)).orderBy("day")


def partial_summary(rows: DataFrame) -> DataFrame:
    """Mergeable state, a row per day and user hash (so no row holds all users of a day): uses, slowest, sum and count of
    seconds, errors."""
    use = F.col("is_use")
    seconds = F.when(use, F.col("seconds")).otherwise(F.lit(0.0))
    return rows.groupBy("day", F.xxhash64("user").alias("user_hash")).agg(
        F.sum(use.cast("bigint")).alias("uses"), F.max(seconds).alias("slowest"), F.sum(seconds).alias("seconds"), F.count("*").alias("n"), F.sum(F.col("is_error").cast("bigint")).alias("errors")
    )


def merge_summaries(parts: DataFrame) -> DataFrame:
    """Any number of partial summaries as one per day: users first, who may be in several, then days."""
    users = parts.groupBy("day", "user_hash").agg(F.sum("uses").alias("uses"), F.max("slowest").alias("slowest"), F.sum("seconds").alias("seconds"), F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    return users.groupBy("day").agg(
        F.count(F.when(F.col("uses") > 0, 1)).alias("users"), F.sum("uses").alias("uses"), F.max("slowest").alias("slowest"), (F.sum("seconds") / F.sum("n")).alias("average"), F.sum("errors").alias("errors")
    )


def health(summary: DataFrame, today: dt.date, uptime_days: float) -> DataFrame:
    """(errors of today and yesterday, healthy): no such errors, and an index updated less than a day and a half ago."""
    recent = summary.where(F.col("day").isin(today, today - dt.timedelta(days=1)))
    errors = F.coalesce(F.sum("errors"), F.lit(0))
    return recent.agg(errors.alias("errors"), ((errors == 0) & F.lit(uptime_days < 1.5)).alias("healthy"))


def replay_queries(lines: DataFrame, column: str = "value") -> DataFrame:
    """The requests of a log to run again: those of user ``-`` and malformed lines are skipped."""
    part = lambda i: F.regexp_extract(column, LINE, i)
    return lines.where(F.col(column).rlike(LINE)).select(part(2).alias("user"), part(4).alias("query")).where("user <> '-'").select("query")


def log_line(time: Column, user: Column, seconds: Column, query: Column, error: Column) -> Column:
    """A request as a log line, the error's white space as single blanks."""
    err = F.when(error.isNotNull(), F.concat(F.lit("ERROR: "), F.regexp_replace(F.trim(error), r"\s+", " ")))
    return F.concat_ws(" ", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS"), user, F.format_string("%.3f", seconds), query, err)


def chart_feed(summary: DataFrame) -> DataFrame:
    """One JSON object per day for a chart."""
    return summary.select("day", F.to_json(F.struct(F.date_format("day", "yyyy-MM-dd").alias("date"), "users", "uses", "slowest", "average", "errors")).alias("json")).orderBy("day")
