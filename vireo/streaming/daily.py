"""Daily summaries of a stream of requests.

Nothing is ever late: a request counts for its own day whenever it arrives, so there is no watermark. Small states live in a
table in memory (complete mode), others in files to which each batch adds what it changed (update mode). Distinct users are exact: users are kept per (day, user) in a first stateful step, which a second step
over its output sums up.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vireo.operators import logs
from vireo.session import shared_root

USES = ("click", "view", "purchase")


def requests(events: DataFrame) -> DataFrame:
    """Events as log rows: views, clicks and purchases are uses, errors are errors, others do not count."""
    e = events.where(F.col("event_type").isin(*USES, "error"))
    return e.select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("user"), F.col("value").alias("seconds"), F.col("event_type").isin(*USES).alias("is_use"), (F.col("event_type") == "error").alias("is_error"), F.col("event_type").alias("type"))


def per_user(rows: DataFrame) -> DataFrame:
    """State of the stream: one row per (day, user). Its size follows the users, not the requests."""
    use = F.col("is_use")
    seconds = F.when(use, F.col("seconds")).otherwise(F.lit(0.0))
    return rows.groupBy("day", "user").agg(F.sum(use.cast("bigint")).alias("uses"), F.max(seconds).alias("slowest"), F.sum(seconds).alias("seconds"), F.count("*").alias("n"), F.sum(F.col("is_error").cast("bigint")).alias("errors"))


def summarise(state: DataFrame) -> DataFrame:
    """Days of the state."""
    return state.groupBy("day").agg(
        F.sum((F.col("uses") > 0).cast("bigint")).alias("users"), F.sum("uses").alias("uses"), F.max("slowest").alias("slowest"), (F.sum("seconds") / F.sum("n")).alias("average"), F.sum("errors").alias("errors")
    )


def start(stream: DataFrame, name: str, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Keep the state of a stream of log rows in the in-memory table ``name``."""
    spark = stream.sparkSession
    writer = per_user(stream).writeStream.outputMode("complete").format("memory").queryName(name)
    writer = writer.option("checkpointLocation", checkpoint or f"{shared_root(spark)}/vireo-stream-{uuid.uuid4().hex}")
    return (writer.trigger(availableNow=True) if once else writer).start()


def _saved(stream: DataFrame, path: str):
    """A writer for states too large for the driver: every batch writes the (day, user) rows that it changed to a folder of its
    own number, so a batch that runs again replaces what it wrote, and a batch costs what it changes."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return per_user(stream).writeStream.outputMode("update").foreachBatch(save)


def start_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return _saved(stream, path).option("checkpointLocation", checkpoint).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The state that ``start_files`` keeps at ``path``: of each (day, user) the row of the last batch that changed it."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in ("day", "user", "batch")]
    return rows.groupBy("day", "user").agg(F.max_by(F.struct(*values), "batch").alias("r")).select("day", "user", "r.*")


def approximate(stream: DataFrame) -> DataFrame:
    """One step with approximate users: constant state per day."""
    return stream.groupBy("day").agg(*logs.summary_columns(exact=False))


def with_backfill(state: DataFrame, old: DataFrame) -> DataFrame:
    """The state of a restarted stream together with that of the log so far."""
    both = state.unionByName(per_user(old))
    merged = both.groupBy("day", "user").agg(F.sum("uses").alias("uses"), F.max("slowest").alias("slowest"), F.sum("seconds").alias("seconds"), F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    return summarise(merged)


def available_now(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Summaries of everything that is at ``path`` now, read as a stream."""
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        stream = reader.parquet(path)
    else:  # a stream reads folders: the one of the file, restricted to it
        stream = reader.option("pathGlobFilter", where.getName()).parquet(str(where.getParent()))
    target = f"{shared_root(spark)}/vireo-daily-{uuid.uuid4().hex}"
    query = _saved(requests(stream), f"{target}/state").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return summarise(latest(spark, f"{target}/state"))
