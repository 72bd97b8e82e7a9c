"""What the operators of this subpackage share: the shared folder, written tables, row passing, labelled samples."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, rows of a batch of the Parquet reader, and bytes of a row group; texts may be long, so far
#: fewer than Spark's defaults of 10,000 rows, 64 MB, 4,096 rows and 128 MB.
BATCH_ROWS, BATCH_BYTES, READER_ROWS, GROUP_BYTES = 1000, 8 << 20, 16, 32 << 20
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only where that is unset (tests, a single
    machine), a temporary folder is made and set."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if sc.applicationId not in _own:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="vireo-")
    return _own[sc.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have ended, with its folder
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/vireo-{uuid.uuid4().hex}-{name}"
    atexit.register(_delete, spark, path)
    return path


def local_path(url: str) -> str:
    """The path of a file: URL, or of a mounted folder, for memory mapping."""
    parts = urlparse(url)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder (file: scheme), not {url}")
    return parts.path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete what ``written`` wrote, when nothing will read it again."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def small_batches(spark: SparkSession) -> None:
    """Keep batches of texts small, in Arrow and in the Parquet reader, whatever the texts' lengths. Likewise what is written: the
    Parquet writer looks at the size of a page and of a row group after the first row, not after a hundred."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))
    spark.conf.set("parquet.block.size", str(GROUP_BYTES))
    for what in ("page", "block"):
        spark.conf.set(f"parquet.{what}.size.row.check.min", "1")


def pass_rows(
    docs: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: object = None
) -> DataFrame:
    """Whole rows through ``change``, whatever other columns they have."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = change(b)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            else:
                yield out

    return docs.mapInArrow(run, schema or docs.schema)


def labelled(documents: DataFrame, labels: DataFrame, target: str, bound: int, seed: int = 7) -> DataFrame:
    """(doc_id, text, y): a sample of at most ``bound`` labelled documents with their texts and labels.

    Drawn are the doc_ids of the smallest hashes, so a rerun draws the same. Null ids and labels are ignored; of a doc_id
    with several labels the largest counts, of one with several texts the one of the smallest hash (one that is not null,
    if there is any). So there are never more than ``bound`` rows, however often an id repeats; the ids are few, hence the
    broadcast. Only ids whose hash is below a limit are shuffled; the limit is raised until enough are below it.
    """
    some = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    some = some.select("doc_id", F.col(target).alias("y"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 1).alias("_o"))
    limit, share = (1 << 63) - 1, 2 * bound / max(1, some.count())
    while True:
        top = limit if share >= 1 else int(share * limit)
        ids = some.where(F.col("_o") <= top).groupBy("doc_id").agg(F.max("y").alias("y"), F.min("_o").alias("_o")).orderBy("_o", "doc_id").limit(bound)
        rows = ids.collect()
        if len(rows) >= bound or share >= 1:
            break
        share *= 4
    chosen = documents.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in rows], ids.select("doc_id", "y").schema)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"))).alias("text"), F.first("y").alias("y"))
