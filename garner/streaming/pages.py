"""Streams over archive folders: windowed counts with late rows, and page loops that commit rows with their cursor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a stream that is run once, below the shared checkpoint folder; sessions on one machine may name none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster's session must name a shared folder in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="garner-streams-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, folder: str, name: str, files: int = 4) -> DataFrame:
    """A table as a stream of its files, a few per micro-batch. A table that is one file is one batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    pattern = f"{folder}/{name}.parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern if _is_folder(spark, pattern) else f"{folder}/{name}.parquet*")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Rows per window and keys; rows later than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, to files, and read the result."""
    at = scratch(spark, name)
    schema = stream.schema
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def page_loop(stream: DataFrame, spark: SparkSession, key: str, order: str, name: str, location: str | None = None, before: Callable[[int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Every micro-batch is a page: its rows, once per key, and its cursor are committed under the page's number.

    State, rows and cursors live in ``location``: a run that was stopped goes on behind the last
    page committed there, a page that runs again overwrites itself, and files that came since are
    read. Without a location the loop is run once, in a folder of its own. ``before`` is called with
    each page's number. Returns the rows, the newest per key over all pages, and the cursors (page,
    rows_read, cursor).
    """
    at = location or scratch(spark, name)
    schema = stream.schema

    def commit(page: DataFrame, number: int) -> None:
        if before:
            before(number)
        once = page.dropDuplicates([key, order])
        once.write.mode("overwrite").parquet(f"{at}/rows/page={number}")
        page.agg(F.count("*").alias("rows_read"), F.max(order).alias("cursor")).write.mode("overwrite").parquet(f"{at}/cursors/page={number}")

    query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{at}/rows")
    rest = [c for c in schema.names if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("v")).select(key, "v.*")
    return newest, spark.read.parquet(f"{at}/cursors")
