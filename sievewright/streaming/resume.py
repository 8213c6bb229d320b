"""Resumable batch loops as file streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.prep import keep_first
from ..sources.lines import parsed_lines
from ..sources.log import AppendLog
from ..storage import exists, fresh_path, unused


def process_new_files(spark: SparkSession, source: str, schema: StructType, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 16, file_format: str = "json") -> int:
    """Run `step` over files that came since the last call and append its rows to the log `out`; returns the batches run.

    The checkpoint remembers the files. A batch is committed under the checkpoint's name and its own number, so one that
    runs again after a failure, or at the same time elsewhere, is neither lost nor doubled, and one that was killed
    halfway is never seen.
    """
    ran = []

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = step(batch)
        AppendLog(spark, out, rows.schema).append(rows, f"{checkpoint}#{batch_id}")
        ran.append(batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(source)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(ran)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, deleted when the JVM ends."""
    return fresh_path(spark, name)


def read_appended(spark: SparkSession, path: str, schema: StructType, key: str = "id") -> DataFrame:
    """Appended records with one row for each key, the first: in the order of the commits where path is an append log,
    else by the files' times, their names, and the lines in them."""
    if exists(spark, f"{path}/_commits"):
        return AppendLog(spark, path, schema).read_first(key)
    rows = parsed_lines(spark, path, schema).filter("record is not null")
    (at,) = unused(spark.createDataFrame([], schema), "_at")
    return keep_first(rows.select("record.*", F.struct("modified", "file", "line").alias(at)), key, at).drop(at)
