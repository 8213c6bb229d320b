"""Lines with their numbers in their files, verdicts by line and by file, and one write for good and bad rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import exists, stored, unused
from .readers import parse_line


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, modified, line, value): every line of the files, blank ones too, numbered from 1 in its file.

    Files are read by splits. A line's place in its split comes with the scan (rows of a split are neighbours in their
    partition), and a split begins where those before it in its file end: a sum over splits, not over lines. The scan is
    written first, since splits and places may fall otherwise when files are read again with other cores at hand.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path).select(
        meta["file_path"].alias("file"), meta["file_modification_time"].alias("modified"), meta["file_block_start"].alias("start"), "value", F.monotonically_increasing_id().alias("at")
    )
    rows = stored(rows, "lines")
    splits = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(splits, ["file", "start"]).select("file", "modified", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def parsed_lines(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """read_lines with `record`, the object that the line is, null where it is none, malformed or blank."""
    return read_lines(spark, path).withColumn("record", parse_line(F.col("value"), schema))


def read_numbered(spark: SparkSession, path: str | list[str], schema: StructType, id_col: str = "id") -> DataFrame:
    """The objects of JSON lines; one that lacks the key `id_col` gets its line number, one that has null keeps it.

    Malformed and blank lines are left out, and count.
    """
    rows = parsed_lines(spark, path, schema).filter("record is not null")
    lacks = ~F.array_contains(F.json_object_keys(F.trim("value")), id_col)
    numbered = F.when(F.col(f"record.`{id_col}`").isNull() & lacks, F.col("line").cast(schema[id_col].dataType)).otherwise(F.col(f"record.`{id_col}`"))
    return rows.select(*((numbered if f.name == id_col else F.col(f"record.`{f.name}`")).alias(f.name) for f in schema.fields))


def read_whole_files(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """JSON lines of those files whose every line is an object: one malformed or blank line empties its file, no other.

    The lines are parsed once, and written; the bad files, which are few at most as files go, are joined out.
    """
    src = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), parse_line(F.col("value"), schema).alias("record"))
    rows = stored(src, "records")
    bad = rows.filter("record is null").select("file").distinct()
    return rows.join(bad, "file", "left_anti").select("record.*")


def write_routed(df: DataFrame, path: str, error_col: str = "error_info", fields: Sequence[str] = (), good: Sequence[str] = ()) -> dict[str, int]:
    """Good rows to path/verdict=good as JSON lines, those with an error to path/verdict=dead as CSV lines; returns the
    counts (good, dead).

    One pass: the verdict is a partition column of a single write, and the counts are observed as it runs. A good row has
    the columns `good` (all but the error's if none are named). A CSV line has `fields` (the same columns if none are
    named; 'N/A' for a null and for a column that isn't there), then the error; line ends within fields are quoted, and
    there is no header. What path had before is gone.
    """
    own = [c for c in df.columns if c != error_col]
    shown = [F.coalesce(F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None), F.lit("N/A")).alias(c) for c in fields or own]
    error = F.col(f"`{error_col}`")
    dead = F.to_csv(F.struct(*shown, error.cast("string").alias(error_col)), {"escape": '"', "quoteAll": "true"})
    rows = df.select(F.when(error.isNotNull(), "dead").otherwise("good").alias("verdict"), F.when(error.isNotNull(), dead).otherwise(F.to_json(F.struct(*(F.col(f"`{c}`") for c in good or own)))).alias("value"))
    seen = Observation()
    rows = rows.observe(seen, *(F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("good", "dead")))
    rows.write.mode("overwrite").partitionBy("verdict").text(path)
    return dict(seen.get)


def read_routed(spark: SparkSession, path: str, good: StructType, dead: StructType) -> tuple[DataFrame, DataFrame]:
    """The good rows and the dead letters of write_routed; no rows where none was written."""
    left, right = (f"{path}/verdict={v}" for v in ("good", "dead"))
    rows = spark.read.schema(good).json(left) if exists(spark, left) else spark.createDataFrame([], good)
    letters = spark.read.csv(right, schema=dead, multiLine=True, quote='"', escape='"') if exists(spark, right) else spark.createDataFrame([], dead)
    return rows, letters


def route_lines(spark: SparkSession, path: str | list[str], schema: StructType, out: str) -> dict[str, int]:
    """Sort JSON lines into objects and dead letters (file, line, value, error), each line parsed once, in one write;
    returns the counts. Blank lines are left out, but count in the line numbers."""
    rows = parsed_lines(spark, path, schema).filter(F.trim("value") != "")
    letter = unused(spark.createDataFrame([], schema), "file", "line", "value", "error")
    rows = rows.select("record.*", *(F.col(c).alias(x) for c, x in zip(("file", "line", "value"), letter)), F.when(F.col("record").isNull(), F.lit("malformed")).alias(letter[-1]))
    return write_routed(rows, out, letter[-1], fields=letter[:-1], good=schema.names)
