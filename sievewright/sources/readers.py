"""Scans. All are lazy; every schema is declared by the caller, none is inferred."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True) -> DataFrame:
    """CSV with a header line; quoted fields may hold commas, doubled quotes and line ends.

    With line ends in fields a file can't be split, so one task reads each; without them (multi_line=False) large files
    are read by ranges.
    """
    return spark.read.csv(path, schema=schema, header=True, multiLine=multi_line, quote='"', escape='"', enforceSchema=False)


def parse_line(line: Column, schema: StructType | str) -> Column:
    """The object that the whole line is, null where it is none or malformed. Fields of another type become null.

    The parser stops behind a first object, so the line is read as the only element of an array.
    """
    kind = schema if isinstance(schema, str) else schema.simpleString()
    one = F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"array<{kind}>", {"allowSingleQuotes": "false"})
    return F.when(F.size(one) == 1, F.get(one, F.lit(0)))


def read_jsonl(spark: SparkSession, path: str, schema: StructType, bad_lines: bool = False) -> DataFrame:
    """JSON lines; a malformed line is left out, or with bad_lines all that is returned is those lines' text."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("j", parse_line(F.col("value"), schema))
    return lines.filter(F.col("j").isNull()).select("value") if bad_lines else lines.filter(F.col("j").isNotNull()).select("j.*")


def read_jsonl_or_nothing(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines of whole files; a single malformed line makes its file empty, and no other of the folder."""
    from .lines import read_whole_files

    return read_whole_files(spark, path, schema)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed JSON lines; values of another type become null."""
    return spark.read.schema(schema).json(path)


def read_json_dir(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All *.json files of a folder by column name, with the file's name; an empty folder is an error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*.json")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        raise FileNotFoundError(f"no *.json in {path}")
    return spark.read.schema(schema).json(f"{path}/*.json").withColumn("file_name", F.col("_metadata.file_name"))


def read_result_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row for each whole-file JSON document, with the file's name."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("file_name", F.col("_metadata.file_name"))


def explode_results(documents: DataFrame) -> DataFrame:
    """One row for each result, with its document's metadata and its position."""
    keep = [c for c in documents.columns if c != "results"]
    return documents.select(*keep, F.posexplode("results").alias("position", "r")).select(*keep, "position", *(F.col(f"r.{f.name}").alias(f"{f.name}" if f.name not in keep else f"result_{f.name}") for f in documents.schema["results"].dataType.elementType.fields))


def read_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The results of a document of several files (writers.write_document), a row each, read by as many tasks as there
    are ranges."""
    lines = spark.read.text(f"{path}/part-*").select(F.ltrim(F.regexp_replace("value", "^,", "")).alias("value"))
    return lines.select(parse_line(F.col("value"), schema).alias("r")).select("r.*")


def read_model_metrics(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Metrics of each *_results.json: from stats, else summary.stats, else worked out from the counts."""
    from ..operators.metrics import ratio

    docs = read_result_documents(spark, f"{path}/*_results.json", schema)
    p = ratio(F.col("counts.true_positives"), F.col("counts.true_positives") + F.col("counts.false_positives")) * 100
    r = ratio(F.col("counts.true_positives"), F.col("counts.true_positives") + F.col("counts.false_negatives")) * 100
    own = {
        "accuracy": ratio(F.col("counts.correct_count"), F.col("counts.output_count")) * 100,
        "precision": p,
        "recall": r,
        "f1_score": ratio(2 * p * r, p + r),
    }
    name = F.regexp_replace("file_name", r"_results\.json$", "")
    return docs.select(name.alias("model"), *(F.coalesce(f"stats.{k}", f"summary.stats.{k}", v).alias(k) for k, v in own.items()))


def read_splits(spark: SparkSession, paths: Mapping[str, str], schema: StructType) -> DataFrame:
    """JSON lines of several splits, with a column split."""
    out = None
    for split, path in paths.items():
        df = read_json(spark, path, schema).withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


def path_or_fallback(spark: SparkSession, path: str, pattern: str) -> str:
    """path if it is there and not empty, else the first in name order that fits the pattern."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if fs.exists(at) and fs.getContentSummary(at).getLength() > 0:
        return path
    found = sorted(s.getPath().toString() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)) or [])
    if not found:
        raise FileNotFoundError(pattern)
    return found[0]
