"""Sinks. Each task writes files of its own, so no lock is needed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import numbered
from ..storage import get, names_in, publish, put, stored


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_split_failures(df: DataFrame, good: str, dead: str, error_col: str = "error_info", fields: tuple[str, ...] = ()) -> None:
    """Rows without an error as JSON, the others as CSV of `fields` (missing ones 'N/A') and the error, in two places.

    The rows are worked out once and written before they are split; lines.write_routed does with a single write where one
    folder for both will do.
    """
    df = stored(df, "letters")
    overwrite_json(df.filter(F.col(error_col).isNull()).drop(error_col), good)
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) if c in df.columns else F.lit("N/A").alias(c) for c in fields or [c for c in df.columns if c != error_col]]
    df.filter(F.col(error_col).isNotNull()).select(*shown, error_col).write.mode("overwrite").csv(dead, header=True, escape='"')


def result_document(results: DataFrame, metadata: dict[str, Column], metrics: DataFrame, order: str = "id") -> DataFrame:
    """One JSON text: metadata, metrics, results. For reports of bounded size; write_document takes any number of rows."""
    rows = results.agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in results.columns if c != order)))).alias("results"))
    both = F.broadcast(metrics).crossJoin(rows)
    return both.select(F.to_json(F.struct(*(v.alias(k) for k, v in metadata.items()), *metrics.columns, "results")).alias("value"))


def write_predictions(df: DataFrame, path: str, order: str, column: str = "prediction") -> None:
    """A single-column CSV in input order, which the column `order` gives."""
    df.orderBy(order).select(column).write.mode("overwrite").csv(path, header=True)


def with_metric(document: DataFrame, struct_col: str, key: str, value: Column) -> DataFrame:
    """A metrics document with one key of a struct set anew."""
    return document.withColumn(struct_col, F.col(struct_col).withField(key, value))


def write_tiers(scored: DataFrame, path: str, score: Column, least: int = 4) -> None:
    """Rows by tier: gold from the least score on, low below."""
    scored.withColumn("tier", F.when(score >= least, "gold").otherwise("low")).write.mode("overwrite").partitionBy("tier").json(path)


def summary_text(metrics: dict, buckets: list[dict], title: str, prompt: str = "", workers: list[dict] | None = None, seconds: float | None = None) -> str:
    """A report over one row of metrics, the bucket rows in order of their lower bounds, and the workers' rows."""
    get = lambda k: metrics.get(k) or 0
    lines = [title, f"prompt: {prompt}", f"outputs: {get('output_count')}, correct: {get('correct_count')}, failed: {get('failure_count')}"]
    lines += [f"{k}: {get(k):.2f}%" for k in ("accuracy", "precision", "recall", "f1_score")]
    if seconds is not None:
        lines.append(f"seconds: {seconds:.2f}")
    lines.append(f"tokens: average {get('avg_tokens'):.2f}, least {get('min_tokens')}, most {get('max_tokens')}, quartiles {', '.join(map(str, metrics.get('quartiles') or []))}")
    for b in sorted(buckets, key=lambda b: int(b["bucket"].rstrip("+").split("-")[0])):
        share = 100 * b["correct"] / b["n"] if b["n"] else 0
        lines.append(f"tokens {b['bucket']}: {b['n']} outputs, {b['correct']} correct, {share:.2f}%")
    for w in workers or []:
        lines.append(f"worker {w['worker_id']}: {w['output_count']} outputs, {w['correct_count']} correct, {w['accuracy']:.2f}%")
    return "\n".join(lines)


def write_document(results: DataFrame, head: dict, path: str, order: str = "id") -> int:
    """A JSON document of any number of results, as a folder whose files, joined by name, are the text; returns the rows.

    The first file has `head`'s keys and opens the array "results"; the results follow in the order of a column, a line
    each, a file for each key range, so no task holds more than its range; the last file closes. A line begins with a
    comma but for the first row's, which is told by its number. Nulls come first; rows of an equal key come in the order
    of their text. `cat path/*` is the document; what path had before is gone.
    """
    spark = results.sparkSession
    place, value, total = "place", "value", "total"
    rows = results.select(F.col(f"`{order}`").alias("key"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in results.columns)), {"ignoreNullFields": "false"}).alias(value))
    seen = Observation()
    rows = stored(numbered(rows, place, [F.col("key").asc_nulls_first(), F.col(value)], total=total), "results")
    lines = rows.orderBy(place).select(F.concat(F.when(F.col(place) > 0, ",").otherwise(""), value).alias(value))
    lines.observe(seen, F.count("*").alias("n")).write.mode("overwrite").text(path)
    # Names that sort before and behind those of Spark's part files.
    put(spark, f"{path}/0-head.json", json.dumps(head, ensure_ascii=False)[:-1] + (", " if head else "") + '"results": [\n')
    put(spark, f"{path}/z-tail.json", "]}\n")
    return seen.get["n"]


class Versions:
    """A small JSON document that several writers may update: every version is a file of its own number.

    An update works on the newest version and puts down the next number. That fails where another writer was faster, and
    then the update is worked out anew on what that one left: none is lost, and a reader sees whole versions only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> tuple[int, dict]:
        """The newest version's number, 0 before the first, and the document."""
        names = [int(n[:-5]) for n in names_in(self.spark, self.path) if n.endswith(".json") and n[:-5].isdigit()]
        if not names:
            return 0, {}
        return max(names), json.loads(get(self.spark, f"{self.path}/{max(names):020d}.json"))

    def update(self, change: Callable[[dict], dict]) -> dict:
        """Put down change(document) as the next version, asking again while others come first."""
        while True:
            version, document = self.read()
            new = change(document)
            if publish(self.spark, f"{self.path}/{version + 1:020d}.json", json.dumps(new)):
                return new
