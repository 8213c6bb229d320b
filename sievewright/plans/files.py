"""Queries that write tables to the work folder, read them back, and return what came."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import templates, text
from ..operators import metrics, prep, scan
from ..sources import readers, schemas, writers
from ..sources import lines as source_lines
from ..sources.log import AppendLog
from ..storage import fresh_path, put
from ..streaming import resume
from .catalog import _LENGTHS, _OUTPUTS, _PRED, _pct, _ratio, lengths, outputs, predictions
from .registry import query, table


def _put(spark: SparkSession, path: str, body: str) -> None:
    """A small file of a given name, which Spark's writers can't choose."""
    put(spark, path, body)


_TURN = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("text", "string")
_TURNS = "select conv_id, turn, role, text from conversations"


@query(_TURNS)
def csv_scan(spark, sf_dir):
    """All turns with their line ends and quotes through a CSV file; an empty text is quoted, a null one is not there."""
    path = fresh_path(spark, "csv")
    table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").write.csv(path, header=True, escape='"')
    return readers.read_csv(spark, path, _TURN)


@query("select doc_id, quality, toxic from labels")
def csv_scan_split(spark, sf_dir):
    """A CSV without line ends in fields, which tasks read by ranges."""
    path = fresh_path(spark, "csv")
    table(spark, sf_dir, "labels").write.csv(path, header=True)
    return readers.read_csv(spark, path, T.StructType().add("doc_id", "long").add("quality", "integer").add("toxic", "integer"), multi_line=False)


def _lines(spark: SparkSession, sf_dir: str, bad: bool) -> str:
    """Turns as JSON lines; with bad, each of turn 0 also in two broken forms."""
    path = fresh_path(spark, "jsonl")
    rows = table(spark, sf_dir, "conversations").select("turn", F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("j"))
    if bad:
        forms = F.when(F.col("turn") == 0, F.array("j", F.concat("j", F.lit("{")), F.lit("{oops"))).otherwise(F.array("j"))
        rows = rows.select(F.explode(forms).alias("j"))
    rows.select(F.col("j").alias("value")).write.text(path)
    return path


@query(f"{_TURNS} union all select null, cast(2 * count(*) as bigint), 'malformed', null from conversations where turn = 0")
def jsonl_tolerant(spark, sf_dir):
    """Good lines, and the number of malformed ones."""
    path = _lines(spark, sf_dir, True)
    bad = readers.read_jsonl(spark, path, _TURN, bad_lines=True).agg(F.count("*").alias("turn"))
    bad = bad.select(F.lit(None).cast("long").alias("conv_id"), "turn", F.lit("malformed").alias("role"), F.lit(None).cast("string").alias("text"))
    return readers.read_jsonl(spark, path, _TURN).unionByName(bad)


@query(
    """select 'good' as side, conv_id, turn, role, text, cast(null as varchar) as error, cast(count(*) over () as bigint) as n from conversations
 union all select 'dead', null, null, null, v, 'malformed', cast(count(*) over () as bigint) from (select unnest(['{oops', '[1]']) as v from conversations where turn = 0) b"""
)
def routed_lines(spark, sf_dir):
    """Good lines and dead letters of one pass, with the counts that were observed as it ran."""
    path, out = fresh_path(spark, "jsonl"), fresh_path(spark, "routed")
    rows = table(spark, sf_dir, "conversations").select("turn", F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("j"))
    forms = F.when(F.col("turn") == 0, F.array("j", F.lit("{oops"), F.lit(""), F.lit("[1]"))).otherwise(F.array("j"))
    rows.select(F.explode(forms).alias("value")).write.text(path)
    n = source_lines.route_lines(spark, path, _TURN, out)
    letter = T.StructType().add("file", "string").add("line", "long").add("value", "string").add("error", "string")
    good, dead = source_lines.read_routed(spark, out, _TURN, letter)
    dead = dead.select(F.lit("dead").alias("side"), F.col("value").alias("text"), "error", F.lit(n["dead"]).cast("long").alias("n"))
    return good.select(F.lit("good").alias("side"), "*", F.lit(n["good"]).cast("long").alias("n")).unionByName(dead, allowMissingColumns=True)


#: Files by the rest of the conversation's number; lines in the order of conversation and turn, those of turn 0 also as a
#: blank and a malformed line, and every third without an id.
_FILES, _BAD_FILE = 4, 2


def _numbered_files(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "numbered")
    rows = table(spark, sf_dir, "conversations").withColumn("f", F.pmod("conv_id", F.lit(_FILES)))
    with_id, without = F.to_json(F.struct(F.col("conv_id").alias("id"), "turn", "role")), F.to_json(F.struct("turn", "role"))
    j = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, without).otherwise(with_id)
    forms = F.when(F.col("turn") == 0, F.array(F.lit(""), F.lit("{oops"), j)).otherwise(F.array(j))
    rows = rows.select("f", "conv_id", "turn", F.posexplode(forms).alias("k", "value")).repartition(_FILES, "f").sortWithinPartitions("f", "conv_id", "turn", "role", "k")
    rows.select("f", "value").write.partitionBy("f").text(path)
    return path


_NUMBERED = f"""select conv_id, turn, role, f, k, row_number() over (partition by f order by conv_id, turn, role, k) as line from
 (select conv_id, turn, role, (conv_id % {_FILES} + {_FILES}) % {_FILES} as f, unnest(case when turn = 0 then [0, 1, 2] else [2] end) as k from conversations) x"""


@query(f"select case when (conv_id + turn) % 3 = 0 then line else conv_id end as id, turn, role from ({_NUMBERED}) n where k = 2")
def line_ids(spark, sf_dir):
    """Records that lack an id get the number of their line; blank and malformed lines count."""
    schema = T.StructType().add("id", "long").add("turn", "long").add("role", "string")
    return source_lines.read_numbered(spark, _numbered_files(spark, sf_dir), schema)


@query(f"select f as file, line, k = 1 as malformed from ({_NUMBERED}) n where k <> 0")
def line_numbers(spark, sf_dir):
    """Each line that isn't blank by its file and number, and whether it is malformed."""
    rows = source_lines.parsed_lines(spark, _numbered_files(spark, sf_dir), T.StructType().add("turn", "long")).filter("trim(value) <> ''")
    return rows.select(F.regexp_extract("file", "/f=([0-9]+)/", 1).cast("long").alias("file"), "line", F.col("record").isNull().alias("malformed"))


@query(f"{_TURNS} where (conv_id % {_FILES} + {_FILES}) % {_FILES} <> {_BAD_FILE}")
def jsonl_or_nothing(spark, sf_dir):
    """A folder of files, one of them with a malformed line in its midst: all rows of the others, none of its own."""
    path = fresh_path(spark, "whole")
    rows = table(spark, sf_dir, "conversations").withColumn("f", F.pmod("conv_id", F.lit(_FILES)))
    j = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    broken = (F.col("f") == _BAD_FILE) & (F.col("turn") == 0)
    rows = rows.select("f", F.explode(F.when(broken, F.array(j, F.lit("{oops"))).otherwise(F.array(j))).alias("value")).repartition(_FILES, "f")
    rows.write.partitionBy("f").text(path)
    return readers.read_jsonl_or_nothing(spark, path, _TURN)


@query("select conv_id, cast(null as bigint) as role, text from conversations")
def json_typed(spark, sf_dir):
    """Typed JSON lines: a value of another type is null."""
    path = _lines(spark, sf_dir, False)
    return readers.read_json(spark, path, T.StructType().add("conv_id", "long").add("role", "long").add("text", "string"))


@query("select doc_id, quality, toxic, cast(null as varchar) as note from labels")
def json_dir(spark, sf_dir):
    """All files of a folder; a column that none has is null."""
    path = fresh_path(spark, "dir")
    table(spark, sf_dir, "labels").repartition(3, "doc_id").write.json(path)
    schema = T.StructType().add("doc_id", "long").add("quality", "integer").add("toxic", "integer").add("note", "string")
    got = readers.read_json_dir(spark, path, schema)
    return got.filter(F.col("file_name").endswith(".json")).drop("file_name")


def _documents(spark: SparkSession, sf_dir: str) -> str:
    """Result documents of three models over batches of 300 ids, so none has more than a hundred rows; a pretty-printed file
    each."""
    path = fresh_path(spark, "results")
    rows = outputs(spark, sf_dir).withColumn("output", F.when(F.col("id") % 5 != 0, F.col("output"))).withColumn("model", F.concat(F.lit("m"), F.col("id") % 3, F.lit("-"), F.floor(F.col("id") / 300)))
    result = F.struct(F.col("id").cast("string").alias("premise"), F.col("pred").cast("int").alias("predicted_label"), "output", F.col("true_label").cast("int").alias("true_label"))
    docs = rows.groupBy("model").agg(F.collect_list(result).alias("results"), F.count("*").cast("double").alias("inference_time_seconds"))
    docs = docs.select("model", F.to_json(F.struct("model", "inference_time_seconds", "results"), {"pretty": "true"}).alias("value"))
    docs.repartition("model").write.partitionBy("model").text(path)
    return path


_DOCS = f"select concat('m', id % 3, '-', id // 300) as model, cast(id as varchar) as premise, cast(pred as integer) as predicted_label, case when id % 5 <> 0 then output end as output, cast(true_label as integer) as true_label from ({_OUTPUTS}) o"


@query(_DOCS)
def result_documents(spark, sf_dir):
    docs = readers.read_result_documents(spark, _documents(spark, sf_dir) + "/*/*", schemas.RESULT_FILE)
    return readers.explode_results(docs).select("model", "premise", "predicted_label", "output", "true_label")


@query(f"select model, cast(count(*) as double) as inference_time_seconds, cast(null as boolean) as use_cot, cast(null as double) as samples_per_second from ({_DOCS}) d group by model")
def result_metadata(spark, sf_dir):
    """The allowed metadata of result documents."""
    docs = readers.read_result_documents(spark, _documents(spark, sf_dir) + "/*/*", schemas.RESULT_FILE)
    return prep.metadata_columns(docs)


@query(f"select model, cast(count(*) as bigint) as total_samples, cast(count(output) as bigint) as with_output from ({_DOCS}) d group by model")
def results_with_output(spark, sf_dir):
    """Rows without an output count in the total and are left out else."""
    docs = readers.read_result_documents(spark, _documents(spark, sf_dir) + "/*/*", schemas.RESULT_FILE)
    rows = readers.explode_results(docs)
    total = rows.groupBy("model").agg(F.count("*").alias("total_samples"))
    some = prep.with_outputs(rows).groupBy("model").agg(F.count("*").alias("with_output"))
    return total.join(some, "model", "left")


_COUNT = f"""select cast(count(*) as bigint) as output_count, cast(count(*) filter (where pred = true_label) as bigint) as correct_count, cast(count(*) filter (where pred = 1 and true_label = 1) as bigint) as tp,
 cast(count(*) filter (where pred = 1 and true_label = 0) as bigint) as fp, cast(count(*) filter (where pred = 0 and true_label = 1) as bigint) as fn from ({_PRED}) p"""


@query(
    f"""with m as (select {_pct('correct_count', 'output_count')} as a, {_pct('tp', 'tp + fp')} as p, {_pct('tp', 'tp + fn')} as r from ({_COUNT}) c)
 select 'counted' as model, a as accuracy, p as precision, r as recall, {_ratio('2 * p * r', 'p + r')} as f1_score from m union all select 'direct', 90.0, 80.0, 70.0, 60.0 union all select 'nested', 50.0, 40.0, 30.0, 20.0"""
)
def model_metrics(spark, sf_dir):
    """Metrics of result files by probing: at the top, within a summary, or worked out from counts."""
    path = fresh_path(spark, "metrics")
    c = metrics.confusion(predictions(spark, sf_dir), "true_label", "pred").first().asDict()
    stats = lambda *x: dict(zip(("accuracy", "precision", "recall", "f1_score"), x))
    _put(spark, f"{path}/direct_results.json", json.dumps({"stats": stats(90.0, 80.0, 70.0, 60.0)}, indent=1))
    _put(spark, f"{path}/nested_results.json", json.dumps({"summary": {"stats": stats(50.0, 40.0, 30.0, 20.0)}}, indent=1))
    _put(spark, f"{path}/counted_results.json", json.dumps({"counts": c}, indent=1))
    _put(spark, f"{path}/other.json", "{}")
    return readers.read_model_metrics(spark, path, schemas.RESULT_FILE)


@query("select doc_id, quality from labels")
def path_fallback(spark, sf_dir):
    """An empty test file gives way to the first that fits the pattern."""
    path = fresh_path(spark, "fallback")
    _put(spark, f"{path}/test.jsonl", "")
    table(spark, sf_dir, "labels").select("doc_id", "quality").write.json(f"{path}/my_test_1.jsonl")
    found = readers.path_or_fallback(spark, f"{path}/test.jsonl", f"{path}/*test_*.jsonl")
    return readers.read_json(spark, found, T.StructType().add("doc_id", "long").add("quality", "integer"))


@query("select doc_id, case when doc_id % 4 = 0 then 'dev' else 'train' end as split from documents")
def splits_scan(spark, sf_dir):
    path = fresh_path(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    docs.filter("doc_id % 4 = 0").write.json(f"{path}/dev")
    docs.filter("doc_id % 4 <> 0").write.json(f"{path}/train")
    return readers.read_splits(spark, {"train": f"{path}/train", "dev": f"{path}/dev"}, T.StructType().add("doc_id", "long"))


@query(f"select id, pred from ({_PRED}) p")
def append_and_dedup(spark, sf_dir):
    """Records appended twice, each batch with every id three times in a row: the first of each id counts."""
    path = fresh_path(spark, "append")
    rows = predictions(spark, sf_dir).select("id", "pred")
    again = lambda k: rows.select("id", F.explode(F.array(*(F.col("pred") + k + i for i in range(3)))).alias("pred"))
    writers.append_json(again(0), path)
    writers.append_json(again(7), path)
    return resume.read_appended(spark, path, T.StructType().add("id", "long").add("pred", "long"))


_ENTRY = T.StructType().add("conv_id", "long").add("turn", "long").add("text", "string").add("version", "long")


def _turn_log(spark: SparkSession, sf_dir: str) -> AppendLog:
    """All turns appended in three batches, the second of which comes twice and holds turns of the first again."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    log = AppendLog(spark, fresh_path(spark, "log"), _ENTRY)
    # The last batch is written first, and stays unseen: its commit never comes.
    rows.withColumn("version", F.lit(9).cast("long")).write.json(f"{log.path}/batch={'0' * 32}")
    for version, some in ((1, "conv_id % 2 = 0"), (2, "conv_id % 3 = 0"), (2, "conv_id % 3 = 0"), (3, "true")):
        log.append(rows.filter(some).withColumn("version", F.lit(version).cast("long")), f"batch {version}")
    return log


@query("select conv_id, turn, text, cast(unnest(case when conv_id % 2 = 0 and conv_id % 3 = 0 then [1, 2, 3] when conv_id % 2 = 0 then [1, 3] when conv_id % 3 = 0 then [2, 3] else [3] end) as bigint) as seq from conversations")
def append_log(spark, sf_dir):
    """All records of a log with the numbers of their commits."""
    return _turn_log(spark, sf_dir).read_in_order().select("conv_id", "turn", "text", "seq")


@query("select conv_id, cast(count(*) as bigint) as turns, cast(case when conv_id % 2 = 0 then 1 when conv_id % 3 = 0 then 2 else 3 end as bigint) as version from conversations group by conv_id")
def append_log_first(spark, sf_dir):
    """Of the records of each turn the first in the order of commits, by conversation."""
    log = _turn_log(spark, sf_dir)
    keyed = AppendLog(spark, log.path, _ENTRY).read_in_order().withColumn("key", F.struct("conv_id", "turn", "text"))
    first = prep.keep_first(keyed.withColumn("at", F.struct("seq", "file", "line")), "key", "at")
    return first.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("version").alias("version"))


_FAILED = f"select id, cast(id as varchar) as premise, true_label, case when id % 4 = 1 then concat('no, \"valid\" reply', chr(10), id) end as error_info from ({_PRED}) p"


@query(f"select 'good' as side, id, premise, true_label, cast(null as varchar) as hypothesis, cast(null as varchar) as error_info from ({_FAILED}) f where error_info is null union all select 'dead', id, premise, true_label, 'N/A', error_info from ({_FAILED}) f where error_info is not null")
def dead_letters(spark, sf_dir):
    """Rows with an error go to a CSV of fixed fields, the others to JSON lines, in one write; what was there is gone."""
    path = fresh_path(spark, "letters")
    rows = predictions(spark, sf_dir).select("id", F.col("id").cast("string").alias("premise"), "true_label", F.when(F.col("id") % 4 == 1, F.concat(F.lit('no, "valid" reply\n'), "id")).alias("error_info"))
    fields = ("id", "premise", "hypothesis", "true_label")
    for some in (rows.limit(1), rows):
        source_lines.write_routed(some, path, fields=fields)
    good = T.StructType().add("id", "long").add("premise", "string").add("true_label", "long")
    dead = T.StructType().add("id", "long").add("premise", "string").add("hypothesis", "string").add("true_label", "long").add("error_info", "string")
    left, right = source_lines.read_routed(spark, path, good, dead)
    left = left.select(F.lit("good").alias("side"), "*", F.lit(None).cast("string").alias("hypothesis"), F.lit(None).cast("string").alias("error_info"))
    return left.unionByName(right.select(F.lit("dead").alias("side"), "id", "premise", "true_label", "hypothesis", "error_info"))


@query(f"select 'm' as model, a as accuracy, cast(i as bigint) as position, id, pred from (select {_pct('count(*) filter (where pred = true_label)', 'count(*)')} as a from ({_PRED}) p) x, (select id, pred, row_number() over (order by id) - 1 as i from ({_PRED}) q) y")
def result_document(spark, sf_dir):
    """A report as one JSON text, written, read back and taken apart."""
    path = fresh_path(spark, "report")
    rows = predictions(spark, sf_dir)
    m = metrics.binary_metrics(metrics.confusion(rows, "true_label", "pred")).select("accuracy")
    writers.result_document(rows.select("id", "pred"), {"model": F.lit("m")}, m).write.text(path)
    back = spark.read.text(path, wholetext=True).select(F.from_json("value", "model string, accuracy double, results array<struct<id: bigint, pred: bigint>>").alias("d"))
    return back.select("d.model", "d.accuracy", F.posexplode("d.results").alias("position", "r")).select("model", "accuracy", F.col("position").cast("long").alias("position"), "r.id", "r.pred")


@query("select conv_id, turn, role, text, cast(row_number() over (order by conv_id, turn, role, text) - 1 as bigint) as line from conversations")
def document_of_all_turns(spark, sf_dir):
    """All turns as one JSON document in several files, joined by name, and where each stands in it."""
    path = fresh_path(spark, "document")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    key = F.struct("conv_id", "turn", "role", "text")
    writers.write_document(rows.withColumn("key", key), {"model": "m"}, path, "key")
    # Files by name, lines by number: each line's place in the whole text.
    lines = source_lines.read_lines(spark, f"{path}/part-*").withColumn("value", F.regexp_replace("value", "^,", ""))
    placed = scan.numbered(lines, "place", [F.col("file"), F.col("line")])
    return placed.select(F.from_json("value", _TURN).alias("r"), F.col("place").alias("line")).select("r.*", "line")


@query(f"select pred as prediction, cast(row_number() over (order by id) as bigint) as line from ({_PRED}) p")
def predictions_csv(spark, sf_dir):
    """Predictions alone, in input order: each one's place over the files by name, headers left out."""
    path = fresh_path(spark, "predictions")
    writers.write_predictions(predictions(spark, sf_dir).withColumn("prediction", F.col("pred")), path, "id")
    lines = source_lines.read_lines(spark, f"{path}/part-*").filter("line > 1")
    placed = scan.numbered(lines, "place", [F.col("file"), F.col("line")])
    return placed.select(F.col("value").cast("long").alias("prediction"), (F.col("place") + 1).alias("line"))


@query(f"select 'm' as model, cast(0.5 as double) as precision, {_pct('correct_count', 'output_count')} as accuracy from ({_COUNT}) c")
def metric_update(spark, sf_dir):
    """One key of a metrics document set anew, by two writers; the others stay."""
    document = writers.Versions(spark, fresh_path(spark, "metrics"))
    accuracy = metrics.binary_metrics(metrics.confusion(predictions(spark, sf_dir), "true_label", "pred")).first().accuracy
    with_metric = lambda k, v: lambda d: d | {"metrics": d.get("metrics", {}) | {k: v}}
    for change in (lambda d: {"model": "m"}, with_metric("accuracy", 0.0), with_metric("precision", 0.5), with_metric("accuracy", accuracy)):
        document.update(change)
    found = document.read()[1]
    return spark.createDataFrame([(found["model"], found["metrics"]["precision"], found["metrics"]["accuracy"])], "model string, precision double, accuracy double")


@query(f"select id, score, case when score >= 4 then 'gold' else 'low' end as tier from ({_PRED}) p")
def gold_low_split(spark, sf_dir):
    path = fresh_path(spark, "tiers")
    writers.write_tiers(predictions(spark, sf_dir).select("id", "score"), path, F.col("score"))
    return spark.read.schema("id long, score long, tier string").json(path)


_SUMMARY = f"select 'outputs: ' || output_count || ', correct: ' || correct_count || ', failed: 0' as line from ({_COUNT}) c"


@query(
    f"""{_SUMMARY} union all select printf('accuracy: %.2f%%', {_pct('correct_count', 'output_count')}) from ({_COUNT}) c union all select printf('precision: %.2f%%', {_pct('tp', 'tp + fp')}) from ({_COUNT}) c union all select printf('recall: %.2f%%', {_pct('tp', 'tp + fn')}) from ({_COUNT}) c
 union all select 'tokens ' || b || ': ' || n || ' outputs, ' || c || ' correct, ' || printf('%.2f%%', 100.0 * c / n) from (select case when tokens <= 100 then '0-100' when tokens <= 200 then '101-200' when tokens <= 300 then '201-300' else '301+' end as b, count(*) as n, count(*) filter (where correct) as c from ({_LENGTHS}) x group by 1) y"""
)
def summary_text(spark, sf_dir):
    """The lines of a report: counts, metrics and those buckets that have rows."""
    c = metrics.confusion(predictions(spark, sf_dir), "true_label", "pred")
    m = c.crossJoin(metrics.binary_metrics(c)).first().asDict()
    buckets = [r.asDict() for r in metrics.bucket_accuracy(lengths(spark, sf_dir), "tokens", "correct").filter("n > 0").collect()]
    lines = writers.summary_text(m, buckets, "Run").split("\n")
    return spark.createDataFrame([(x,) for x in lines if re.match(r"outputs|accuracy|precision|recall|tokens \d", x)], "line string")


@query(f"select bucket, n, cast(row_number() over (order by lo) as integer) as place from (select case when tokens <= 100 then '0-100' when tokens <= 200 then '101-200' when tokens <= 300 then '201-300' else '301+' end as bucket, min(tokens) as lo, cast(count(*) as bigint) as n from ({_LENGTHS}) x group by 1) y")
def bucket_order(spark, sf_dir):
    """Buckets by the lower bound in their labels."""
    from pyspark.sql import Window

    got = metrics.bucket_accuracy(lengths(spark, sf_dir), "tokens", "correct").filter("n > 0")
    return got.select("bucket", "n", F.row_number().over(Window.orderBy(text.bucket_floor(F.col("bucket")))).alias("place"))


@query("select doc_id, quality as true_label, toxic from labels")
def true_label(spark, sf_dir):
    """The label column under its other name, and the columns that must be there."""
    rows = prep.table_alias(table(spark, sf_dir, "labels").withColumnRenamed("quality", "label"), ("label",), "true_label")
    return prep.require_columns(rows, "doc_id", "true_label").select("doc_id", "true_label", "toxic")


@query("select conv_id, turn, case when turn % 2 = 0 then text else role end as reasoning from conversations")
def reasoning_alias(spark, sf_dir):
    """The thought if a row has one, else its reasoning."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("thought_process"), F.col("role").alias("reasoning"))
    return rows.select("conv_id", "turn", prep.row_alias(rows, "thought_process", "reasoning").alias("reasoning"))


@query("select source, lang, concat('m-7b-', source, '-', case when lang = 'en' then 'labelled' else 'unlabelled' end) as name from documents group by source, lang")
def output_names(spark, sf_dir):
    """Names of result files, for each source and language."""
    pairs = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    name = prep.output_names(F.lit("org/m-7b"), F.concat(F.lit("data/"), "source", F.lit(".csv")), F.col("lang") == "en")
    return pairs.select("source", "lang", name.alias("name"))


@query("select role, coalesce(cast(count(*) as double) / nullif(cast(sum(turn) as double), 0), 0.0) as samples_per_second from conversations group by role")
def throughput(spark, sf_dir):
    """Turns a second, the turn numbers taken as seconds."""
    rows = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum("turn").alias("s"))
    return rows.select("role", metrics.throughput(F.col("n"), F.col("s")).alias("samples_per_second"))


@query(
    """select kind, keys, cast(count(*) as bigint) as n from (select doc_id, ['finetune', 'initial_generation', 'reflection', 'scoring', 'unheard_of'][doc_id % 5 + 1] as kind from documents) d left join
 (values ('finetune', 'thought_process, predicted_label'), ('initial_generation', 'thought_process, predicted_label'), ('reflection', 'error_analysis, improved_thought_process, predicted_label'), ('scoring', 'analysis, score, improved_thought_process, predicted_label')) p(kind, keys) using (kind) group by all"""
)
def prompt_registry(spark, sf_dir):
    """The keys that the replies to each row's prompt have, looked up by the prompt's type; an unknown type has none."""
    kinds = F.array(*map(F.lit, ("finetune", "initial_generation", "reflection", "scoring", "unheard_of")))
    rows = table(spark, sf_dir, "documents").select(F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("kind"))
    keys = F.array_join(templates.prompt_of(F.col("kind"))["keys"], ", ")
    return rows.groupBy("kind", keys.alias("keys")).agg(F.count("*").alias("n"))


@query("select conv_id, cast(turn as bigint) as turn, cast(10 as double) / (turn + 1) * (max(turn) over (partition by conv_id) - turn) as seconds from conversations")
def remaining_seconds(spark, sf_dir):
    """The time that the turns left would take, if those so far took ten seconds."""
    from ..operators import series

    rows = table(spark, sf_dir, "conversations")
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return rows.join(last, "conv_id").select("conv_id", "turn", series.remaining_seconds(F.lit(10.0), F.col("turn") + 1, F.col("last") + 1).alias("seconds"))


@query("select cast(user_id as varchar) as run, cast(event_id as bigint) as global_step, cast(value as double) as train_loss, cast(null as double) as eval_loss, case when event_type = 'click' then cast(0.25 as double) end as accuracy from events")
def run_history(spark, sf_dir):
    """A training history as JSON lines in its declared shape; series that a step lacks are null."""
    path = fresh_path(spark, "history")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("global_step"), F.col("value").alias("train_loss"), F.when(F.col("event_type") == "click", 0.25).alias("accuracy"))
    writers.overwrite_json(e, path)
    return readers.read_json(spark, path, schemas.RUN_HISTORY)


@query("select run, cast(step as integer) as step, loss as value from (select user_id as run, row_number() over (partition by user_id order by ts, event_id) as step, cast(value as double) as loss from events) e qualify row_number() over (partition by run order by loss desc, step) = 1")
def largest_step(spark, sf_dir):
    """The step of each run's largest value, the first on ties."""
    from ..operators import series
    from .catalog import runs

    return series.best_step(runs(spark, sf_dir), "run", "step", "loss", largest=True)


@query()
def token_count_model(spark, sf_dir):
    """Tokens of all turns by a tokenizer file, which SQL can't express."""
    import public_tokenizers

    from ..operators.tokens import count_tokens

    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return count_tokens(rows, public_tokenizers.path("byte_bpe_50k.json"))
