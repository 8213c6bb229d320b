"""Round trips of readers and writers."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright import storage
from sievewright.sources import lines as source_lines
from sievewright.sources import readers, schemas, writers
from sievewright.sources.log import AppendLog
from sievewright.streaming import resume

S = T.StructType().add("id", "long").add("v", "string")


def lines(tmp_path, name, *texts):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join(texts))
    return str(p)


def test_csv(spark, tmp_path):
    path = lines(tmp_path, "a.csv", "premise,hypothesis,label", '"a, ""b""","two', 'lines",1', "NA,,0")
    schema = T.StructType(schemas.PAIRS.fields[:3])
    assert [tuple(r) for r in readers.read_csv(spark, path, schema).collect()] == [('a, "b"', "two\nlines", 1), ("NA", None, 0)]


def test_jsonl(spark, tmp_path):
    path = lines(tmp_path, "a.jsonl", '{"id": 1, "v": "x"}', "{oops", "", '{"id": 2, "v": 3} {', '{"id": "no", "v": "y"}', "{'id': 1}", '{"id": 3}')
    assert [tuple(r) for r in readers.read_jsonl(spark, path, S).collect()] == [(1, "x"), (None, "y"), (3, None)]
    assert readers.read_jsonl(spark, path, S, bad_lines=True).count() == 3
    assert readers.read_jsonl_or_nothing(spark, path, S).count() == 0
    good = lines(tmp_path, "b.jsonl", '{"id": 1}', '{"id": 2}')
    assert readers.read_jsonl_or_nothing(spark, good, S).count() == 2
    assert readers.read_splits(spark, {"train": good, "dev": good}, S).groupBy("split").count().count() == 2


def test_folders(spark, tmp_path):
    lines(tmp_path, "d/b.json", '{"id": 2}')
    lines(tmp_path, "d/a.json", '{"id": 1, "v": "x"}')
    got = readers.read_json_dir(spark, str(tmp_path / "d"), S).orderBy("file_name").collect()
    assert [(r.id, r.file_name) for r in got] == [(1, "a.json"), (2, "b.json")]
    (tmp_path / "e").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_json_dir(spark, str(tmp_path / "e"), S)
    lines(tmp_path, "d/test.jsonl", "")
    lines(tmp_path, "d/x_test_1.jsonl", "{}")
    assert readers.path_or_fallback(spark, str(tmp_path / "d/test.jsonl"), str(tmp_path / "d/*test_*.jsonl")).endswith("x_test_1.jsonl")
    with pytest.raises(FileNotFoundError):
        readers.path_or_fallback(spark, str(tmp_path / "none"), str(tmp_path / "none*"))


def test_result_documents(spark, tmp_path):
    doc = {"model": "m", "results": [{"output": "a", "true_label": 1}, {"output": None, "true_label": 0}]}
    lines(tmp_path, "m1_results.json", json.dumps(doc | {"stats": {"accuracy": 90.0}}, indent=2))
    lines(tmp_path, "m2_results.json", json.dumps(doc | {"summary": {"stats": {"accuracy": 80.0}}}, indent=2))
    lines(tmp_path, "m3_results.json", json.dumps(doc | {"counts": {"output_count": 4, "correct_count": 3, "true_positives": 1, "false_positives": 1, "false_negatives": 0}}, indent=2))
    docs = readers.read_result_documents(spark, str(tmp_path / "*_results.json"), schemas.RESULT_FILE)
    got = readers.explode_results(docs)
    assert got.count() == 6 and got.filter("output is null").count() == 3
    m = {r.model: r for r in readers.read_model_metrics(spark, str(tmp_path), schemas.RESULT_FILE).collect()}
    assert [m[k].accuracy for k in ("m1", "m2", "m3")] == [90.0, 80.0, 75.0] and m["m3"].precision == 50.0 and m["m3"].recall == 100.0


def test_writers(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    df = spark.createDataFrame([(1, "a", None), (2, "b", "bad, \"x\"\nline")], "id long, v string, error_info string")
    for _ in range(2):
        writers.append_json(df.select("id", "v"), at("app"))
    assert readers.read_json(spark, at("app"), S).count() == 4
    writers.write_split_failures(df, at("good"), at("dead"), fields=("id", "premise"))
    assert readers.read_json(spark, at("good"), S).count() == 1
    dead = readers.read_csv(spark, at("dead"), T.StructType().add("id", "string").add("premise", "string").add("error_info", "string")).collect()
    assert [tuple(r) for r in dead] == [("2", "N/A", 'bad, "x"\nline')]
    writers.write_predictions(df.withColumn("prediction", -F.col("id")), at("pred"), "id")
    assert [r[0] for r in spark.read.csv(at("pred"), header=True).collect()] == ["-1", "-2"]
    writers.write_tiers(df.withColumn("s", (F.col("id") + 2).cast("int")), at("tiers"), F.col("s"))
    assert sorted(r.tier for r in spark.read.json(at("tiers")).collect()) == ["gold", "low"]
    doc = writers.result_document(df.select("id", "v"), {"model": F.lit("m")}, spark.createDataFrame([(0.5,)], "accuracy double")).first().value
    assert json.loads(doc) == {"model": "m", "accuracy": 0.5, "results": [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}]} and list(json.loads(doc))[0] == "model"
    m = writers.with_metric(spark.sql("select named_struct('a', 1, 'b', 2) as m"), "m", "b", F.lit(3)).first().m
    assert (m.a, m.b) == (1, 3)
    text = writers.summary_text({"accuracy": 50.0, "output_count": 2, "quartiles": [1, 2, 3]}, [{"bucket": "167+", "n": 1, "correct": 1}, {"bucket": "0-112", "n": 0, "correct": 0}], "Run", workers=[{"worker_id": 0, "output_count": 1, "correct_count": 1, "accuracy": 100.0}], seconds=1.5)
    assert text.index("0-112") < text.index("167+") and "accuracy: 50.00%" in text and "worker 0" in text


def _put(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body.encode())


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines_of = {f"f{k}.jsonl": [json.dumps({"id": i % 5, "v": f"{k}-{i}"}) if i % 7 else ("" if i % 2 else "{oops") for i in range(n)] for k, n in enumerate((900, 1, 400))}
    for name, some in lines_of.items():
        _put(tmp_path / "in" / name, "\n".join(some) + "\n")
    _put(tmp_path / "in" / "empty.jsonl", "")
    size, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = source_lines.read_lines(spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    want = {(name, k + 1, x) for name, some in lines_of.items() for k, x in enumerate(some)}
    assert {(r.file.rsplit("/", 1)[-1], r.line, r.value) for r in got} == want and len(got) == len(want)
    # Nothing else than the order of lines tells which of the repeats of an id comes first.
    first = resume.read_appended(spark, str(tmp_path / "in" / "f0.jsonl"), S)
    good = [json.loads(x) for x in lines_of["f0.jsonl"] if x.startswith('{"')]
    assert {r.id: r.v for r in first.collect()} == {i: next(x["v"] for x in good if x["id"] == i) for i in range(5)}


def test_default_ids(spark, tmp_path):
    _put(tmp_path / "a.jsonl", '{"v": "one"}\n\n{"id": null, "v": "null"}\n{oops\n{"v": "five"}\n  {"id": 9, "v": "nine"}\n')
    got = source_lines.read_numbered(spark, str(tmp_path / "a.jsonl"), S).collect()
    assert {(r.id, r.v) for r in got} == {(1, "one"), (None, "null"), (5, "five"), (9, "nine")}


def test_whole_files(spark, tmp_path):
    _put(tmp_path / "d" / "a.jsonl", '{"id": 1, "v": "a"}\n{"id": 2, "v": "b"}\n')
    _put(tmp_path / "d" / "b.jsonl", '{"id": 3, "v": "a"}\n{"id": 4, "v"\n')
    _put(tmp_path / "d" / "c.jsonl", '{"id": 5, "v": "a"}\n\n{"id": 6, "v": "b"}\n')
    _put(tmp_path / "d" / "e.jsonl", "")
    got = readers.read_jsonl_or_nothing(spark, str(tmp_path / "d"), S)
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_routed_lines(spark, tmp_path):
    _put(tmp_path / "a.jsonl", '{"id": 1, "v": "a"}\n\n{"id": 2, "v": "say \\"x\\"\\nend"}\n{"id": "3\n[4]\n')
    out = str(tmp_path / "out")
    assert source_lines.route_lines(spark, str(tmp_path / "a.jsonl"), S, out) == {"good": 2, "dead": 2}
    letter = T.StructType().add("file", "string").add("line", "long").add("value", "string").add("error", "string")
    good, dead = source_lines.read_routed(spark, out, S, letter)
    assert {(r.id, r.v) for r in good.collect()} == {(1, "a"), (2, 'say "x"\nend')}
    assert {(r.line, r.value, r.error) for r in dead.collect()} == {(4, '{"id": "3', "malformed"), (5, "[4]", "malformed")}
    df = spark.createDataFrame([(1, 'a "b",\nc', None)], "id long, verdict string, error_info string")
    assert source_lines.write_routed(df, out) == {"good": 1, "dead": 0}
    good, dead = source_lines.read_routed(spark, out, T.StructType().add("id", "long").add("verdict", "string"), letter)
    assert [tuple(r) for r in good.collect()] == [(1, 'a "b",\nc')] and dead.count() == 0
    assert source_lines.write_routed(df.limit(0), out) == {"good": 0, "dead": 0}
    assert [x.count() for x in source_lines.read_routed(spark, out, S, letter)] == [0, 0]


def test_append_log(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path / "log"), S)
    row = lambda i, v: spark.createDataFrame([(i, v), (i, v + "2"), (None, v)], S)
    assert log.read().count() == log.read_in_order().count() == log.read_first().count() == 0
    # A batch that was killed before its commit, one that comes twice, and one without a name, which may.
    row(1, "killed").write.json(f"{log.path}/batch={'f' * 32}")
    assert [log.append(row(1, "a"), "t1"), log.append(row(1, "b"), "t2"), log.append(row(1, "other"), "t1"), log.append(row(2, "c"))] == [1, 2, 1, 3]
    assert [(r.seq, r.v) for r in log.read_in_order().orderBy("seq", "file", "line").collect()] == [(k, v) for k, x in ((1, "a"), (2, "b"), (3, "c")) for v in (x, x + "2", x)]
    assert {(r.id, r.v) for r in log.read_first().collect()} == {(1, "a"), (2, "c"), (None, "a")} and log.read().count() == 9


def test_concurrent_appends(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "log")
    one = lambda k: AppendLog(spark, path, S).append(spark.createDataFrame([(k, "x")], S), f"t{k % 6}")
    with ThreadPoolExecutor(4) as pool:
        seqs = list(pool.map(one, range(12)))
    log = AppendLog(spark, path, S)
    assert sorted(r.seq for r in log.commits().collect()) == list(range(1, 7)) and len({r.token for r in log.commits().collect()}) == 6
    assert all(seqs[k] == seqs[k + 6] for k in range(6)) and log.read().count() == 6


def test_publish_once(spark, tmp_path):
    at = str(tmp_path / "deep" / "x.json")
    assert storage.publish(spark, at, "one") and not storage.publish(spark, at, "two")
    assert (tmp_path / "deep" / "x.json").read_text() == "one" and [p.name for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")] == ["x.json"]


def test_documents_of_many_rows(spark, tmp_path):
    path = str(tmp_path / "doc")
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("line\n\""), "id")).alias("v"))
    df = df.union(df.filter("id < 3")).withColumn("id", F.when(F.col("id") != 7, F.col("id")))
    # Small ranges would be put together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert writers.write_document(df, {"model": "m", "metrics": {"accuracy": 0.5}}, path) == 503
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(p.name for p in (tmp_path / "doc").iterdir() if not p.name.startswith((".", "_")))
    whole = json.loads("".join((tmp_path / "doc" / n).read_text() for n in names))
    assert whole["model"] == "m" and whole["metrics"] == {"accuracy": 0.5} and len(names) > 4
    ids = [r["id"] for r in whole["results"]]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(ids) == 503 and ids[0] is None
    back = readers.read_document(spark, path, S)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert writers.write_document(df.limit(0), {}, path) == 0
    names = sorted(p.name for p in (tmp_path / "doc").iterdir() if not p.name.startswith((".", "_")))
    assert json.loads("".join((tmp_path / "doc" / n).read_text() for n in names)) == {"results": []}


def test_two_writers_of_one_document(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "metrics")
    assert writers.Versions(spark, path).read() == (0, {})
    count = lambda k: writers.Versions(spark, path).update(lambda d: d | {"n": d.get("n", 0) + 1, f"by{k}": d.get(f"by{k}", 0) + 1})
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(count, [k % 4 for k in range(24)]))
    assert writers.Versions(spark, path).read() == (24, {"n": 24} | {f"by{k}": 6 for k in range(4)})
