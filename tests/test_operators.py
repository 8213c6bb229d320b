"""Preparation, metrics, series, backends and resumable loops."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions import validate
from sievewright.operators import attempts, backends, metrics, prep, quantiles, scan, series
from sievewright.streaming import resume


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_ids_and_slices(spark):
    df = spark.range(0, 100).select((F.lit(500) - F.col("id") * 5).alias("k")).repartition(7)
    got = rows(prep.with_row_id(df, "k"), "k")
    assert [x[1] for x in got] == list(range(100))
    some = df.withColumn("id", F.when(F.col("k") == 5, 77).cast("long"))
    assert rows(prep.with_row_id(some, "k", first=1), "k")[:2] == [(5, 77), (10, 2)]
    assert [x[0] for x in rows(prep.row_slice(df, "k", 2, 5))] == [15, 20, 25]
    assert prep.row_slice(df, "k", 95).count() == 5 and prep.row_slice(df, "k", 5, 3).count() == 0
    sizes = rows(prep.worker_chunks(df, "k", 3).groupBy("worker_id").agg(F.count("*"), F.min("k")), "worker_id")
    assert sizes == [(0, 34, 5), (1, 34, 175), (2, 32, 345)]


def test_aliases_and_labels(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, "x", "c")], "id int, improved_thought_process string, initial_thought string")
    assert [r[-1] for r in rows(prep.table_alias(df, prep.THOUGHT_NAMES, "t"), "id")] == [None, "x"]
    with pytest.raises(ValueError):
        prep.table_alias(df, ("none",), "t")
    with pytest.raises(ValueError):
        prep.require_columns(df, "id", "label")
    for kind, pairs in {"string": [("1", 1), (" 0 ", 0), ("x", None), (None, None), ("1.5", None)], "double": [(1.7, 1), (2.0, None), (float("nan"), None)], "boolean": [(True, 1), (False, 0)], "int": [(1, 1), (2, None)]}.items():
        d = spark.createDataFrame([(v,) for v, _ in pairs], f"v {kind}")
        assert [r[0] for r in d.select(prep.coerce_label(F.col("v"), d.schema["v"].dataType)).collect()] == [x for _, x in pairs]


def test_sft(spark):
    t = spark.createDataFrame([(1, "p", "h", "t", "1", True), (2, "p", "h", "t", "0", False), (3, "p", "h", "t", "1", None), (4, None, "h", "t", "1", True), (5, "p", "h", "t", "x", True)], "id long, premise string, hypothesis string, thought_process string, predicted_label string, correct boolean")
    r = spark.createDataFrame([(2, "p", "h", "better", 1)], "id long, premise string, hypothesis string, improved_thought_process string, true_label int")
    got = rows(prep.sft_union(prep.originals(t), prep.reflections(r)).select("id", "thought_process", "label", "source_rank"), "source_rank", "id")
    assert got == [(1, "t", 1, 0), (2, "better", 1, 1)]
    assert rows(prep.missing_fields(t, "premise", "correct").select("id", "error_info"), "id")[2:4] == [(3, "missing: correct"), (4, "missing: premise")]
    assert prep.output_name("org/m-7b", "data/test_set.csv", True) == "m-7b-test_set-labelled"
    assert rows(prep.concat_splits(train=t.select("id"), dev=t.select("id").limit(1)).groupBy("split").count(), "split") == [("dev", 1), ("train", 5)]
    dup = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, None, 3)], "id int, v string, line int")
    assert rows(prep.keep_first(dup, "id", "line"), "id") == [(1, "a", 1), (2, None, 3)]


def test_merge_and_metadata(spark):
    df = spark.createDataFrame([(1, "a", '{"v": "b", "n": 2}'), (2, "a", '{"n": 3}'), (3, "a", "oops"), (4, "a", None)], "id int, v string, j string")
    got = rows(prep.merge_json(df, F.col("j"), {"v": "string", "n": "int"}).select("v", "n", "id"), "id")
    assert got == [("b", 2, 1), ("a", 3, 2), ("a", None, 3), ("a", None, 4)]
    assert prep.metadata_columns(df.withColumn("use_cot", F.lit(True)).withColumn("model", F.lit("m"))).columns == ["model", "use_cot"]
    assert prep.with_outputs(df, "j").count() == 3


def test_merge_with_values_of_another_type(spark):
    texts = ['{"n": "no entailment", "v": "b"}', '{"n": null}', '{"v": "c"}', '{"v": "c", "n": ...}', '{"n": 4} {"v": "d"}']
    df = spark.createDataFrame([(i, "a", 7, t) for i, t in enumerate(texts)], "id int, v string, n long, j string")
    got = rows(prep.merge_json(df, F.col("j"), {"v": "string", "n": "long"}).select("v", "n", "id"), "id")
    assert got == [("b", None, 0), ("a", None, 1), ("c", 7, 2), ("a", 7, 3), ("a", 4, 4)]


def test_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1], [0, 1, 1, 2])), "t int, p int")
    m = metrics.macro_metrics(df, "t", "p").first()
    assert abs(m.f1_score - 7 / 18) < 1e-12 and m.accuracy == 0.5
    assert [(r[0], round(r[3], 6)) for r in rows(metrics.per_class(df, "t", "p"), "class")] == [(0, 0.666667), (1, 0.5), (2, 0.0)]
    assert [r[0] for r in rows(metrics.class_report(df, "t", "p"))] == ["0", "1", "macro avg", "weighted avg"]
    empty = metrics.binary_metrics(metrics.confusion(df.limit(0), "t", "p"))
    assert rows(empty) == [(0.0, 0.0, 0.0, 0.0)]
    failed = spark.createDataFrame([(1, None), (1, -1), (1, 1)], "t int, p int")
    assert tuple(metrics.confusion(failed, "t", "p").first()) == (1, 2, 1, 1, 0, 0)
    c = spark.createDataFrame([(0, True), (50, False), (150, True), (400, True)], "n int, ok boolean")
    assert rows(metrics.bucket_accuracy(c, "n", "ok"), "bucket") == [("0-100", 2, 1, 50.0), ("101-200", 1, 1, 100.0), ("201-300", 0, 0, 0.0), ("301+", 1, 1, 100.0)]
    assert rows(metrics.bucket_accuracy(c, "n", "ok", drop_empty=True), "bucket")[0] == ("0-100", 1, 0, 0.0)
    assert metrics.overall_accuracy(metrics.bucket_accuracy(c, "n", "ok")).first().accuracy == 75.0
    assert rows(metrics.value_stats(c.limit(0), "n")) == [(0.0, 0, 0, 0.0, 0.0, 0.0)]
    two = spark.createDataFrame([(1, 4), (3, 4)], "a int, b int")
    assert rows(metrics.component_stats(two, ["a", "b"]), "component")[0] == ("a", 2.0, 1, 3, 1.5, 2.0, 2.5)
    change = spark.createDataFrame([(0, 1), (1, None), (None, None), (1, 0), (1, 1)], "o int, n int")
    assert tuple(metrics.prediction_changes(change, "o", "n").first()) == (3, 1, 1)
    w = rows(metrics.worker_report(spark.createDataFrame([(0, 1, 1), (1, 1, -1), (1, 0, 0)], "worker_id int, t int, p int"), "t", "p"), "worker_id")
    assert w == [(None, 2, 2, 100.0), (0, 1, 1, 100.0), (1, 1, 1, 100.0)]
    assert [r[0] for r in spark.createDataFrame([("1",), ("Entailment",), ("maybe",), (None,)], "l string").select(metrics.entailment_class(F.col("l"))).collect()] == ["entailment", "entailment", "no_entailment", None]


def test_series(spark):
    pts = [("a", s, float(s) if s % 7 else float("nan")) for s in range(40)] + [("b", s, 0.5) for s in range(3)]
    df = spark.createDataFrame(pts, "run string, step int, loss double")
    got = {(r.run, r.step): r.rolling for r in series.rolling_mean(df, "run", "step", "loss").collect()}
    for run, s, _ in pts:
        w = 4 if run == "a" else 1
        seen = [v for r, k, v in pts if r == run and s - w < k <= s and v == v]
        assert got[run, s] == (pytest.approx(sum(seen) / len(seen)) if seen else None)
    assert rows(series.best_step(df, "run", "step", "loss"), "run") == [("a", 1, 1.0), ("b", 0, 0.5)]
    assert rows(series.best_step(df, "run", "step", "loss", largest=True), "run") == [("a", 39, 39.0), ("b", 0, 0.5)]
    assert {r.loss for r in series.as_percent(df, "run", "loss").filter("run = 'b'").collect()} == {50.0}
    assert [round(r[-1], 3) for r in rows(series.progress(spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True)], "run string, step int, ok boolean"), "run", "step", "ok"), "step")] == [100.0, 50.0, 66.667]
    assert spark.range(1).select(series.remaining_seconds(F.lit(10.0), F.lit(4), F.lit(10))).first()[0] == 15.0


def test_ask_again():
    calls, waited = [], []

    class Flaky:
        def generate(self, messages, model, **options):
            calls.append((len(messages), model))
            if len(calls) == 1:
                raise backends.RateLimited("429")
            if len(calls) == 2:
                raise ValueError("Too Many Requests")
            return "nonsense" if len(calls) < 5 else '{"thought_process": "t", "predicted_label": "1"}'

    pick = lambda n, m: backends.escalate(n, m, "mid", "big")
    got = backends.ask(Flaky(), "q", "base", ("thought_process",), sleep=waited.append, pick=pick)
    assert got["ok"] and got["reply"]["predicted_label"] == 1 and waited == [2, 4]
    assert calls == [(1, "base"), (1, "base"), (1, "base"), (1, "base"), (3, "base")]
    never = backends.ask(backends.StubBackend(lambda m: "{}"), "q", "base", ("thought_process",), retries=2)
    assert not never["ok"] and never["reprompts"] == 5
    assert [backends.backoff_seconds(n) for n in (1, 5, 6, 9)] == [2, 32, 60, 60]
    assert [backends.escalate(n, "a", "six", "nine") for n in (0, 5, 8, 17)] == ["a", "six", "nine", "nine"]


def test_backend_failures_and_rounds(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "id long, true_label int")
    make = lambda: backends.StubBackend(lambda m: "no" if "2" in m[0]["content"] else json.dumps({"error_analysis": "e", "improved_thought_process": "i", "predicted_label": 0}))
    got = rows(backends.reflect(df, make, F.concat(F.lit("row "), "id"), retries=1).select("id", "predicted_label", "improved_thought_process", "error_info"), "id")
    assert got == [(1, 0, "i", None), (2, 1, None, "json")]
    scored = backends.score_rounds(df, lambda d, k: d.withColumn("score", (F.col("id") + k).cast("int")), rounds=3)
    assert rows(scored.select("id", "score", "tier", "round"), "id") == [(1, 3, "low", 2), (2, 4, "gold", 2)]


def test_resume(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = T.StructType().add("id", "long").add("v", "string")
    write = lambda i: spark.createDataFrame([(i, "a"), (i + 1, "b")], schema).coalesce(1).write.mode("append").json(src)
    step = lambda df: df.withColumn("v", F.upper("v"))
    write(1)
    assert resume.process_new_files(spark, src, schema, step, out, mark) == 1
    assert resume.process_new_files(spark, src, schema, step, out, mark) == 0
    write(2)
    assert resume.process_new_files(spark, src, schema, step, out, mark) == 1
    assert spark.read.schema(schema).json(out).count() == 4
    assert rows(resume.read_appended(spark, out, schema).select("id"), "id") == [(1,), (2,), (3,)]
    assert rows(prep.not_done(spark.range(5), spark.range(3), "id"), "id") == [(3,), (4,)]


def test_score_rounds_with_a_random_scorer(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def judge(x):
        import random

        calls.add(1)
        return random.randint(0, 5)

    got = backends.score_rounds(spark.range(600), lambda d, k: d.withColumn("score", judge.asNondeterministic()("id")), rounds=3).collect()
    assert sorted(r.id for r in got) == list(range(600))
    assert calls.value == sum(r["round"] + 1 for r in got)
    assert all((r.tier == "gold") == (r.score >= 4) and (r.score >= 4 or r["round"] == 2) for r in got)


def test_shared_folder(spark):
    from sievewright import storage

    class Cluster:
        class sparkContext:
            master = "local-cluster[3,2,3000]"

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        storage.shared_dir(Cluster)
    assert storage.shared_dir(spark)
    assert storage.unused(spark.range(1).withColumn("_ID", F.lit(1)), "_id", "_n", "id") == ["__id", "_n", "___id"]


def test_numbering_keeps_every_column(spark):
    df = spark.createDataFrame([(3, "c", 1, 9), (None, "n", 2, 9), (1, "a", 3, 9), (2, "b", 4, 9), (None, "m", 5, 9)], "k int, _id string, _row int, _place int")
    got = rows(prep.with_row_id(df, "k", name="no"), "no")
    assert [x[-1] for x in got] == [0, 1, 2, 3, 4] and [x[1] for x in got[2:]] == ["a", "b", "c"] and {x[1] for x in got[:2]} == {"n", "m"}
    assert {x[3] for x in got} == {9} and prep.with_row_id(df.limit(0), "k", name="no").count() == 0
    chunks = prep.worker_chunks(df, "k", 2)
    assert chunks.columns == ["k", "_id", "_row", "_place", "worker_id"]
    assert sorted(r.worker_id for r in chunks.collect()) == [0, 0, 0, 1, 1]
    assert {r._id for r in prep.row_slice(df, "k", 3).collect()} == {"b", "c"}
    assert sorted(r.k or 0 for r in prep.row_slice(df, "k", 1, 4).collect()) == [0, 1, 2] and prep.row_slice(df, "k", 1, 2).first().k is None
    assert prep.row_slice(df, "k", 5, 9).count() == 0 and prep.row_slice(df, "k", 4, 9).first()._id == "c" and prep.row_slice(df, "k", 0).count() == 5
    ties = spark.range(40).select((F.col("id") % 4).alias("k"), "id")
    assert sorted(r.k for r in prep.row_slice(ties, "k", 8, 22).collect()) == [0] * 2 + [1] * 10 + [2] * 2
    assert prep.keep_first(df.fillna(0), "k", "_row").count() == 4


def test_rolling_mean_of_a_null_run(spark):
    df = spark.createDataFrame([(None, 1, 2.0, 7), (None, 2, 4.0, 7), ("a", 1, 0.5, 7)], "run string, step int, loss double, _s int")
    got = series.rolling_mean(df, "run", "step", "loss", parts=2).collect()
    assert {(r.run, r.step): r.rolling for r in got} == {(None, 1): 2.0, (None, 2): 4.0, ("a", 1): 0.5} and {r._s for r in got} == {7}
    assert {(r.run, r.loss) for r in series.as_percent(df, "run", "loss").collect()} == {(None, 2.0), (None, 4.0), ("a", 50.0)}


def test_count_tokens(spark, sf_dir):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from sievewright.operators.tokens import count_tokens
    from sievewright.plans import registry

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = [None, "", "It's  12 o'clock \U0001f600", "x" * 5000]
    got = rows(count_tokens(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), path), "id")
    assert got == [(i, len(tok.encode(t).ids) if t else 0) for i, t in enumerate(texts)]
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    want = {r.conv_id * 1000 + r.turn: len(tok.encode(r.text).ids) for r in turns}
    assert dict(map(tuple, registry.QUERIES["token_count_model"](spark, sf_dir).collect())) == want


def test_tokens_are_counted_in_bounded_runs(monkeypatch):
    """However many rows a batch has, few bytes of text are encoded at once."""
    import pyarrow as pa

    from sievewright.operators import tokens

    class Words:
        def encode_batch_fast(self, texts, add_special_tokens):
            sizes.append([len(t.encode()) for t in texts])
            return [t.split() for t in texts]

    texts = [None, "", "a b", "é è ê", None, "x " * 100, "é", "a b c d"] * 30 + [None] * 50
    want = [len(t.split()) if t else 0 for t in texts]
    for most in (1, 9, 64, 1 << 18):
        sizes = []
        monkeypatch.setattr(tokens, "RUN_BYTES", most)
        assert tokens.token_counts(Words(), pa.array(texts)).tolist() == want
        assert all(sum(x) <= most or sum(1 for n in x if n) == 1 for x in sizes)
        # Slices, as Spark may hand them over, and no rows at all.
        assert tokens.token_counts(Words(), pa.array(texts)[3:50]).tolist() == want[3:50]
        assert tokens.token_counts(Words(), pa.array([], pa.string())).tolist() == []
        assert tokens.token_counts(Words(), pa.array([None, None], pa.string())).tolist() == [0, 0]


def test_numbers_and_running_sums_in_ranges(spark):
    n = 5000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.when(F.col("id") % 10 == 0, None).otherwise(F.lit("a")).alias("g"), F.lit("x").alias("_part"))
    got = scan.numbered(df, "at", [F.col("k")], by=["g"], total="of").collect()
    for g in (None, "a"):
        some = sorted((r for r in got if r.g == g), key=lambda r: r.k)
        assert [r["at"] for r in some] == list(range(len(some))) and {r.of for r in some} == {len(some)} and {r._part for r in some} == {"x"}
    sums = scan.running(df, {"s": F.col("k"), "none": F.when(F.col("k") < 0, 1)}, [F.col("k")], number="at")
    assert all(r.s == r.k * (r.k + 1) // 2 and r["at"] == r.k and r.none is None for r in sums.collect())
    assert scan.numbered(df.limit(0), "at", [F.col("k")]).count() == 0 and scan.running(df.limit(0), {"s": F.col("k")}, [F.col("k")], by=["g"]).count() == 0


def test_one_run_of_all_rows_fills_many_tasks(spark):
    df = spark.range(4000).select(F.lit("r").alias("run"), F.col("id").alias("step"), F.lit(1.5).alias("loss"), (F.col("id") % 2 == 0).alias("ok"))
    assert {r.rolling for r in series.rolling_mean(df, "run", "step", "loss").collect()} == {1.5}
    far = {r.step: r.accuracy_so_far for r in series.progress(df, "run", "step", "ok").collect()}
    assert far[0] == 100.0 and far[1] == 50.0 and far[3999] == 50.0
    spread = scan.ordered(df, [F.col("run"), F.col("step")])[0]
    assert spread.groupBy("_part").count().count() == 4


def test_reflect_keeps_every_row(spark):
    df = spark.createDataFrame([(None, 1, "x"), (2, 0, "y"), (2, 1, "z")], "id long, true_label int, _true string")
    make = lambda: backends.StubBackend(lambda m: "no" if m[0]["content"].endswith("z") else json.dumps({"error_analysis": "e", "improved_thought_process": "i", "predicted_label": 0}))
    got = backends.reflect(df, make, F.concat(F.lit("row "), "_true"), retries=1).select("id", "predicted_label", "error_info").collect()
    assert sorted(map(tuple, got), key=repr) == [(2, 0, None), (2, 1, "json"), (None, 0, None)]


class Watch:
    """Counts how many calls are under way at once."""

    def __init__(self, seconds):
        import threading

        self.seconds, self.now, self.most, self.lock = seconds, 0, 0, threading.Lock()

    def __call__(self, x):
        import time

        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
        time.sleep(self.seconds)
        with self.lock:
            self.now -= 1
        return x * 10


def test_requests_in_flight():
    import time

    watch, drawn = Watch(0.05), []

    def items():
        for k in range(24):
            drawn.append(k)
            yield k

    began, got = time.monotonic(), []
    for x in attempts.in_flight(items(), watch, 6):
        got.append(x)
        assert len(drawn) <= len(got) + 6
    took = time.monotonic() - began
    assert got == [10 * k for k in range(24)] and watch.most == 6 and took < 24 * 0.05 / 2
    slow = Watch(0)
    assert list(attempts.in_flight(range(3), slow, 1)) == [0, 10, 20] and slow.most == 1
    now, slept = [0.0], []
    bucket = attempts.TokenBucket(2.0, 3, clock=lambda: now[0], sleep=slept.append)
    for _ in range(5):
        bucket.take()
    assert slept == [0.5, 1.0]
    now[0] = 10.0
    bucket.take()
    assert len(slept) == 2


def test_calls_in_batches(spark):
    class Many:
        def generate_many(self, messages, models, **options):
            if len(messages) > 4:
                raise ValueError("too many")
            if any(m[0]["content"] == "7" for m in messages):
                raise backends.RateLimited("slow down")
            return [f"{m[0]['content']}:{n}:{len(messages)}" for m, n in zip(messages, models)]

    df = spark.range(10).coalesce(1).select("id", F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("m"), F.lit("base").alias("text"))
    got = {r.id: (r.t, r.e) for r in attempts.ask_once(df, Many, "m", "text", "t", "e", at_once=2, batch=4).collect()}
    assert got[0] == ("0:base:4", None) and got[9] == ("9:base:2", None) and got[5] == (None, "rate limit: slow down")


def test_attempts_with_limits_and_failures(spark, tmp_path):
    """A backend that keeps a row off twice, raises for one, and answers others at once; the clock is turned by waiting."""
    folder = str(tmp_path)

    class Limited:
        def generate(self, messages, model, **options):
            import os
            import uuid

            n = messages[-1]["content"].split()[1]
            open(f"{folder}/{n}-{uuid.uuid4().hex}", "w").close()
            calls = len([x for x in os.listdir(folder) if x.startswith(f"{n}-")])
            if n == "1" and calls < 3:
                raise backends.RateLimited("later")
            if n == "2":
                raise ValueError("broken")
            return json.dumps({"thought_process": f"t{n}", "predicted_label": 1})

    now, slept = [100.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c"), (None, None)], "id long, _state string")
    prompt = lambda _: F.concat_ws(" ", F.lit("item"), F.coalesce("id", F.lit(0)))
    got = attempts.run(df, Limited, prompt, validate.NLI, "base", system="be brief", policy=attempts.Policy(retries=1), clock=lambda: now[0], sleep=sleep)
    out = sorted(got.collect(), key=repr)
    by = {r.id: r.attempt for r in out}
    assert sorted((r.id or 0, r._state or "") for r in out) == [(0, ""), (1, "a"), (2, "b"), (3, "c"), (3, "c")]
    assert slept == [2.0, 4.0] and by[1].status == "done" and by[1].calls == 3 and by[1].label == 1 and by[1].reprompts == 0
    assert by[2].status == "failed" and by[2].calls == 3 and by[2].error == "broken" and by[2].reprompts == 3
    assert by[3].calls == 1 and [t.role for t in by[3].turns] == ["system", "user", "assistant"] and by[3].reply["thought_process"] == "t3"
    records = {r.id: r for r in attempts.generation_record(got.withColumn("true_label", F.lit(1))).collect()}
    assert records[2].predicted_label == -1 and not records[2].correct and records[1].correct and records[1].chat_history[-1].role == "assistant"
    assert attempts.run(df.limit(0), Limited, prompt, validate.NLI, "base").count() == 0


@pytest.mark.parametrize("kind", ["ties", "doubles", "far", "odd"])
def test_exact_quantiles(spark, kind):
    import random

    rng = random.Random(3)
    draw = {
        "ties": lambda: float(rng.choice([1, 2, 2, 2, 5])),
        "doubles": rng.random,
        "far": lambda: rng.choice([1e308, -1e308, 1e-300, rng.random(), 3.0, 3.0000000000000004]),
        "odd": lambda: rng.choice([float("inf"), float("-inf"), float("nan"), 1.5, -2.5, rng.random()]),
    }[kind]
    data = [(rng.choice(["a", "b", None]), draw()) for _ in range(3000)] + [("one", 7.0), ("none", None), ("a", None)]
    df = spark.createDataFrame(data, "q string, v double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    want = {r.q: r.p for r in df.groupBy("q").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("p")).collect()}
    got = {r[0]: r[1] for r in quantiles.exact(df.withColumnRenamed("q", "g"), "v", probs, by=["g"]).collect()}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
    whole = df.agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("p")).first().p
    assert repr(quantiles.exact(df, "v", probs).first().q) == repr(whole)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v long")
    assert [r.q for r in quantiles.exact(df, "v", (0.5,)).collect()] == [None] and quantiles.exact(df, "v", (0.5,), by=["g"]).count() == 0
    assert metrics.value_stats(df, "v", refined=True).collect() == metrics.value_stats(df, "v").collect()
    some = spark.createDataFrame([(3, True, 1, "x"), (5, False, 2, "y"), (9, True, 3, "z")], "tokens long, ok boolean, q int, bucket string")
    assert rows(metrics.quartile_bucket_accuracy(some, "tokens", "ok", refined=True), "bucket") == rows(metrics.quartile_bucket_accuracy(some, "tokens", "ok"), "bucket")


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "s")], "id long, split string")
    with pytest.raises(ValueError):
        prep.concat_splits(a=df)
    with pytest.raises(ValueError):
        metrics.compare_models(a=df.withColumnRenamed("split", "model"))
