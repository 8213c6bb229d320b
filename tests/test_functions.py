"""Text, extraction, validation and templates on hand-derived rows."""

import json

import pytest
from pyspark.sql import functions as F

from sievewright.functions import extract, templates, text, validate


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


#: output, standard label, method, strict label (None: fails)
EXTRACT = [
    ('{"predicted_label": 1}', 1, "json_predicted_label", 1),
    ('{"label": "0"}', 0, "json_label", 0),
    ('{"predicted_label": "TRUE"}', 1, "json_predicted_label", None),
    ('{"predicted_label": 2}', 2, "json_predicted_label", None),
    ('{"predicted_label": 0.7}', 0, "json_predicted_label", None),
    ('{"predicted_label": true}', 1, "json_predicted_label", 1),
    ('{"predicted_label": null, "label": 1}', -1, "extraction_failure", None),
    ('{"a": 1} {"predicted_label": 1}', 1, "json_predicted_label", 1),
    ('{"predicted_label": 2} {"predicted_label": 1}', 2, "json_predicted_label", 1),
    ('{"predicted_label": "No entailment"}', 0, "conclusion_not_entailed", None),
    ('{"predicted_label": "no entailment"}', 0, "json_predicted_label", 0),
    ('{"predicted_label": "entailed"}', -1, "extraction_failure", None),
    ("Final label: 0 … final label: 1", 0, "explicit_label_0", None),
    ("The hypothesis is not entailed.", 0, "conclusion_not_entailed", None),
    ("This is entailment", 1, "conclusion_entailed", None),
    ("no json here", -1, "extraction_failure", None),
    ('{"thought_process": "uses } brace", "predicted_label": 1}', -1, "extraction_failure", None),
    ('is entailed by the premise {"thought_process": "...", "predicted_label": ...}', 1, "conclusion_entailed", None),
    ('{"t": "raw\nnewline", "predicted_label": 1} not entailed', 0, "conclusion_not_entailed", None),
    ("{'predicted_label': 1}", -1, "extraction_failure", None),
    ('{"predicted_label": " 1 "}', 1, "json_predicted_label", 1),
    ('{"predicted_label": "1.5", "x": 1} {"label": 0}', 0, "json_label", 0),
    ('{"predicted_label": {"a": 1}} {"label": 1}', 1, "json_label", 1),
    ("", -1, "extraction_failure", None),
]


def test_extractors(spark):
    outs = [x[0] for x in EXTRACT]
    assert [(r.label, r.method) for r in column(spark, outs, extract.tracking)] == [x[1:3] for x in EXTRACT]
    assert column(spark, outs, lambda c: extract.standard(c, True)) == [x[1] for x in EXTRACT]
    assert column(spark, outs, extract.with_default) == [1 if x[1] == -1 else x[1] for x in EXTRACT]
    got = column(spark, outs, extract.strict)
    assert [r.label for r in got] == [x[3] for x in EXTRACT]
    assert all((r.method == "extraction_failure") == (r.label is None) == (not r.ok) for r in got)


def test_brace_spans(spark):
    cases = {'{"a":1}': ['{"a":1}'], 'x {"a":{"b":2}} y {"c":3}': ['{"a":{"b":2}}', '{"c":3}'], '} {"a":1}': [], '{} } {"x":1} }': ["{}"], "}{ {x} }": ["{x}"], "{a{b}": [], '{"s":"}"} {"t":1}': ['{"s":"}'], "": []}
    assert column(spark, cases, text.brace_spans) == list(cases.values())


def test_clean_json(spark):
    cases = {'A {"B": 1} c': '{"b": 1}', '{\n"a":1,\n"b":2\n}': '{"a":1,"b":2}', "No Object": "no object", "} {": ""}
    assert column(spark, cases, text.clean_json) == list(cases.values())


def test_tokens_and_buckets(spark):
    assert column(spark, [None, "", "abc", "abcd", "éèàùçôê"], text.token_estimate) == [0, 0, 0, 1, 1]
    assert column(spark, [None, "Éte déjà vu, hm!", "a_b-c"], text.token_count) == [0, 6, 3]
    q = F.array(F.lit(112.0), F.lit(135.0), F.lit(166.0))
    assert column(spark, ["112", "113", "166", "167"], lambda c: text.quartile_bucket(c.cast("long"), q)) == ["0-112", "113-135", "136-166", "167+"]
    assert column(spark, ["100", "101", "301"], lambda c: text.fixed_bucket(c.cast("long"))) == ["0-100", "101-200", "301+"]
    assert column(spark, ["113-135", "167+"], text.bucket_floor) == [113, 167]


def test_prompt_parts(spark):
    out = 'schema {"thought_process": "...", "x": 1} then {"thought_process": "real\none", "predicted_label": 1}'
    assert column(spark, [out, "none"], text.thought_from_output) == ["real\none", ""]
    assert column(spark, ['a [/INST] {"k": 1} </s>', "no marker {}", "a [/INST] none", "a [/INST] {\n}"], text.inst_json) == ['{"k": 1}', None, None, None]
    assert column(spark, ["Premise: it rained Hypothesis: wet", "Premise: a\nb"], text.premise_of) == ["it rained", "a"]
    assert column(spark, ["Hypothesis: the User left", "Hypothesis: wet [x]"], text.hypothesis_of) == ["the", "wet"]
    assert column(spark, ["Step 3: so\n\nrest", "step 3 a step 4 b", "none"], text.step3_section) == [": so", " a ", None]


T, I, E = '"thought_process": "t"', '"improved_thought_process": "i"', '"error_analysis": "e"'
VALID = {
    "NLI": [(f'{{{T}, "predicted_label": 1}}', None), (f'{{{T}, "label": 0}}', None), (f'x {{{T}, "predicted_label": "1"}}', None), ('{"predicted_label": 1}', "json"), (f'{{{T}, "predicted_label": 3}}', "label"), (f'{{{T}, "predicted_label": "x"}}', "label"), (f"{{{T}}}", "label"), ("none", "json"), (f'{{{T}, "predicted_label": 0.5}}', "label")],
    "SCORE": [(f'{{"score": 5, "predicted_label": 0, {I}}}', None), (f'{{"score": 0, "label": 1, {I}}}', None), (f'{{"score": 3, "predicted_label": "1", {I}}}', "label"), (f'{{"score": "3", "predicted_label": 1, {I}}}', "score"), (f'{{"predicted_label": 1, {I}}}', "score"), (f'{{"score": 6, "predicted_label": 1, {I}}}', "score"), ('{"score": 3, "predicted_label": 1}', "thought"), ("{", "json")],
    "REFLECTION": [(f'{{{E}, {I}, "predicted_label": 1}}', None), (f'{{{E}, {I}, "predicted_label": "0"}}', None), (f'{{{I}, "predicted_label": 1}}', "keys"), (f'{{{E}, "predicted_label": 1}}', "keys"), (f"{{{E}, {I}}}", "keys"), (f'{{{E}, {I}, "predicted_label": 3}}', "label"), ("no", "json")],
}


@pytest.mark.parametrize("name", VALID)
def test_validation(spark, name):
    got = column(spark, [x[0] for x in VALID[name]], lambda c: validate.validate(c, getattr(validate, name)))
    assert [(r.valid, r.error_kind) for r in got] == [(x[1] is None, x[1]) for x in VALID[name]]


def test_reprompts(spark):
    got = column(spark, ["json", "keys", "label", "score", "thought", None], lambda c: validate.reprompt(c, F.lit("7"), "{...}"))
    assert all(got[:5]) and "'7'" in got[2] and "'7'" in got[3] and got[5] is None


def test_templates(spark):
    odd = ['plain', 'q "x" \\ / \n\t\r\b\f \x01 \x7f', "é ü 日本 \U0001f600", ""]
    got = column(spark, odd, lambda c: templates.sft_text(F.lit("p"), F.lit("h"), c, F.lit(1)))
    for raw, shown in zip(odd, got):
        reply = json.dumps({"thought_process": raw, "predicted_label": 1})
        assert shown == f"<s>[INST] Premise: p\nHypothesis: h\n\n{templates.TASK} [/INST] {reply} </s>"
    assert column(spark, ["p"], lambda c: templates.inference_prompt(c, F.lit("h"))) == [f"[INST] Premise: p\nHypothesis: h\n\n{templates.TASK} [/INST]"]
    assert templates.get_prompt("scoring")[1][1] == "score"
    with pytest.raises(ValueError):
        templates.get_prompt("other")


def test_repeated_keys_and_other_digits(spark):
    from sievewright.functions import extract, validate

    texts = ['{"predicted_label": 0, "predicted_label": 1}', '{"label": 1, "label": "x"} {"label": 0}', '{"predicted_label": "١"}', '{"predicted_label": " 1_0 "}', '{"predicted_label": "1__0"}', '{"predicted_label": "０"}', '{"predicted_label": {"a": 1}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(extract.tracking(F.col("t"))["label"]).collect()] == [1, 0, 1, 10, -1, 0, -1]
    assert [r[0] for r in df.orderBy("i").select(extract.strict(F.col("t"))["label"]).collect()] == [1, 0, 1, None, None, 0, None]
    by = lambda **mode: [tuple(r[0]) for r in df.orderBy("i").select(extract.by_mode(F.col("t"), **mode)).limit(1).collect()]
    assert by() == [(1, None, True)] and by(track=True) == [(1, "json_predicted_label", True)] and by(track=True, strictly=True) == by(strictly=True) == [(1, "json_predicted_label", True)]
    reply = '{"score": 2, "score": 4, "predicted_label": 1, "improved_thought_process": "i", "x": null, "x": 7}'
    one = spark.createDataFrame([(reply,), (reply + "{}",)], "t string").select(validate.validate(F.col("t"), validate.SCORE).alias("v")).select("v.*").collect()
    assert (one[0].valid, one[0].score, one[0].label) == (True, 4, 1) and one[0].fields == {"x": "7", "improved_thought_process": "i", "predicted_label": "1", "score": "4"}
    assert (one[1].valid, one[1].error_kind, one[1].fields) == (False, "json", None)


def test_a_reply_is_parsed_once(spark):
    from sievewright.functions import extract, validate

    df = spark.createDataFrame([("{}",)], "t string")
    for c in (validate.validate(F.col("t"), validate.SCORE), validate.validate(F.col("t"), validate.REFLECTION), extract.tracking(F.col("t")), extract.strict(F.col("t"))):
        plan = df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("from_json") + plan.count("jsontostructs") <= 2, plan[:3000]


def test_keys_that_repeat_within_values(spark):
    inner = '{"a": {"x": 1, "x": 2}, '
    want = {
        inner + '"predicted_label": 1}': 1, inner + '"predicted_label": "0"}': 0, inner + '"label": true, "b": null}': 1, inner + '"predicted_label": null, "label": 1}': -1,
        inner + '"predicted_label": 0.7}': 0, inner + '"predicted_label": {"y": {}}} {"label": 1}': 1, inner + '"predicted_label": 1, ...}': -1, inner + '"predicted_label": 3}': 3,
        '{"predicted_label": 1, "predicted_label": 0, "z": [{"q": 1, "q": 2}]}': 0, inner + '"predicted_label": "1", "predicted_label": false}': 0, inner + '"predicted_label": "NaN"}': -1,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.x for r in df.select("t", extract.tracking(F.col("t"))["label"].alias("x")).collect()} == want
    got = df.limit(1).select(validate.validate(F.lit(inner + '"predicted_label": 1, "thought_process": "t"}'), validate.NLI).alias("v")).first().v
    assert got.valid and got.label == 1 and got.fields["thought_process"] == "t"
    got = df.limit(1).select(validate.validate(F.lit(inner + '"predicted_label": 1, "thought_process": 5}'), validate.NLI).alias("v")).first().v
    assert not got.valid and got.error_kind == "json"
