"""All queries by name, with DuckDB SQL that gives the same rows.

The tables hold no model output, so it is derived from documents and labels by expressions that read alike in both
dialects: see _OUTPUTS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import extract, templates, text, validate
from ..operators import metrics, prep, series
from .registry import QUERIES, SQL  # noqa: F401  for those who look them up here
from .registry import query as _query
from .registry import table as _table

#: Rows of labels as truth and a prediction that is wrong for every seventh id.
_PRED = "select doc_id as id, cast(quality as bigint) as true_label, cast(case when doc_id % 7 = 0 then 1 - quality else quality end as bigint) as pred, toxic, doc_id % 6 as score from labels"
#: Sixteen kinds of model output by id: objects, alone, in prose and behind an echoed form, labels of all JSON types and
#: none, phrases, and nothing.
_OUTPUTS = f"""select id, true_label, pred, case id % 16
 when 0 then concat('{{"thought_process": "step 1: d', id, '", "predicted_label": ', pred, '}}')
 when 1 then concat('{{"label": "', pred, '"}}')
 when 2 then 'the hypothesis is not entailed.'
 when 3 then 'so this is an entailment'
 when 4 then concat('Final label: ', pred)
 when 5 then concat('{{"thought_process": "...", "predicted_label": ...}} {{"thought_process": "step 1: d', id, '", "predicted_label": ', pred, '}}')
 when 6 then '{{"predicted_label": "no entailment"}}'
 when 7 then 'no verdict'
 when 8 then concat('{{"predicted_label": 0.', pred, '}} and then {{"label": 1}}')
 when 9 then concat('{{"a": ', id, '}} {{"label": true, "thought_process": "t', id, '"}}')
 when 10 then '{{"predicted_label": null, "label": 1}} yes'
 when 11 then concat('{{"predicted_label": ', pred + 2, '}} {{"predicted_label": "TRUE"}}')
 when 12 then concat('{{"label": " ', pred, '", "predicted_label": "maybe"}} final prediction: ', pred)
 when 13 then concat('{{"thought_process": "is entailed", "x": ', id, ', "label": "False"}}')
 when 14 then concat('so: {{"thought_process": "d', id, '", "predicted_label": "', pred, '", "label": 5}} end')
 else 'The premise. It is NOT ENTAILED' end as output from ({_PRED}) p"""
_LENGTHS = "select d.doc_id as id, d.source, cast(floor(coalesce(length(d.text), 0) / 4) as bigint) as tokens, l.quality = 1 as correct, cast(l.quality as bigint) as label from documents d join labels l on d.doc_id = l.doc_id"
_RATIO = "coalesce(cast({a} as double) / nullif(cast({b} as double), 0), 0.0)"
_PCT = "coalesce(cast({a} as double) * 100.0 / nullif(cast({b} as double), 0), 0.0)"


def _pct(a: str, b: str) -> str:
    return _PCT.format(a=a, b=b)


def _ratio(a: str, b: str) -> str:
    return _RATIO.format(a=a, b=b)


def _views(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """sql over the tables, which are passed in, not registered."""
    frames = {t: _table(spark, sf_dir, t) for t in tables}
    for t in tables:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    if any(t == "labels" for t in tables):
        sql = _braces(sql, tables)
    return spark.sql(sql, **frames)


def _braces(sql: str, tables: tuple[str, ...]) -> str:
    """Escape braces that are not table names."""
    marks = {f"{{{t}}}": f"\0{t}\0" for t in tables}
    for k, v in marks.items():
        sql = sql.replace(k, v)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for k, v in marks.items():
        sql = sql.replace(v, k)
    return sql


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, _PRED, "labels")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, _OUTPUTS, "labels")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimates of labelled documents; the text is reduced to its length before the join."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", text.token_estimate(F.col("text")).alias("tokens"))
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("correct"), F.col("quality").cast("long").alias("label"))
    return docs.join(labels, "id")


_BUCKET = "case when tokens <= 100 then '0-100' when tokens <= 200 then '101-200' when tokens <= 300 then '201-300' else '301+' end"
_FIXED = "(values ('0-100'), ('101-200'), ('201-300'), ('301+')) b(bucket)"


def _bucket_sql(where: str = "") -> str:
    return f"""select b.bucket, coalesce(n, 0) as n, coalesce(correct, 0) as correct, {_pct('correct', 'n')} as accuracy from {_FIXED}
 left join (select {_BUCKET} as bucket, cast(count(*) as bigint) as n, cast(count(*) filter (where correct) as bigint) as correct from ({_LENGTHS}) x {where} group by 1) g on g.bucket = b.bucket"""


@_query(_bucket_sql())
def length_bucket_accuracy(spark, sf_dir):
    return metrics.bucket_accuracy(lengths(spark, sf_dir), "tokens", "correct")


@_query(_bucket_sql("where tokens > 0"))
def length_bucket_accuracy_nonempty(spark, sf_dir):
    return metrics.bucket_accuracy(lengths(spark, sf_dir), "tokens", "correct", drop_empty=True)


@_query(f"select cast(sum(n) as bigint) as n, {_pct('sum(correct)', 'sum(n)')} as accuracy from ({_bucket_sql()}) z")
def bucket_overall_accuracy(spark, sf_dir):
    return metrics.overall_accuracy(metrics.bucket_accuracy(lengths(spark, sf_dir), "tokens", "correct"))


def _stats_sql(source: str, by: str = "", digits: int | None = None, whole: bool = False) -> str:
    shown = (lambda x: f"round({x}, {digits})") if digits is not None else lambda x: x
    q = "".join(f", {'cast(floor(' + f'quantile_cont(tokens, {p})' + ') as bigint)' if whole else shown(f'quantile_cont(tokens, {p})')} as q{k}" for k, p in ((1, 0.25), (2, 0.5), (3, 0.75)))
    return f"select {by + ',' if by else ''} {shown('avg(tokens)')} as avg, cast(min(tokens) as bigint) as min, cast(max(tokens) as bigint) as max{q} from ({source}) s {'group by ' + by if by else ''}"


@_query(_stats_sql(_LENGTHS))
def token_stats(spark, sf_dir):
    return metrics.value_stats(lengths(spark, sf_dir), "tokens")


@_query(_stats_sql(_LENGTHS, whole=True))
def token_quartiles_trunc(spark, sf_dir):
    return metrics.value_stats(lengths(spark, sf_dir), "tokens", whole_quartiles=True)


@_query(_stats_sql(_LENGTHS, by="source", digits=2))
def token_quartiles_interp(spark, sf_dir):
    return metrics.value_stats(lengths(spark, sf_dir), "tokens", "source", digits=2)


_COUNT = r"cast(len(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_\p{{M}}]+')) + len(regexp_extract_all({t}, '[^\p{{L}}\p{{N}}_\p{{M}}\s]')) as bigint)".replace("{{", "{").replace("}}", "}")


@_query(f"select doc_id, {_COUNT.replace('{t}', 'text')} as tokens from documents")
def token_count_unicode(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


@_query(
    f"""with x as ({_LENGTHS}), q as (select cast(floor(quantile_cont(tokens, 0.25)) as bigint) a, cast(floor(quantile_cont(tokens, 0.5)) as bigint) b, cast(floor(quantile_cont(tokens, 0.75)) as bigint) c from x)
 select case when tokens <= a then concat('0-', a) when tokens <= b then concat(a + 1, '-', b) when tokens <= c then concat(b + 1, '-', c) else concat(c + 1, '+') end as bucket,
 cast(count(*) as bigint) as n, cast(count(*) filter (where correct) as bigint) as correct, {_pct('count(*) filter (where correct)', 'count(*)')} as accuracy from x, q group by 1"""
)
def quartile_bucket_accuracy(spark, sf_dir):
    return metrics.quartile_bucket_accuracy(lengths(spark, sf_dir), "tokens", "correct")


@_query("select l_returnflag as flag, l_linestatus as status, unnest([quantile_cont(price, 0.1), quantile_cont(price, 0.25), quantile_cont(price, 0.5), quantile_cont(price, 0.999)]) as q, unnest([0, 1, 2, 3]) as k from (select l_returnflag, l_linestatus, cast(l_extendedprice as double) as price from lineitem) x group by 1, 2")
def price_quantiles(spark, sf_dir):
    """Exact quantiles of values that are mostly distinct, by two columns, found by narrowing histograms."""
    from ..operators.quantiles import exact

    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("price"))
    return exact(rows, "price", (0.1, 0.25, 0.5, 0.999), by=("flag", "status")).select("flag", "status", F.posexplode("q").alias("k", "q"))


@_query(_stats_sql("select doc_id as id, source, cast(floor(coalesce(length(text), 0) / 4) as bigint) as tokens from documents", by="source", digits=2))
def token_quartiles_refined(spark, sf_dir):
    """Length statistics of all documents, their quartiles found by narrowing histograms."""
    docs = _table(spark, sf_dir, "documents").select("source", text.token_estimate(F.col("text")).alias("tokens"))
    return metrics.value_stats(docs, "tokens", "source", digits=2, refined=True)


_PARTS = "select doc_id, cast(floor(length(text) / 4) as bigint) as text, cast(floor(length(source) / 4) as bigint) as source, cast(floor(length(lang) / 4) as bigint) as lang from documents"


@_query(_stats_sql(f"select component, tokens from (unpivot (select text, source, lang from ({_PARTS}) p) on text, source, lang into name component value tokens) u", by="component", digits=2))
def component_token_stats(spark, sf_dir):
    parts = ("text", "source", "lang")
    rows = _table(spark, sf_dir, "documents").select(*(text.token_estimate(F.col(c)).alias(c) for c in parts))
    return metrics.component_stats(rows, list(parts))


_CONF = """cast(count(*) as bigint) as output_count, cast(0 as bigint) as failure_count, cast(count(*) filter (where pred = true_label) as bigint) as correct_count,
 cast(count(*) filter (where pred = 1 and true_label = 1) as bigint) as true_positives, cast(count(*) filter (where pred = 1 and true_label = 0) as bigint) as false_positives, cast(count(*) filter (where pred = 0 and true_label = 1) as bigint) as false_negatives"""


@_query(f"select {_CONF} from ({_PRED}) p")
def confusion_counts(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), "true_label", "pred")


_BIN = f"""select toxic, accuracy, precision, recall, {_ratio('2 * precision * recall', 'precision + recall')} as f1_score from (select toxic, {_pct('correct_count', 'output_count')} as accuracy,
 {_pct('true_positives', 'true_positives + false_positives')} as precision, {_pct('true_positives', 'true_positives + false_negatives')} as recall from (select toxic, {_CONF} from ({_PRED}) p group by toxic) c) m"""


@_query(_BIN)
def binary_metrics(spark, sf_dir):
    return metrics.binary_metrics(metrics.confusion(predictions(spark, sf_dir), "true_label", "pred", "toxic"), "toxic")


#: Predictions with a stray third class.
_STRAY = f"select id, true_label, case when id % 11 = 0 then cast(2 as bigint) else pred end as pred from ({_PRED}) p"
_CLASSES = f"""select k as class, cast(count(*) filter (where pred = k) as double) as n_pred, cast(count(*) filter (where true_label = k) as double) as n_true, cast(count(*) filter (where pred = k and true_label = k) as double) as tp
 from ({_STRAY}) s, (values (0), (1), (2)) c(k) group by k"""
_PER = f"select class, {_ratio('tp', 'n_pred')} as precision, {_ratio('tp', 'n_true')} as recall, {_ratio('2 * ' + _ratio('tp', 'n_pred') + ' * ' + _ratio('tp', 'n_true'), _ratio('tp', 'n_pred') + ' + ' + _ratio('tp', 'n_true'))} as f1_score, cast(n_true as bigint) as support, tp, n_true from ({_CLASSES}) c"


def stray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, _STRAY, "labels")


@_query(f"select {_ratio('sum(tp)', 'sum(n_true)')} as accuracy, round(avg(precision), 10) as precision, round(avg(recall), 10) as recall, round(avg(f1_score), 10) as f1_score from ({_PER}) c")
def macro_metrics(spark, sf_dir):
    m = metrics.macro_metrics(stray(spark, sf_dir), "true_label", "pred")
    return m.select("accuracy", *(F.round(k, 10).alias(k) for k in ("precision", "recall", "f1_score")))


@_query(
    f"""with c as (select * from ({_PER}) z where class < 2) select cast(class as varchar) as name, precision, recall, f1_score, support from c
 union all select 'macro avg', round(avg(precision), 10), round(avg(recall), 10), round(avg(f1_score), 10), cast(sum(support) as bigint) from c
 union all select 'weighted avg', round(sum(precision * support) / sum(support), 10), round(sum(recall * support) / sum(support), 10), round(sum(f1_score * support) / sum(support), 10), cast(sum(support) as bigint) from c"""
)
def class_report(spark, sf_dir):
    r = metrics.class_report(stray(spark, sf_dir), "true_label", "pred")
    rounded = lambda k: F.when(F.col("name").contains("avg"), F.round(k, 10)).otherwise(F.col(k)).alias(k)
    return r.select("name", rounded("precision"), rounded("recall"), rounded("f1_score"), "support")


@_query(f"select case when true_label = 1 then 'entailment' else 'no_entailment' end as class, cast(count(*) as bigint) as n, {_pct('count(*)', 'sum(count(*)) over ()')} as percent from ({_PRED}) p group by 1")
def label_distribution(spark, sf_dir):
    return metrics.shares(predictions(spark, sf_dir).withColumn("class", metrics.entailment_class(F.col("true_label"))), "class")


_SPLIT = "case doc_id % 10 when 0 then 'test' when 1 then 'dev' else 'train' end"


@_query(f"select {_SPLIT} as split, cast(count(*) as bigint) as n, round({_pct('count(*)', 'sum(count(*)) over ()')}, 2) as percent from documents group by 1")
def split_percentages(spark, sf_dir):
    return metrics.shares(_table(spark, sf_dir, "documents").select(F.expr(_SPLIT).alias("split")), "split", digits=2)


@_query(f"select cast(count(*) filter (where score >= 4) as bigint) as high, cast(count(*) as bigint) as scored, {_pct('count(*) filter (where score >= 4)', 'count(*)')} as percent from ({_PRED}) p")
def high_quality_share(spark, sf_dir):
    return metrics.high_quality_share(predictions(spark, sf_dir), "score")


_CLEAN = "select id, replace(lower(output), chr(10), '') as t from (" + _OUTPUTS + ") o"


@_query(f"select id, case when instr(t, '{{') > 0 and instr(t, '}}') > 0 then substr(t, instr(t, '{{'), length(t) - instr(reverse(t), '}}') + 2 - instr(t, '{{')) else t end as cleaned from ({_CLEAN}) c")
def clean_json(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", text.clean_json(F.col("output")).alias("cleaned"))


@_query(rf"select id, cast(len(regexp_extract_all(output, '\{{[^{{}}]*\}}')) as bigint) as n, array_to_string(regexp_extract_all(output, '\{{[^{{}}]*\}}'), '|') as spans from ({_OUTPUTS}) o")
def brace_spans(spark, sf_dir):
    s = outputs(spark, sf_dir).withColumn("s", text.brace_spans(F.col("output")))
    return s.select("id", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("spans"))


def _spans_sql(rows: str) -> str:
    """Spans of rows (id, t): every brace by its place, depths as running sums, the n-th closing with the n-th opening."""
    return f"""with r as ({rows}), c as (select id, t, unnest(string_split(t, '')) as c, generate_subscripts(string_split(t, ''), 1) as p from r where contains(t, '{{')),
 b as (select *, sum(case c when '{{' then 1 else -1 end) over (partition by id order by p) as after from c where c in ('{{', '}}')),
 o as (select id, p, row_number() over (partition by id order by p) as n from b where c = '{{' and after = 1), e as (select id, p, t, row_number() over (partition by id order by p) as n from b where c = '}}' and after = 0),
 s as (select id, n, substr(e.t, o.p, e.p - o.p + 1) as span from e join o using (id, n))
 select id, cast(count(n) as bigint) as n, coalesce(string_agg(span, chr(30) order by n), '') as spans from r left join s using (id) group by id"""


def _spans(rows: DataFrame) -> DataFrame:
    s = rows.withColumn("s", text.brace_spans(F.col("t")))
    return s.select("id", F.size("s").cast("long").alias("n"), F.array_join("s", "\x1e").alias("spans"))


@_query(_spans_sql("select page_id as id, translate(coalesce(html, ''), '<>\"=', '{}{}') as t from pages"))
def brace_spans_pages(spark, sf_dir):
    """All pages, their tags and attributes as braces, nested, stray and unclosed."""
    return _spans(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.translate(F.coalesce("html", F.lit("")), '<>"=', "{}{}").alias("t")))


@_query(_spans_sql("select doc_id as id, translate(coalesce(text, ''), 'aex.', '{}}{{') as t from documents"))
def brace_spans_documents(spark, sf_dir):
    """All documents, some letters as braces, so depths wander on both sides of zero."""
    return _spans(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.translate(F.coalesce("text", F.lit("")), "aex.", "{}}{{").alias("t")))


@_query(rf"""select id, regexp_extract(output, '(?s)\{{.*"thought_process":\s*"(.*?)",.*\}}', 1) as thought from ({_OUTPUTS}) o""")
def thought_from_output(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", text.thought_from_output(F.col("output")).alias("thought"))


_INST = f"select id, true_label, concat('<s>[INST] Premise: p', id, chr(10), 'Hypothesis: h', id, ' Useful', chr(10), ' [/INST] ', output, ' </s>') as t from ({_OUTPUTS}) o"


def _inst(spark, sf_dir):
    return outputs(spark, sf_dir).withColumn("t", F.concat(F.lit("<s>[INST] Premise: p"), "id", F.lit("\nHypothesis: h"), "id", F.lit(" Useful\n [/INST] "), "output", F.lit(" </s>")))


@_query(rf"select id, nullif(regexp_extract(split_part(t, '[/INST]', 2), '\{{.*\}}'), '') as found from ({_INST}) i")
def inst_json(spark, sf_dir):
    return _inst(spark, sf_dir).select("id", text.inst_json(F.col("t")).alias("found"))


@_query(
    rf"""select id, case when json_exists(j, '$.thought_process') then json_extract_string(j, '$.thought_process') else 'none' end as thought_process,
 case when not json_exists(j, '$.predicted_label') or j is null then true_label when json_type(j, '$.predicted_label') in ('UBIGINT', 'BIGINT') then cast(json_extract_string(j, '$.predicted_label') as bigint) end as predicted_label
 from (select id, true_label, case when json_valid(x) then x end as j from (select id, true_label, regexp_replace(regexp_extract(split_part(t, '[/INST]', 2), '\{{.*\}}'), '^(\{{[^{{}}]*\}}).*', '\1') as x from ({_INST}) i) y) z"""
)
def inst_merge(spark, sf_dir):
    """JSON behind the instruction mark set over the record's own fields; a label of another type becomes null."""
    rows = _inst(spark, sf_dir).withColumn("thought_process", F.lit("none")).withColumn("predicted_label", F.col("true_label"))
    merged = prep.merge_json(rows, text.inst_json(F.col("t")), {"thought_process": "string", "predicted_label": "long"})
    return merged.select("id", "thought_process", "predicted_label")


@_query(f"select split, cast(count(*) as bigint) as n from (select 'train' as split from ({_PRED}) a union all select 'dev' from conversations) u group by split")
def concat_splits(spark, sf_dir):
    both = prep.concat_splits(train=predictions(spark, sf_dir).select("id"), dev=_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "role"))
    return both.groupBy("split").agg(F.count("*").alias("n"))


@_query(f"select id, concat('p', id) as premise, concat('h', id) as hypothesis from ({_INST}) i")
def prompt_fields(spark, sf_dir):
    t = F.col("t")
    return _inst(spark, sf_dir).select("id", text.premise_of(t).alias("premise"), text.hypothesis_of(t).alias("hypothesis"))


@_query("select conv_id, turn, case when instr(lower(text), 'step 3') > 0 then split_part(split_part(split_part(lower(text), 'step 3', 2), 'step 4', 1), chr(10) || chr(10), 1) end as section from (select conv_id, turn, concat(text, ' Step 3 so ', role, ' Step 4 end') as text from conversations) c")
def step3_section(spark, sf_dir):
    t = F.concat("text", F.lit(" Step 3 so "), "role", F.lit(" Step 4 end"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.step3_section(t).alias("section"))


#: Flat objects of an output, the first that gives a label, then phrases: the rules once more, in SQL. The two modes
#: differ in what a string and a number may be.
_TEXT = "case when v in ('0', 'no entailment') or {low} = 'false' then 0 when v in ('1', 'entailment') or {low} = 'true' then 1 when regexp_matches(v, '^\\s*[+-]?[0-9]+\\s*$') {more} then cast(trim(v) as bigint) end"
_READ = "case k when 'VARCHAR' then {text} when 'BOOLEAN' then case v when 'true' then 1 else 0 end when 'NULL' then null else {number} end"
_LOOSE = _READ.format(text=_TEXT.format(low="lower(v)", more=""), number="cast(trunc(try_cast(v as double)) as bigint)")
_STRICT = _READ.format(text=_TEXT.format(low="v", more="and cast(trim(v) as bigint) in (0, 1)"), number="case when try_cast(v as double) in (0, 1) then cast(try_cast(v as double) as bigint) end")
_SPANS = rf"""select id, n, case when json_exists(s, '$.predicted_label') then 'predicted_label' when json_exists(s, '$.label') then 'label' end as key,
 coalesce(json_type(s, '$.predicted_label'), json_type(s, '$.label')) as k, case when json_exists(s, '$.predicted_label') then json_extract_string(s, '$.predicted_label') else json_extract_string(s, '$.label') end as v
 from (select id, n, case when json_valid(s) then s end as s from (select id, unnest(regexp_extract_all(output, '\{{[^{{}}]*\}}')) as s, generate_subscripts(regexp_extract_all(output, '\{{[^{{}}]*\}}'), 1) as n from ({_OUTPUTS}) o) u) w"""
_FOUND = "select id, min_by(label, n) as label, min_by(key, n) as key from (select id, n, key, {read} as label from (" + _SPANS + ") p where key is not null) r where label is not null group by id"
_PHRASE = """case when contains(low, 'final label: 0') or contains(low, 'final prediction: 0') then 'explicit_label_0' when contains(low, 'final label: 1') or contains(low, 'final prediction: 1') then 'explicit_label_1'
 when contains(low, 'not entailed') or contains(low, 'no entailment') then 'conclusion_not_entailed' when contains(low, 'is entailed') or contains(low, 'entailment') then 'conclusion_entailed' else 'extraction_failure' end"""
_X = f"""select id, true_label, pred, output, cast(case when a.key is not null then a.label when phrase in ('explicit_label_0', 'conclusion_not_entailed') then 0 when phrase = 'extraction_failure' then -1 else 1 end as bigint) as label,
 coalesce('json_' || a.key, phrase) as method, cast(b.label as bigint) as strict_label, coalesce('json_' || b.key, 'extraction_failure') as strict_method
 from (select *, {_PHRASE} as phrase from (select *, lower(output) as low from ({_OUTPUTS}) o) l) m left join ({_FOUND.replace("{read}", _LOOSE)}) a using (id) left join ({_FOUND.replace("{read}", _STRICT)}) b using (id)"""


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs with both extractions, each worked out once."""
    out = F.col("output")
    df = outputs(spark, sf_dir).withColumn("x", extract.tracking(out, use_cot=True)).withColumn("s", extract.strict(out))
    return df.select("id", "true_label", "pred", "output", F.col("x.label").alias("label"), F.col("x.method").alias("method"), F.col("s.label").alias("strict_label"), F.col("s.method").alias("strict_method"))


@_query(f"select id, label from ({_X}) x")
def extract_standard(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", extract.standard(F.col("output"), use_cot=True).alias("label"))


@_query(f"select id, label, method, method <> 'extraction_failure' as ok from ({_X}) x")
def extract_tracking(spark, sf_dir):
    return outputs(spark, sf_dir).withColumn("x", extract.tracking(F.col("output"))).select("id", "x.label", "x.method", "x.ok")


@_query(f"select id, strict_label as label, strict_method as method, strict_label is not null as ok from ({_X}) x")
def extract_strict(spark, sf_dir):
    return outputs(spark, sf_dir).withColumn("x", extract.strict(F.col("output"))).select("id", "x.label", "x.method", "x.ok")


@_query(f"select id, case when label = -1 then 1 else label end as label from ({_X}) x")
def extract_default1(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", extract.with_default(F.col("output")).alias("label"))


@_query(f"select id, 'standard' as mode, label, cast(null as varchar) as method from ({_X}) x union all select id, 'tracking', label, method from ({_X}) x union all select id, 'strict', strict_label, strict_method from ({_X}) x")
def extract_by_mode(spark, sf_dir):
    out = F.col("output")
    modes = {"standard": {}, "tracking": {"track": True}, "strict": {"track": True, "strictly": True}}
    found = F.array(*(F.struct(F.lit(name).alias("mode"), extract.by_mode(out, **mode).alias("x")) for name, mode in modes.items()))
    return outputs(spark, sf_dir).select("id", F.explode(found).alias("r")).select("id", "r.mode", "r.x.label", "r.x.method")


@_query(f"select method, cast(row_number() over (order by method) as integer) as place from (select method from ({_X}) x union select strict_method from ({_X}) y) z")
def methods_by_name(spark, sf_dir):
    """Names of methods that any mode used, in the order of their names."""
    x = extracted(spark, sf_dir)
    return metrics.ordered_names(x.select("method").union(x.select("strict_method")), "method")


@_query(f"select id, cast(case id % 5 when 0 then pred when 1 then pred when 2 then 1 when 3 then 0 else -1 end as bigint) as label, case id % 5 when 2 then 'json_label' when 4 then 'extraction_failure' else 'json_predicted_label' end as method from ({_PRED}) p")
def extract_repeated_keys(spark, sf_dir):
    """Labels of objects that repeat keys, at the top and within other fields' values: numbers, texts, booleans, cut off
    numbers and null."""
    p = F.col("pred").cast("string")
    inner = F.lit('{"notes": {"x": 1, "x": [{"y": 1, "y": 2}]}, ')
    forms = (
        F.concat(inner, F.lit('"predicted_label": 5, "predicted_label": '), p, F.lit("}")), F.concat(inner, F.lit('"predicted_label": "'), p, F.lit('"}')),
        F.concat(inner, F.lit('"label": true}')), F.concat(inner, F.lit('"predicted_label": 0.7, "label": 1}')), F.concat(inner, F.lit('"predicted_label": null, "label": 1}')),
    )
    rows = predictions(spark, sf_dir).select("id", F.element_at(F.array(*forms), (F.col("id") % 5 + 1).cast("int")).alias("output"))
    return rows.select("id", extract.tracking(F.col("output")).alias("x")).select("id", "x.label", "x.method")


@_query(f"select method, cast(count(*) as bigint) as n, {_pct('count(*)', 'sum(count(*)) over ()')} as percent from ({_X}) x group by method")
def method_counts(spark, sf_dir):
    return metrics.shares(extracted(spark, sf_dir), "method")


@_query(f"select true_label, method, 0 as all_labels, cast(count(*) as bigint) as n from ({_X}) x group by 1, 2 union all select null, method, 1, cast(count(*) as bigint) from ({_X}) x group by method")
def methods_by_label(spark, sf_dir):
    return metrics.method_counts(extracted(spark, sf_dir), "method", "true_label")


@_query(f"select true_label, method, cast(count(*) as bigint) as n, {_pct('count(*)', 'sum(count(*)) over (partition by true_label)')} as percent from ({_X}) x group by 1, 2")
def method_shares_by_label(spark, sf_dir):
    """How often each method found the label, in percent of the rows of each true label."""
    return metrics.shares(extracted(spark, sf_dir), "true_label", "method", within=("true_label",))


@_query(f"select method, cast(count(*) as bigint) as n, cast(row_number() over (order by count(*) desc, method) as integer) as place from ({_X}) x group by method")
def methods_ranked(spark, sf_dir):
    from pyspark.sql import Window

    n = metrics.method_counts(extracted(spark, sf_dir))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "method")))


_CHANGES = "cast(count(*) filter (where pred is distinct from {x}) as bigint) as changed, cast(count(*) filter (where pred = 0 and {x} = 1) as bigint) as changed_0_to_1, cast(count(*) filter (where pred = 1 and {x} = 0) as bigint) as changed_1_to_0"


@_query(f"select {_CHANGES.format(x='strict_label')} from ({_X}) x")
def prediction_changes(spark, sf_dir):
    return metrics.prediction_changes(extracted(spark, sf_dir), "pred", "strict_label")


@_query(
    f"""select total_samples, success, failure, {_pct('success', 'total_samples')} as success_rate, {_pct('oc', 'total_samples')} as original_accuracy, {_pct('nc', 'total_samples')} as new_accuracy, {_pct('nc', 'success')} as strict_accuracy from
 (select cast(count(*) as bigint) as total_samples, cast(count(output) filter (where strict_label is not null) as bigint) as success, cast(count(output) filter (where strict_label is null) as bigint) as failure,
 count(*) filter (where pred = true_label) as oc, count(*) filter (where strict_label = true_label) as nc from ({_X}) x) z"""
)
def extraction_rates(spark, sf_dir):
    return metrics.extraction_rates(extracted(spark, sf_dir), old="pred", new="strict_label")


@_query(f"select {_BUCKET} as bucket, label, cast(count(*) as bigint) as n, {_pct('count(*)', f'sum(count(*)) over (partition by {_BUCKET})')} as percent from ({_LENGTHS}) x group by 1, 2")
def prediction_share_by_bucket(spark, sf_dir):
    rows = lengths(spark, sf_dir).select(text.fixed_bucket(F.col("tokens")).alias("bucket"), "label")
    return metrics.shares(rows, "bucket", "label", within=("bucket",))


@_query(f"select method, cast(count(*) filter (where m = 'standard') as bigint) as standard, cast(count(*) filter (where m = 'strict') as bigint) as strict from (select method, 'standard' as m from ({_X}) x union all select strict_method, 'strict' from ({_X}) y) z group by method")
def model_compare(spark, sf_dir):
    x = extracted(spark, sf_dir)
    both = F.array(F.struct(F.lit("standard").alias("model"), F.col("method").alias("m")), F.struct(F.lit("strict").alias("model"), F.col("strict_method").alias("m")))
    return metrics.compare_methods(x.select(F.explode(both).alias("r")).select("r.model", F.col("r.m").alias("method")), ["standard", "strict"])


_CLASS_OF = "select k, cast(count(*) filter (where {x} = k) as double) as n_pred, cast(count(*) filter (where true_label = k) as double) as n_true, cast(count(*) filter (where {x} = k and true_label = k) as double) as tp from ({X}) x, (select distinct true_label as k from ({X}) q union select distinct {x} from ({X}) q) c where {x} is not null and {x} <> -1 and k is not null and k <> -1 group by k"
_F1 = "select round(avg(" + _ratio("2 * " + _ratio("tp", "n_pred") + " * " + _ratio("tp", "n_true"), _ratio("tp", "n_pred") + " + " + _ratio("tp", "n_true")) + "), 10) from (" + _CLASS_OF + ") c where n_pred + n_true > 0"
_MODEL = "select '{m}' as model, {acc} as accuracy, {fail} as failure_rate, {sacc} as strict_accuracy, {f1} as macro_f1 from (select count(*) as n, count(*) filter (where {x} = true_label) as c, count(*) filter (where {x} is null or {x} = -1) as f from ({X}) x) z"


@_query(
    _MODEL.format(m="standard", acc=_pct("c", "n"), fail=_pct("f", "n"), sacc="cast(null as double)", x="label", X=_X, f1="(" + _F1.format(x="label", X=_X) + ")")
    + " union all "
    + _MODEL.format(m="strict", acc=_pct("c", "n"), fail=_pct("f", "n"), sacc=_pct("c", "n - f"), x="strict_label", X=_X, f1="(" + _F1.format(x="strict_label", X=_X) + ")")
    + " union all select 'prior', "
    + _pct("count(*) filter (where pred = true_label)", "count(*)")
    + f", cast(null as double), cast(null as double), cast(null as double) from ({_PRED}) p"
)
def model_table(spark, sf_dir):
    """Models with the columns that each has; one that no model has is left out."""
    x = extracted(spark, sf_dir)

    def row(c: str, *without: str) -> DataFrame:
        r = metrics.extraction_rates(x, old="pred", new=c)
        r = r.select(F.col("new_accuracy").alias("accuracy"), metrics.percent(F.col("failure"), F.col("total_samples")).alias("failure_rate"), "strict_accuracy")
        f1 = metrics.macro_metrics(x.filter(F.col(c) != -1), "true_label", c).select(F.round("f1_score", 10).alias("macro_f1"))
        return r.crossJoin(F.broadcast(f1)).drop(*without)

    prior = metrics.extraction_rates(x, old="pred", new="label").select(F.col("original_accuracy").alias("accuracy"))
    return metrics.compare_models(standard=row("label", "strict_accuracy"), strict=row("strict_label"), prior=prior)


#: Responses to validate, twelve kinds by id.
_RESPONSES = """select doc_id as id, case doc_id % 12
 when 0 then concat('Sure: {"thought_process": "T', doc_id, '", "predicted_label": 1}')
 when 1 then '{"thought_process": "t", "label": "0"}'
 when 2 then '{"thought_process": "t", "predicted_label": 3}'
 when 3 then '{"predicted_label": 1}'
 when 4 then 'no json at all'
 when 5 then '{"score": 4, "predicted_label": 1, "improved_thought_process": "i", "error_analysis": "e"}'
 when 6 then '{"score": "4", "predicted_label": 0, "improved_thought_process": "i", "error_analysis": "e"}'
 when 7 then '{"score": 9, "predicted_label": "1", "improved_thought_process": "i", "error_analysis": "e"}'
 when 8 then '{"thought_process": "t", "predicted_label": "Yes", "score": 2.0, "improved_thought_process": 7}'
 when 9 then '{"thought_process": null, "predicted_label": true, "score": 0, "improved_thought_process": "i"}'
 when 10 then '[{"thought_process": "t", "predicted_label": 0.5, "error_analysis": "e", "improved_thought_process": "i"}]'
 else concat('{"thought_process": "t", "predicted_label": ', doc_id % 2, ', "error_analysis": "e", "improved_thought_process": "i", "score": 2.5}') end as response from labels"""


def _validated(spark, sf_dir, shape):
    rows = _views(spark, sf_dir, _RESPONSES, "labels").withColumn("v", validate.validate(F.col("response"), shape))
    return rows.select("id", "v.valid", "v.error_kind", "v.label", "v.score")


def _verdict_sql(texts: tuple[str, ...], score: bool, coerce: bool, alias: bool, keys_first: bool) -> str:
    """The rules of a shape in SQL, over the cleaned response."""
    clean = "case when instr(t, '{') > 0 and instr(t, '}') > 0 then substr(t, instr(t, '{'), length(t) - instr(reverse(t), '}') + 2 - instr(t, '{')) else t end"
    rows = f"select id, case when json_valid(c) and left(c, 1) = '{{' then c end as j from (select id, {clean} as c from (select id, replace(lower(response), chr(10), '') as t from ({_RESPONSES}) r) q) w"
    label = "case when json_exists(j, '$.predicted_label') then '$.predicted_label' else '$.label' end" if alias else "'$.predicted_label'"
    raw = f"select id, j, json_type(j, {label}) as kl, json_extract_string(j, {label}) as vl, json_type(j, '$.score') as ks, json_extract_string(j, '$.score') as vs from ({rows}) x"
    whole = lambda k, v, most: f"case when {k} = 'BOOLEAN' then case {v} when 'true' then 1 else 0 end when {k} in ('UBIGINT', 'BIGINT', 'DOUBLE') and cast({v} as double) = floor(cast({v} as double)) and cast({v} as double) between 0 and {most} then cast(cast({v} as double) as integer) end"
    own = whole("kl", "vl", 1)
    if coerce:
        own = f"case when kl = 'VARCHAR' and vl in ('0', '1') then cast(vl as integer) else {own} end"
    read = f"select *, {own} as label, {whole('ks', 'vs', 5) if score else 'cast(null as integer)'} as score from ({raw}) y"
    error = "when j is null then 'json' "
    if keys_first:
        error += "".join(f"when not json_exists(j, '$.{k}') then 'keys' " for k in ("predicted_label", *texts))
    error += "when kl = 'VARCHAR' and label is null then 'label' "
    error += "when ks = 'VARCHAR' then 'score' " if score else ""
    error += "when label is null then 'label' "
    error += "when score is null then 'score' " if score else ""
    error += "".join(f"when coalesce(json_type(j, '$.{k}'), '') <> 'VARCHAR' then '{'thought' if score else 'json'}' " for k in texts)
    return f"select id, e is null as valid, e as error_kind, case when e is null then cast(label as integer) end as label, case when e is null then cast(score as integer) end as score from (select *, case {error} end as e from ({read}) z) v"


_NLI = _verdict_sql(("thought_process",), False, True, True, False)


@_query(_NLI)
def validate_nli(spark, sf_dir):
    return _validated(spark, sf_dir, validate.NLI)


@_query(_verdict_sql(("improved_thought_process",), True, False, True, False))
def validate_score(spark, sf_dir):
    return _validated(spark, sf_dir, validate.SCORE)


@_query(_verdict_sql(("error_analysis", "improved_thought_process"), False, True, False, True))
def validate_reflection(spark, sf_dir):
    return _validated(spark, sf_dir, validate.REFLECTION)


@_query(
    f"""select id, case error_kind when 'label' then concat('The label ', chr(39), regexp_extract(response, '"predicted_label": "?([^",}}]*)"?', 1), chr(39), ' is not valid. Answer again with 0 or 1 as the label and nothing else.')
 when 'json' then 'The reply was not a valid JSON object. Answer again in exactly this form: {{}}' end as message from ({_NLI}) v join ({_RESPONSES}) r using (id)"""
)
def reprompt_message(spark, sf_dir):
    from ..operators.backends import checked

    rows = checked(_views(spark, sf_dir, _RESPONSES, "labels"), "response", validate.NLI)
    value = F.regexp_extract("response", '"predicted_label": "?([^",}]*)"?', 1)
    return rows.select("id", validate.reprompt(F.col("checked.error_kind"), value, "{}").alias("message"))


#: Thoughts with a three-valued `correct`, and reflections of the wrong ones.
_THOUGHTS = f"select id, concat('p', id) as premise, concat('h', id) as hypothesis, concat('t', id) as thought_process, cast(case when id % 13 = 0 then 'x' else cast(pred as varchar) end as varchar) as predicted_label, cast(true_label as bigint) as true_label, case when id % 9 = 0 then null else pred = true_label end as correct from ({_PRED}) p"


def thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, _THOUGHTS.replace("varchar", "string"), "labels")


def _reflected(t: DataFrame) -> DataFrame:
    return prep.split_correct(t)[1].withColumn("improved_thought_process", F.concat(F.lit("better "), "thought_process"))


_SFT = f"""select id, premise, hypothesis, thought_process, cast(predicted_label as integer) as label, 0 as source_rank from ({_THOUGHTS}) t where correct and predicted_label <> 'x'
 union all select id, premise, hypothesis, concat('better ', thought_process), cast(true_label as integer), 1 from ({_THOUGHTS}) t where not correct"""


@_query(_SFT)
def sft_prepare(spark, sf_dir):
    t = thoughts(spark, sf_dir)
    return prep.sft_union(prep.originals(t), prep.reflections(_reflected(t))).drop("correct")


@_query(
    f"""select id, concat('<s>[INST] Premise: ', premise, chr(10), 'Hypothesis: ', hypothesis, chr(10), chr(10), '{templates.TASK}', ' [/INST] {{"thought_process": "', thought_process, '", "predicted_label": ', label, '}} </s>') as text, source_rank from ({_SFT}) s"""
)
def sft_text(spark, sf_dir):
    s = sft_prepare(spark, sf_dir)
    return s.select("id", templates.sft_text(F.col("premise"), F.col("hypothesis"), F.col("thought_process"), F.col("label")).alias("text"), "source_rank")


@_query(f"select conv_id, turn, concat('[INST] Premise: ', text, chr(10), 'Hypothesis: ', role, chr(10), chr(10), '{templates.TASK}', ' [/INST]') as prompt from conversations")
def inference_prompt(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", templates.inference_prompt(F.col("text"), F.col("role")).alias("prompt"))


@_query(f"select case when correct then 'right' when not correct then 'wrong' end as side, cast(count(*) as bigint) as n from ({_THOUGHTS}) t where correct is not null group by 1")
def correct_split(spark, sf_dir):
    right, wrong = prep.split_correct(thoughts(spark, sf_dir))
    both = right.select(F.lit("right").alias("side")).union(wrong.select(F.lit("wrong").alias("side")))
    return both.groupBy("side").agg(F.count("*").alias("n"))


@_query(f"select id, thought_process as thought, predicted_label as prediction, coalesce(predicted_label, cast(true_label as varchar)) as label_of_row from ({_THOUGHTS}) t")
def alias_columns(spark, sf_dir):
    t = thoughts(spark, sf_dir).drop("thought_process").withColumn("improved_thought_process", F.concat(F.lit("t"), "id")).withColumn("initial_thought", F.lit("no"))
    t = prep.table_alias(prep.table_alias(t, prep.THOUGHT_NAMES, "thought"), prep.LABEL_NAMES, "prediction")
    t = t.withColumn("true_label", F.col("true_label").cast("string"))
    return t.select("id", "thought", "prediction", prep.row_alias(t, "label", "predicted_label", "true_label").alias("label_of_row"))


@_query(f"select id, cast(case when predicted_label in ('0', '1') then predicted_label end as integer) as label, correct is not null and predicted_label <> 'x' as usable from ({_THOUGHTS}) t")
def label_coerce(spark, sf_dir):
    t = thoughts(spark, sf_dir)
    label = prep.coerce_label(F.col("predicted_label"), t.schema["predicted_label"].dataType)
    return t.select("id", label.alias("label"), (F.col("correct").isNotNull() & label.isNotNull()).alias("usable"))


@_query(
    """select doc_id as id, case when quality = 1 then 1 else 0 end as from_whole, case doc_id % 4 when 0 then 0 when 1 then 1 when 2 then null else 0 end as from_number, case when doc_id % 3 = 0 then null when toxic = 1 then 1 else 0 end as from_boolean,
 case doc_id % 5 when 0 then 0 when 1 then 1 when 2 then null when 3 then null else 1 end as from_text from labels"""
)
def label_kinds(spark, sf_dir):
    """Labels of all kinds as 0 or 1: whole numbers, numbers cut off, booleans, and texts; nulls and others are null."""
    i = F.col("doc_id")
    number = F.when(i % 4 == 0, 0.9).when(i % 4 == 1, 1.2).when(i % 4 == 2, 2.0).otherwise(-0.5)
    words = F.element_at(F.array(*map(F.lit, (" 0", "1", "yes", "1.0", "+1 "))), (i % 5 + 1).cast("int"))
    boolean = F.when(i % 3 != 0, F.col("toxic") == 1)
    kinds = {"from_whole": (F.col("quality"), T.LongType()), "from_number": (number, T.DoubleType()), "from_boolean": (boolean, T.BooleanType()), "from_text": (words, T.StringType())}
    return _table(spark, sf_dir, "labels").select(i.alias("id"), *(prep.coerce_label(c, kind).alias(name) for name, (c, kind) in kinds.items()))


@_query(f"select id, coalesce(cast(predicted_label as varchar) = cast(true_label as varchar), correct, false) as right_one from (select id, true_label, correct, case when predicted_label = 'x' then null else predicted_label end as predicted_label from ({_THOUGHTS}) q) t")
def correctness(spark, sf_dir):
    t = thoughts(spark, sf_dir)
    pred = F.when(F.col("predicted_label") != "x", F.col("predicted_label").try_cast("long"))
    return t.select("id", prep.correctness(pred, F.col("true_label"), F.col("correct")).alias("right_one"))


@_query(f"select id, case when id % 9 = 0 then 'missing: correct' end as error_info from ({_THOUGHTS}) t")
def missing_fields(spark, sf_dir):
    return prep.missing_fields(thoughts(spark, sf_dir), "premise", "correct").select("id", "error_info")


@_query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id) as rn from events) e where rn = 1")
def dedup_keep_first(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").withColumn("line", F.col("event_id"))
    return prep.keep_first(e, "user_id", "line").drop("line")


@_query("select doc_id, lang from documents order by doc_id limit 40 offset 25")
def slice(spark, sf_dir):  # noqa: A001  the operator's name
    return prep.row_slice(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 25, 65)


_CHUNK = f"select id, pred, true_label, cast(floor((row_number() over (order by id) - 1) / greatest(ceil(count(*) over () / 4.0), 1)) as integer) as worker_id from ({_PRED}) p"


@_query(f"select id, worker_id from ({_CHUNK}) c")
def worker_chunks(spark, sf_dir):
    return prep.worker_chunks(predictions(spark, sf_dir), "id", 4).select("id", "worker_id")


@_query(f"select worker_id, cast(count(*) as bigint) as output_count, cast(count(*) filter (where pred = true_label) as bigint) as correct_count, {_pct('count(*) filter (where pred = true_label)', 'count(*)')} as accuracy from ({_CHUNK}) c group by rollup(worker_id)")
def partial_final_rollup(spark, sf_dir):
    return metrics.worker_report(prep.worker_chunks(predictions(spark, sf_dir), "id", 4), "true_label", "pred")


@_query("select doc_id, cast(row_number() over (order by doc_id) as bigint) as id from documents")
def row_ids(spark, sf_dir):
    return prep.with_row_id(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", first=1)


_EVENTS = "select user_id as run, event_id, row_number() over (partition by user_id order by ts, event_id) as step, cast(value as double) as loss, event_type from events"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, _EVENTS, "events")


@_query(
    f"""select run, event_id, round((select avg(cast(b.loss as decimal(30,8))) from e b where b.run = a.run and b.step between a.step - a.w + 1 and a.step), 6) as rolling from
 (select *, greatest(1, cast(floor(count(*) over (partition by run) / 10) as bigint)) as w from ({_EVENTS}) q) a""".replace("from e b", f"from ({_EVENTS}) b")
)
def rolling_loss(spark, sf_dir):
    out = series.rolling_mean(runs(spark, sf_dir), "run", "step", "loss")
    return out.select("run", "event_id", F.round("rolling", 6).alias("rolling"))


@_query(f"select run, cast(step as integer) as step, loss as value from (select *, row_number() over (partition by run order by loss, step) as rn from ({_EVENTS}) e where loss is not null) r where rn = 1")
def best_step(spark, sf_dir):
    return series.best_step(runs(spark, sf_dir), "run", "step", "loss")


@_query(f"select run, cast(step as integer) as step, {_pct('sum(case when event_type = ' + chr(39) + 'click' + chr(39) + ' then 1 else 0 end) over w', 'count(*) over w')} as accuracy_so_far from ({_EVENTS}) e window w as (partition by run order by step rows unbounded preceding)")
def progress(spark, sf_dir):
    e = runs(spark, sf_dir).withColumn("hit", F.col("event_type") == "click")
    return series.progress(e, "run", "step", "hit").select("run", "step", "accuracy_so_far")


_RUNS = "select cast(user_id as varchar) as id, case when user_id % 3 = 0 then 'failed' else 'finished' end as state, cast(max(ts) as varchar) as created_at from events group by user_id"


@_query(f"select id, created_at from ({_RUNS}) r where state = 'finished' order by created_at desc, id limit 3")
def latest_runs(spark, sf_dir):
    return series.latest_runs(_views(spark, sf_dir, _RUNS.replace("varchar", "string"), "events")).select("id", "created_at")


@_query(f"select run, cast(step as integer) as step, case when max(loss) over (partition by run) <= 1.0 then loss * 100 else loss end as loss from (select run, step, case when run % 2 = 0 then loss / 1000000.0 else loss end as loss from ({_EVENTS}) e) r")
def percent_rescale(spark, sf_dir):
    e = runs(spark, sf_dir).withColumn("loss", F.expr("case when run % 2 = 0 then loss / 1000000.0D else loss end"))
    return series.as_percent(e, "run", "loss").select("run", "step", "loss")


@_query(f"select run, cast(count(*) as bigint) as n from ({_EVENTS}) e where loss is not null and not isnan(loss) group by run")
def series_without_gaps(spark, sf_dir):
    return series.drop_gaps(runs(spark, sf_dir), "loss").groupBy("run").agg(F.count("*").alias("n"))


@_query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume_anti_join(spark, sf_dir):
    return prep.not_done(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), "doc_id")


@_query("select doc_id % 10 as attempt, least(cast(pow(2, doc_id % 10) as bigint), 60) as seconds, cast(count(*) as bigint) as n from documents group by 1, 2")
def backoff(spark, sf_dir):
    from ..operators.backends import backoff_seconds

    a = (F.col("doc_id") % 10).alias("attempt")
    return _table(spark, sf_dir, "documents").groupBy(a).agg(F.count("*").alias("n")).select("attempt", backoff_seconds(F.col("attempt")).alias("seconds"), "n")


def _echo():
    """A backend that answers from the id in the prompt, invalid at first for every fourth."""
    import json

    from ..operators.backends import StubBackend

    def reply(messages):
        n = int(messages[0]["content"].split()[-1])
        if n % 4 == 0 and len(messages) < 3:
            return "let me think"
        return json.dumps({"thought_process": f"t{n}", "predicted_label": n % 2, "error_analysis": f"e{n}", "improved_thought_process": f"i{n}"})

    return StubBackend(reply)


@_query("select doc_id as id, cast(doc_id % 2 as integer) as predicted_label, concat('t', doc_id) as thought_process, case when doc_id % 4 = 0 then 1 else 0 end as reprompt_counts from documents")
def generate_stub(spark, sf_dir):
    from ..operators.backends import generate

    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return generate(docs, _echo, F.concat(F.lit("item "), "id")).select("id", "predicted_label", "thought_process", "reprompt_counts")


@_query(f"select id, cast(id % 2 as integer) as predicted_label, concat('i', id) as improved_thought_process, concat('e', id) as error_analysis from ({_THOUGHTS}) t where not correct")
def reflect_stub(spark, sf_dir):
    from ..operators.backends import reflect

    wrong = prep.split_correct(thoughts(spark, sf_dir))[1]
    return reflect(wrong, _echo, F.concat(F.lit("item "), "id")).select("id", "predicted_label", "improved_thought_process", "error_analysis")


@_query(f"select case when id % 3 = 0 then null when id % 3 = 1 then cast(id % 10 as bigint) else id end as id, case when id % 4 = 0 then cast(7 as integer) else cast(id % 2 as integer) end as predicted_label, case when id % 4 <> 0 then concat('i', id) end as improved_thought_process, id % 4 = 0 as failed from ({_PRED}) p")
def reflect_every_row(spark, sf_dir):
    """Rows without an id and rows that share one: each comes back once, those whose reply stays invalid with the label that
    they brought along."""
    from ..operators.backends import reflect

    rows = predictions(spark, sf_dir).select("id").withColumn("n", F.col("id"))
    rows = rows.withColumn("id", F.when(F.col("n") % 3 == 0, None).when(F.col("n") % 3 == 1, F.col("n") % 10).otherwise(F.col("n")))
    got = reflect(rows.withColumn("true_label", F.lit(7)), _silent, F.concat(F.lit("item "), "n"), retries=1)
    return got.select("id", "predicted_label", "improved_thought_process", F.col("error_info").isNotNull().alias("failed"))


def _silent():
    """As _echo, but every fourth never answers validly."""
    import json

    from ..operators.backends import StubBackend

    def reply(messages):
        n = int(messages[0]["content"].split()[-1])
        return "let me think" if n % 4 == 0 else json.dumps({"predicted_label": n % 2, "error_analysis": f"e{n}", "improved_thought_process": f"i{n}"})

    return StubBackend(reply)


def _picky():
    """A backend of which some rows need another model, some several rounds, and some never satisfy."""
    import json

    class Picky:
        def generate(self, messages, model, **options):
            n, round_ = map(int, messages[0]["content"].split()[-2:])
            kind = n % 6
            if (kind, model) not in ((0, model), (1, "mid"), (2, "big"), (3, model), (4, model)):
                return "no idea"
            score = {0: 5, 1: 4, 2: 4, 3: 4 if round_ == 2 else 1, 4: round_ % 4}[kind]
            return json.dumps({"score": score, "predicted_label": n % 2, "improved_thought_process": str(round_ + 1)})

    return Picky()


@_query(
    """select doc_id as id, case doc_id % 6 when 0 then 'base' when 1 then 'base base base base base mid' when 2 then 'base base base base base mid mid mid big' when 3 then 'base mid mid' when 4 then 'base mid mid mid mid'
 else 'base base base base base mid mid mid big big big mid' end as models, case doc_id % 6 when 4 then 'low' when 5 then 'failed' else 'done' end as status, cast(case doc_id % 6 when 3 then 2 when 4 then 4 else 0 end as integer) as depth,
 cast(case doc_id % 6 when 0 then 5 when 4 then 0 when 5 then null else 4 end as integer) as score, cast(case doc_id % 6 when 1 then 5 when 2 then 8 when 5 then 12 else 0 end as integer) as reprompts from labels"""
)
def attempt_models(spark, sf_dir):
    """The model of each attempt at each row, and how it ended: replies stay invalid until the model is changed, are scored
    low until the thought was improved twice, or never do."""
    from ..operators import attempts

    rows = predictions(spark, sf_dir).select("id").withColumn("thought", F.lit("0"))
    prompt = lambda thought: F.concat_ws(" ", F.lit("rate"), F.col("id"), thought)
    policy = attempts.Policy(retries=4, sixth="mid", ninth="big", again="mid")
    got = attempts.run(rows, _picky, prompt, validate.SCORE, "base", thought="thought", policy=policy, at_once=4)
    return got.select("id", F.array_join("attempt.models", " ").alias("models"), "attempt.status", "attempt.depth", "attempt.score", "attempt.reprompts")


@_query(
    """select doc_id as id, lang, concat('t', doc_id) as thought_process, cast(doc_id % 2 as integer) as predicted_label, doc_id % 2 = n_chars % 2 as correct, cast(case when doc_id % 4 = 0 then 1 else 0 end as integer) as reprompt_counts,
 case when doc_id % 4 = 0 then 'user assistant user assistant' else 'user assistant' end as roles from documents"""
)
def generation_records(spark, sf_dir):
    """Generations with the row's own columns and the conversation that led to them."""
    from ..operators import attempts

    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", (F.col("n_chars") % 2).alias("true_label"))
    got = attempts.run(docs, _echo, lambda _: F.concat(F.lit("item "), "id"), validate.NLI, "base")
    records = attempts.generation_record(got)
    return records.withColumn("roles", F.array_join(F.transform("chat_history", lambda m: m["role"]), " ")).select("id", "lang", "thought_process", "predicted_label", "correct", "reprompt_counts", "roles")


def _judge():
    """A backend that scores the number in the prompt, two more in each round."""
    import json

    from ..operators.backends import StubBackend

    def reply(messages):
        n, k = map(int, messages[0]["content"].split()[-2:])
        return json.dumps({"score": min(n + 2 * k, 5), "predicted_label": n % 2, "improved_thought_process": f"i{n}"})

    return StubBackend(reply)


@_query(f"select id, cast(least(score + 2 * r, 5) as integer) as score, r as round, case when score + 2 * r >= 4 then 'gold' else 'low' end as tier from (select id, score, case when score >= 4 then 0 when score >= 2 then 1 else 2 end as r from ({_PRED}) p) q")
def score_rounds(spark, sf_dir):
    from ..operators import backends

    def once(df, k):
        prompt = F.concat(F.lit("rate "), F.col("first").cast("string"), F.lit(f" {k}"))
        got = backends.run_backend(df, _judge, prompt, "base", validate.SCORE.texts, score=True)
        return df.join(got.select("id", "score"), "id")

    got = backends.score_rounds(predictions(spark, sf_dir).select("id", F.col("score").alias("first")), once)
    return got.select("id", "score", "round", "tier")


@_query("select conv_id, cast(turn as bigint) as turn, role from conversations")
def stream_resume(spark, sf_dir):
    """All turns through the resumable stream, run twice: the second run finds nothing new."""
    from ..sources.log import AppendLog
    from ..streaming import resume

    folder, source = resume.work_folder(spark, "stream"), f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(source).schema
    step = lambda df: df.select("conv_id", "turn", "role")
    for _ in range(2):
        resume.process_new_files(spark, source + "*", schema, step, f"{folder}/out", f"{folder}/mark", file_format="parquet")
    kept = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string")
    return AppendLog(spark, f"{folder}/out", kept).read()
