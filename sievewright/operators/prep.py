"""Preparation: ids, aliases, coercions, filters, dedup, slices, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored, unused
from .scan import numbered


def _in_order(df: DataFrame, key: str) -> list[Column]:
    """By the key, nulls first; rows of an equal key by their content, so that they can fill several ranges."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return [F.col(f"`{key}`").asc_nulls_first(), F.xxhash64(*(F.col(f"`{c}`") for c in plain or [key]))]


def with_row_id(df: DataFrame, key: str, first: int = 0, name: str = "id") -> DataFrame:
    """Number rows by a key from `first` on, nulls first, keeping ids that are there. All other columns stay."""
    (place,) = unused(df, "_place")
    out = numbered(df, place, _in_order(df, key))
    at = F.col(place) + F.lit(first)
    return out.withColumn(name, F.coalesce(F.col(name), at) if name in df.columns else at).drop(place)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


#: Alternative names in order of precedence.
THOUGHT_NAMES = ("thought_process", "improved_thought_process", "initial_thought")
LABEL_NAMES = ("predicted_label", "label", "prediction", "initial_label")


def table_alias(df: DataFrame, names: tuple[str, ...], to: str) -> DataFrame:
    """The first of the names that is a column serves the whole table, null or not."""
    found = next((c for c in names if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {', '.join(names)} is a column")
    return df.withColumn(to, F.col(found))


def row_alias(df: DataFrame, *names: str) -> Column:
    """The first value that isn't null, row by row, among the columns that exist."""
    return F.coalesce(*(F.col(c) for c in names if c in df.columns))


def coerce_label(label: Column, kind: T.DataType) -> Column:
    """0 or 1 from a string of digits, a number (cut off) or a boolean; null else."""
    if isinstance(kind, T.StringType):
        value = F.when(label.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(label).try_cast("int"))
    elif isinstance(kind, T.BooleanType):
        value = label.cast("int")
    else:
        value = label.try_cast("double").try_cast("int")
    return F.when(value.isin(0, 1), value)


def split_correct(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows known to be right, and rows known to be wrong; unknown ones are in neither."""
    return df.filter("correct"), df.filter("not correct")


def correctness(predicted: Column, true: Column, stored: Column) -> Column:
    return F.coalesce(predicted == true, stored, F.lit(False))


def originals(df: DataFrame, label_kind: T.DataType | None = None) -> DataFrame:
    """Usable thoughts as (id, premise, hypothesis, thought_process, label, correct)."""
    label = row_alias(df, "predicted_label", "label")
    kind = label_kind or df.select(label.alias("x")).schema["x"].dataType
    out = df.withColumn("label", coerce_label(label, kind)).dropna(subset=["premise", "hypothesis", "thought_process", "label"])
    return out.select("id", "premise", "hypothesis", "thought_process", "label", "correct")


def reflections(df: DataFrame) -> DataFrame:
    """Usable reflections in the shape of originals: the improved thought, the true label, no correctness."""
    label = coerce_label(F.col("true_label"), df.schema["true_label"].dataType)
    out = df.withColumn("label", label).withColumn("thought_process", F.col("improved_thought_process"))
    out = out.dropna(subset=["premise", "hypothesis", "thought_process", "label"])
    return out.select("id", "premise", "hypothesis", "thought_process", "label", F.lit(None).cast("boolean").alias("correct"))


def sft_union(thoughts: DataFrame, reflected: DataFrame) -> DataFrame:
    """Right originals, then reflections; duplicates stay. source_rank keeps the order."""
    right, _ = split_correct(thoughts)
    return right.withColumn("source_rank", F.lit(0)).unionByName(reflected.withColumn("source_rank", F.lit(1)))


def missing_fields(df: DataFrame, *fields: str) -> DataFrame:
    """Add error_info: the names of fields that are null, or null if none is."""
    names = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in fields))
    return df.withColumn("error_info", F.when(names != "", F.concat(F.lit("missing: "), names)))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in ingestion order: an aggregation with map-side combine, no window."""
    rest = [c for c in df.columns if c != key]
    (row,) = unused(df, "_row")
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias(row))
    return best.select(*(F.col(key) if c == key else F.col(f"{row}.{c}").alias(c) for c in df.columns))


def row_slice(df: DataFrame, key: str, start: int, end: int | None = None) -> DataFrame:
    """Rows [start, end) in key order, nulls first; which of equal keys fall on either side of a border is open.

    The key column alone is numbered, by ranges, to find the keys at both borders; then only the rows between them are
    numbered with all their columns. So a slice far in costs no task more than its own range.
    """
    (place,) = unused(df, "_place")
    only = df.select(key)
    keys, at = stored(numbered(only, place, _in_order(only, key)), "places"), F.col(place)
    wanted = [start] if end is None else [start, max(start, end - 1)]
    borders = {r[place]: r[key] for r in keys.filter(at.isin(wanted)).collect()}
    if start not in borders or (end is not None and end <= start):
        return df.limit(0)
    low, first = borders[start], F.col(key)
    inside = F.lit(True) if low is None else first >= low
    if end is not None and end - 1 in borders:
        high = borders[end - 1]
        inside = inside & (first.isNull() if high is None else (first.isNull() | (first <= high)))
    before = keys.filter(first.eqNullSafe(F.lit(low))).agg(F.min(place)).first()[0]
    at = at + before
    return numbered(df.filter(inside), place, _in_order(df, key)).filter((at >= start) if end is None else (at >= start) & (at < end)).orderBy(place).drop(place)


def worker_chunks(df: DataFrame, key: str, workers: int) -> DataFrame:
    """Contiguous chunks of ceil(n / workers) rows in key order, as worker_id from 0."""
    place, total = unused(df, "_place", "_total")
    rows = numbered(df, place, _in_order(df, key), total=total)
    size = F.greatest(F.ceil(F.col(total) / workers), F.lit(1))
    return rows.withColumn("worker_id", F.floor(F.col(place) / size).cast("int")).drop(place, total)


def concat_splits(**splits: DataFrame) -> DataFrame:
    """All rows of the splits with a column split; a column that a split lacks is null there, one of that name an error."""
    out = None
    for name, df in splits.items():
        if "split" in (c.lower() for c in df.columns):
            raise ValueError(f"{name} has a column split already")
        df = df.withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not processed yet."""
    return df.join(done.select(key), key, "left_anti")


def output_name(model: str, data: str, labelled: bool) -> str:
    """The name of a run's results: model-data-labelled, of the last parts of both paths, the data's without its ending."""
    last = lambda path: path.rstrip("/").rsplit("/", 1)[-1]
    return f"{last(model)}-{last(data).rsplit('.', 1)[0]}-{'labelled' if labelled else 'unlabelled'}"


def output_names(model: Column, data: Column, labelled: Column) -> Column:
    """output_name as an expression over rows."""
    last = lambda path: F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    return F.concat_ws("-", last(model), F.regexp_replace(last(data), r"\.[^.]*$", ""), F.when(labelled, "labelled").otherwise("unlabelled"))


#: Fixed value: metadata that a result document keeps.
METADATA = ("model", "inference_time_seconds", "samples_per_second", "use_cot")


def metadata_columns(df: DataFrame) -> DataFrame:
    """The metadata columns that are there."""
    return df.select(*(c for c in METADATA if c in df.columns))


def merge_json(df: DataFrame, found: Column, kinds: dict[str, str]) -> DataFrame:
    """Set keys of a JSON text over the columns of the same names; what the text lacks stays. kinds: type by key.

    A value that can't be read as its type is null, as JSON null is: the text has the key, so the old value goes.
    """
    parsed = F.from_json(found, ", ".join(f"{k} {v}" for k, v in kinds.items()), {"allowSingleQuotes": "false"})
    keys = F.map_keys(F.from_json(found, "map<string, string>", {"allowSingleQuotes": "false"}))
    json, has_key = unused(df, "_json", "_keys")
    out = df.withColumn(json, parsed).withColumn(has_key, keys)
    for k, v in kinds.items():
        new, has = F.col(f"{json}.{k}"), F.coalesce(F.array_contains(has_key, k), F.lit(False))
        out = out.withColumn(k, F.when(has, new).otherwise(F.col(k).cast(v)) if k in df.columns else new)
    return out.drop(json, has_key)


def with_outputs(df: DataFrame, output: str = "output") -> DataFrame:
    """Rows that have an output; count the others before, they belong to the total."""
    return df.filter(F.col(output).isNotNull())
