"""Validation of model responses against a declared shape, and the prompts that ask again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import field, parsed
from .text import clean_json, let


@dataclass(frozen=True)
class Shape:
    """texts: required strings; scores: required integers with limits; label: predicted_label in {0, 1} is required.

    coerce: the strings "0" and "1" are labels too. alias: label may stand for predicted_label. keys_first: all keys
    are demanded, with an error of its own, before values are looked at.
    """

    texts: tuple[str, ...]
    scores: tuple[tuple[str, int, int], ...] = ()
    coerce: bool = True
    alias: bool = True
    keys_first: bool = False


NLI = Shape(("thought_process",))
SCORE = Shape(("improved_thought_process",), (("score", 0, 5),), coerce=False)
REFLECTION = Shape(("error_analysis", "improved_thought_process"), alias=False, keys_first=True)


def _whole(value: Column, kind: Column, low: int, high: int) -> Column:
    """The value as an integer if it is a whole JSON number (or boolean) between low and high."""
    number = F.when(kind == "BOOLEAN", (value == "true").cast("double")).when(~kind.isin("STRING", "VOID"), value.try_cast("double"))
    return F.when((number == F.floor(number)) & number.between(low, high), number.cast("int"))


def validate(response: Column, shape: Shape, clean: bool = True) -> Column:
    """struct(valid, error_kind, label, score, fields): error_kind is json, keys, label, score or thought.

    The response is parsed once; of a key that repeats the last value counts.
    """
    keys = ["predicted_label", "label", *(k for k, *_ in shape.scores), *shape.texts]

    def judged(got: Column) -> Column:
        """got: struct of `json` (whether there is an object), `fields` and each key's field or null."""
        kind = lambda k: F.coalesce(got[k]["kind"], F.lit("UNKNOWN"))
        raw = F.coalesce(got["predicted_label"], got["label"]) if shape.alias else got["predicted_label"]
        return let(raw, lambda r: verdict(got, r, F.coalesce(r["kind"], F.lit("UNKNOWN")), kind))

    def verdict(got: Column, raw: Column, raw_kind: Column, kind) -> Column:
        label = _whole(raw["value"], raw_kind, 0, 1)
        if shape.coerce:
            label = F.when((raw_kind == "STRING") & raw["value"].isin("0", "1"), raw["value"].try_cast("int")).otherwise(label)
        scores = {k: _whole(got[k]["value"], kind(k), low, high) for k, low, high in shape.scores}
        error = F.when(~got["json"], "json")
        if shape.keys_first:
            for k in ("predicted_label", *shape.texts):
                error = error.when(got[k].isNull(), "keys")
        error = error.when((raw_kind == "STRING") & label.isNull(), "label")
        for k in scores:
            error = error.when(kind(k) == "STRING", "score")
        error = error.when(label.isNull(), "label")
        for v in scores.values():
            error = error.when(v.isNull(), "score")
        for k in shape.texts:
            error = error.when(kind(k) != "STRING", "thought" if shape.scores else "json")
        first_score = next(iter(scores.values()), F.lit(None).cast("int"))
        return let(F.struct(error.alias("error"), label.alias("label"), first_score.alias("score")), lambda x: shown(x, got["fields"]))

    def shown(x: Column, fields: Column) -> Column:
        ok, names = x["error"].isNull(), F.array_distinct(F.transform(fields, lambda f: f["key"]))
        values = F.transform(names, lambda k: F.get(F.filter(fields, lambda f: f["key"] == k), F.lit(0))["value"])
        both = let(names, lambda n: F.map_from_arrays(n, values))
        return F.struct(ok.alias("valid"), x["error"].alias("error_kind"), F.when(ok, x["label"]).alias("label"), F.when(ok, x["score"]).alias("score"), F.when(ok, both).alias("fields"))

    text = clean_json(response) if clean else response
    found = lambda fields: F.struct(fields.isNotNull().alias("json"), fields.alias("fields"), *(field(fields, k).alias(k) for k in dict.fromkeys(keys)))
    return let(parsed(text, keys), lambda fields: let(found(fields), judged))


def reprompt(error_kind: Column, value: Column, form: str) -> Column:
    """The message that asks a model again, by kind of error."""
    value = F.coalesce(value.cast("string"), F.lit("unknown"))
    return (
        F.when(error_kind == "json", F.lit(f"The reply was not a valid JSON object. Answer again in exactly this form: {form}"))
        .when(error_kind == "keys", F.lit(f"The reply lacks keys. Answer again with all keys of this form: {form}"))
        .when(error_kind == "label", F.concat(F.lit("The label '"), value, F.lit("' is not valid. Answer again with 0 or 1 as the label and nothing else.")))
        .when(error_kind == "score", F.concat(F.lit("The score '"), value, F.lit("' is not valid. Answer again with a whole number from 0 to 5.")))
        .when(error_kind == "thought", F.lit("The improved_thought_process is missing or not a text. Answer again with it filled in."))
    )
