"""Labels out of free model text: Column -> struct(label, method, ok)."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import brace_spans, let, step3_section

_PLAIN = {"allowSingleQuotes": "false"}
#: All digits of Unicode, and the digits that they stand for.
_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.decimal(c, None) is not None)
_ASCII = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)
_INT = r"(?U)^\s*([+-]?\d+(?:_\d+)*)\s*$"


def parsed(text: Column, keys: Sequence[str] = ("predicted_label", "label")) -> Column:
    """Fields of a text that is one JSON object, array<struct<key, kind, value>> with the last first; null where it is none.

    One parse gives both: kind is the JSON type (STRING, BIGINT, BOOLEAN, VOID, DECIMAL..., OBJECT...), value the string
    or what stands for it. Keys may repeat. Where they do so within a field's own value, that parse gives up, and another
    reads the fields of `keys` alone, the last of each, passing over all others.
    """
    names = list(dict.fromkeys(keys))
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    read = lambda kind: F.from_json(wrapped, f"array<{kind}>", _PLAIN)
    only = lambda x, body: F.when(F.size(x) == 1, body(F.get(x, F.lit(0))))
    shown = lambda key, v: F.struct(key.alias("key"), F.schema_of_variant(v).alias("kind"), v.cast("string").alias("value"))
    every = lambda m: F.reverse(F.transform(F.map_entries(m), lambda e: shown(e["key"], e["value"])))
    some = lambda s: F.filter(F.array(*(F.when(s[k].isNotNull(), shown(F.lit(k), s[k])) for k in names)), lambda f: f.isNotNull())
    plain = let(read("map<string,variant>"), lambda x: only(x, every))
    nested = F.instr(F.substring(text, F.instr(text, "{") + 1, 1 << 30), "{") > 0
    return F.coalesce(plain, F.when(nested, let(read(f"struct<{', '.join(f'`{k}`: variant' for k in names)}>"), lambda x: only(x, lambda s: F.when(s.isNotNull(), some(s))))))


def field(fields: Column, key: str) -> Column:
    """The last field of that key as struct<key, kind, value>, or null."""
    return F.get(F.filter(fields, lambda f: f["key"] == key), F.lit(0))


def whole_number(value: Column) -> Column:
    """A string of digits, of any script, with spaces around it and single underscores inside, as a number."""
    found = F.regexp_extract(value, _INT, 1)
    plain = F.when(found.rlike(r"^[+-]?[0-9]+$"), found).otherwise(F.translate(found, _DIGITS + "_", _ASCII))
    return F.when(found != "", plain.try_cast("long"))


def _loose(value: Column, kind: Column) -> Column:
    low = F.lower(value)
    text = (
        F.when(value.isin("0", "no entailment") | (low == "false"), 0)
        .when(value.isin("1", "entailment") | (low == "true"), 1)
        .otherwise(whole_number(value))
    )
    number = F.when(kind == "BOOLEAN", (value == "true").cast("long")).otherwise(value.try_cast("double").try_cast("long"))
    return F.when(kind == "STRING", text).otherwise(number).cast("long")


def _strict(value: Column, kind: Column) -> Column:
    text = F.when(value.isin("0", "no entailment", "false"), 0).when(value.isin("1", "entailment", "true"), 1)
    text = text.otherwise(let(whole_number(value), lambda n: F.when(n.isin(0, 1), n)))
    number = value.try_cast("double")
    return F.when(kind == "STRING", text).when(kind == "BOOLEAN", (value == "true").cast("long")).when(number.isin(0.0, 1.0), number.cast("long")).cast("long")


def _first_label(text: Column, read: Callable[[Column, Column], Column]) -> Column:
    """struct(label, method) of the first span that gives a label, or null. A key that is there hides the next."""

    def of(f: Column, key: str) -> Column:
        return F.struct(read(f["value"], f["kind"]).alias("label"), F.lit(f"json_{key}").alias("method"))

    def candidate(fields: Column) -> Column:
        first, second = field(fields, "predicted_label"), field(fields, "label")
        return let(first, lambda a: F.when(a.isNotNull(), of(a, "predicted_label")).otherwise(let(second, lambda b: F.when(b.isNotNull(), of(b, "label")))))

    found = F.filter(F.transform(brace_spans(text), lambda span: let(parsed(span), candidate)), lambda c: c["label"].isNotNull())
    return F.get(found, F.lit(0))


def _phrases(text: Column, otherwise: int, use_cot: bool) -> Column:
    low = F.lower(text)
    has = lambda *xs: F.greatest(*(F.instr(low, x) for x in xs), F.lit(0)) > 0
    pick = lambda label, method: F.struct(F.lit(label).cast("long").alias("label"), F.lit(method).alias("method"))
    found = (
        F.when(has("final label: 0", "final prediction: 0"), pick(0, "explicit_label_0"))
        .when(has("final label: 1", "final prediction: 1"), pick(1, "explicit_label_1"))
        .when(has("not entailed", "no entailment"), pick(0, "conclusion_not_entailed"))
        .when(has("is entailed", "entailment"), pick(1, "conclusion_entailed"))
    )
    if use_cot:
        # Whatever the section holds, the whole text holds too, so these two are kept for completeness only.
        third = step3_section(text)
        found = found.when(F.instr(third, "not entailed") > 0, pick(0, "cot_step3_not_entailed")).when(F.instr(third, "is entailed") > 0, pick(1, "cot_step3_entailed"))
    return found.otherwise(pick(otherwise, "extraction_failure"))


def tracking(text: Column, use_cot: bool = False) -> Column:
    """struct(label, method, ok): JSON spans first, then phrases; -1 and extraction_failure where nothing is found."""
    both = F.coalesce(_first_label(text, _loose), _phrases(text, -1, use_cot))
    return let(both, lambda x: F.struct(x["label"].alias("label"), x["method"].alias("method"), (x["method"] != "extraction_failure").alias("ok")))


def standard(text: Column, use_cot: bool = False) -> Column:
    """The label alone, -1 where nothing is found."""
    return tracking(text, use_cot)["label"]


def with_default(text: Column, default: int = 1) -> Column:
    """The label, the majority class where nothing is found."""
    return let(standard(text), lambda label: F.when(label == -1, F.lit(default).cast("long")).otherwise(label))


def strict(text: Column) -> Column:
    """struct(label, method, ok): JSON only, labels 0 and 1 only; null label where nothing is found."""
    method = lambda x: F.coalesce(x["method"], F.lit("extraction_failure"))
    return let(_first_label(text, _strict), lambda x: F.struct(x["label"].alias("label"), method(x).alias("method"), x["label"].isNotNull().alias("ok")))


def by_mode(text: Column, track: bool = False, strictly: bool = False, use_cot: bool = False) -> Column:
    """struct(label, method, ok) by mode: strict goes before tracking, and without either the method is left null."""
    if strictly:
        return strict(text)
    found = tracking(text, use_cot)
    return found if track else let(found, lambda x: F.struct(x["label"].alias("label"), F.lit(None).cast("string").alias("method"), x["ok"].alias("ok")))
