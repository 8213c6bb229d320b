"""Text functions over Columns: JSON slices, sections, token counts and length buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_json(text: Column) -> Column:
    """Lower-case, drop newlines, and keep what lies from the first { to the last }; all of it if either is missing."""
    low = F.replace(F.lower(text), F.lit("\n"), F.lit(""))
    first, back = F.instr(low, "{"), F.instr(F.reverse(low), "}")
    last = F.length(low) - back + 1
    return F.when((first > 0) & (back > 0), F.substring(low, first, F.greatest(last - first + 1, F.lit(0)))).otherwise(low)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def brace_spans(text: Column) -> Column:
    """Texts of the top-level brace spans, in order.

    A plain depth count: braces within strings count too, and a stray } takes the depth below zero, where openings
    start nothing until it is balanced again. Unclosed spans give nothing; null gives none.

    Time grows with the text, whatever its braces. Of the braces, numbered from 0, the k-th opening one at place i has k
    openings and i - k closings before it, so the depth there is 2k - i; behind the k-th closing one it is i - 2k - 1. A
    span opens where the one is zero and closes where the other is; the n-th closing belongs to the n-th opening.
    """
    none = F.expr("cast(array() as array<string>)")
    tokens = F.split(text, r"(?<=[{}])|(?=[{}])", -1)

    def at_zero(braces: Column, brace: str, depth: Callable[[Column, Column], Column]) -> Column:
        """Places among the tokens of those braces of this kind where the depth is zero."""
        own = F.filter(F.transform(braces, lambda b, i: F.struct(b["token"], b["at"], i.alias("i"))), lambda b: b["token"] == brace)
        own = F.transform(own, lambda b, k: F.struct(b["at"].alias("at"), depth(b["i"], k).alias("depth")))
        return F.transform(F.filter(own, lambda b: b["depth"] == 0), lambda b: b["at"])

    def spans(tokens: Column) -> Column:
        placed = F.transform(tokens, lambda t, j: F.struct(t.alias("token"), j.alias("at")))
        braces = F.filter(placed, lambda b: b["token"].isin("{", "}"))
        ends = let(braces, lambda b: F.struct(at_zero(b, "{", lambda i, k: 2 * k - i).alias("opens"), at_zero(b, "}", lambda i, k: i - 2 * k - 1).alias("closes")))
        return let(ends, lambda e: F.transform(e["closes"], lambda c, n: F.array_join(F.slice(tokens, F.get(e["opens"], n) + 1, c - F.get(e["opens"], n) + 1), "")))

    return F.when(F.instr(text, "{") > 0, let(tokens, spans)).otherwise(none)


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded down; null and empty give 0."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def token_count(text: Column) -> Column:
    """Runs of Unicode word characters plus single other characters that aren't white space."""
    text = F.coalesce(text, F.lit(""))
    return (F.regexp_count(text, F.lit(r"(?U)\w+")) + F.regexp_count(text, F.lit(r"(?U)[^\w\s]"))).cast("long")


#: Labels of the fixed length buckets, in order.
FIXED_BUCKETS = ("0-100", "101-200", "201-300", "301+")


def fixed_bucket(tokens: Column) -> Column:
    a, b, c, d = FIXED_BUCKETS
    return F.when(tokens <= 100, a).when(tokens <= 200, b).when(tokens <= 300, c).otherwise(d)


def quartile_bucket(tokens: Column, q: Column) -> Column:
    """Label of the quartile bucket; q is an array of the three truncated quartiles."""
    q1, q2, q3 = (q[k].cast("long") for k in range(3))
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return (
        F.when(tokens <= q1, text("0-", q1))
        .when(tokens <= q2, text(q1 + 1, "-", q2))
        .when(tokens <= q3, text(q2 + 1, "-", q3))
        .otherwise(text(q3 + 1, "+"))
    )


def bucket_floor(label: Column) -> Column:
    """The lower bound of a bucket label such as 113-135 or 167+, to sort by."""
    return F.regexp_extract(label, r"^(\d+)", 1).cast("long")


#: What the parts of a prompt and of its reply are told by.
_THOUGHT = r'(?s)\{.*"thought_process":\s*"(.*?)",.*\}'
_PREMISE = r"(?s)Premise:(.*?)(?=\n|Hypothesis:)"
_HYPOTHESIS = r"(?s)Hypothesis:(.*?)(?=\n|\[|\]|Use)"


def thought_from_output(output: Column) -> Column:
    """The last "thought_process" value within braces that more keys follow, or an empty text."""
    return F.regexp_extract(output, _THOUGHT, 1)


def inst_json(text: Column) -> Column:
    """The JSON text within one line after the first [/INST], or null."""
    after = F.trim(F.when(F.instr(text, "[/INST]") > 0, F.split_part(text, F.lit("[/INST]"), F.lit(2))))
    found = F.regexp_extract(after, r"\{.*\}", 0)
    return F.when(found != "", found)


def premise_of(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, _PREMISE, 1))


def hypothesis_of(text: Column) -> Column:
    """Up to a line end, a bracket or the word "Use", also where that begins a longer word."""
    return F.trim(F.regexp_extract(text, _HYPOTHESIS, 1))


def step3_section(text: Column) -> Column:
    """What follows the first "step 3", up to "step 4" or an empty line; null without "step 3"."""
    low = F.lower(text)
    part = F.split_part(F.split_part(F.split_part(low, F.lit("step 3"), F.lit(2)), F.lit("step 4"), F.lit(1)), F.lit("\n\n"), F.lit(1))
    return F.when(F.instr(low, "step 3") > 0, part)
