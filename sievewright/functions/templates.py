"""Prompts and training texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: models tuned on this wording expect it to the letter.
TASK = (
    "Use chain of thought reasoning to determine if the hypothesis is entailed by the premise. "
    "Provide your reasoning and the final label (0 or 1) in JSON format: "
    '{"thought_process": "...", "predicted_label": ...}'
)

#: Prompts by type; the last element names the keys of the reply.
PROMPTS = {
    "initial_generation": (
        "Decide by short, explicit steps whether the hypothesis follows from the premise. Reason first, then give 1 (it follows) or 0.",
        ("thought_process", "predicted_label"),
    ),
    "finetune": (TASK, ("thought_process", "predicted_label")),
    "scoring": (
        "Rate the given reasoning from 1 (unusable) to 5 (sound and concise), say why, and write a better version with the right label.",
        ("analysis", "score", "improved_thought_process", "predicted_label"),
    ),
    "reflection": (
        "The reasoning below led to the given prediction. Compare it with the true label, name the error, and write reasoning that leads to the true label.",
        ("error_analysis", "improved_thought_process", "predicted_label"),
    ),
}


def get_prompt(kind: str) -> tuple[str, tuple[str, ...]]:
    if kind not in PROMPTS:
        raise ValueError(f"Unknown prompt type: {kind}")
    return PROMPTS[kind]


def prompt_of(kind: Column) -> Column:
    """struct(text, keys) of the prompt of this type, null for a type that there is not."""
    out = None
    for name, (text, keys) in PROMPTS.items():
        one = F.struct(F.lit(text).alias("text"), F.array(*map(F.lit, keys)).alias("keys"))
        out = F.when(kind == name, one) if out is None else out.when(kind == name, one)
    return out


def json_string(text: Column) -> Column:
    """A JSON string literal in ASCII: what is outside prints as \\uXXXX, pairs of them beyond the basic plane."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f", '"': '\\"', "\\": "\\\\"}

    def one(ch: Column) -> Column:
        cp = F.ascii(ch)
        out = None
        for raw, shown in short.items():
            out = F.when(ch == raw, shown) if out is None else out.when(ch == raw, shown)
        high, low = F.lit(0xD800) + F.shiftright(cp - 0x10000, 10), F.lit(0xDC00) + (cp - 0x10000).bitwiseAND(0x3FF)
        return out.when(cp > 0xFFFF, F.concat(code(high), code(low))).when((cp < 32) | (cp > 126), code(cp)).otherwise(ch)

    odd = text.rlike(r'[^\x20-\x7E]|["\\]')
    chars = F.split(text, "")
    return F.concat(F.lit('"'), F.when(odd, F.array_join(F.transform(chars, one), "")).otherwise(text), F.lit('"'))


def task_prompt(premise: Column, hypothesis: Column) -> Column:
    return F.concat(F.lit("Premise: "), premise, F.lit("\nHypothesis: "), hypothesis, F.lit("\n\n" + TASK))


def inference_prompt(premise: Column, hypothesis: Column) -> Column:
    return F.concat(F.lit("[INST] "), task_prompt(premise, hypothesis), F.lit(" [/INST]"))


def sft_text(premise: Column, hypothesis: Column, thought: Column, label: Column) -> Column:
    """One training text: the prompt within instruction marks, then the reply as JSON."""
    reply = F.concat(F.lit('{"thought_process": '), json_string(thought), F.lit(', "predicted_label": '), label.cast("string"), F.lit("}"))
    return F.concat(F.lit("<s>[INST] "), task_prompt(premise, hypothesis), F.lit(" [/INST] "), reply, F.lit(" </s>"))


def chat_message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))
