"""Model backends as pluggable callables, and the generate / reflect / score steps around them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validate import NLI, REFLECTION, SCORE, Shape, validate
from ..storage import stored, unused


class Backend(Protocol):
    """A chat model. Messages are {role, content}; the reply is text."""

    def generate(self, messages: list[dict], model: str, **options) -> str: ...


class RateLimited(Exception):
    """The backend asks to wait."""


def backoff_seconds(attempt: Column | int, most: int = 60):
    """min(2 ** attempt, most), for a Column or a number."""
    if isinstance(attempt, int):
        return min(2**attempt, most)
    return F.least(F.pow(F.lit(2), attempt), F.lit(most)).cast("long")


def is_rate_limit(message: str) -> bool:
    low = message.lower()
    return any(x in low for x in ("rate limit", "too many requests", "429"))


class StubBackend:
    """Replies by a pure function of the messages; for tests and dry runs."""

    def __init__(self, reply: Callable[[list[dict]], str]):
        self.reply = reply

    def generate(self, messages: list[dict], model: str, **options) -> str:
        return self.reply(messages)


def _check(text: str, texts: tuple[str, ...], score: bool) -> tuple[dict | None, str | None]:
    """The Python side of functions.validate, for the loop that asks again."""
    low = text.lower().replace("\n", "")
    a, b = low.find("{"), low.rfind("}")
    try:
        got = json.loads(low[a : b + 1])
        if not isinstance(got, dict):
            raise ValueError
    except ValueError:
        return None, "json"
    label = got.get("predicted_label", got.get("label"))
    if isinstance(label, str) and label in ("0", "1") and not score:
        label = int(label)
    if isinstance(label, str) or label not in (0, 1):
        return None, "label"
    if score and (isinstance(got.get("score"), str) or got.get("score") not in range(6)):
        return None, "score"
    if any(not isinstance(got.get(k), str) for k in texts):
        return None, "thought" if score else "json"
    return got | {"predicted_label": int(label)}, None


def ask(backend: Backend, prompt: str, model: str, texts: tuple[str, ...], score: bool = False, retries: int = 5, calls_per_retry: int = 3, pick: Callable[[int, str], str] = lambda n, m: m, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Ask until the reply is valid, at most retries * calls_per_retry times; the context starts anew every third call.

    Rate limits wait min(2 ** n, 60) seconds; other exceptions count as replies and end the loop after `retries`.
    """
    messages, failures, waits, error = [{"role": "user", "content": prompt}], 0, 0, ""
    for n in range(retries * calls_per_retry):
        if n and n % 3 == 0:
            messages = messages[:1]
        try:
            text = backend.generate(messages, pick(n, model))
        except Exception as e:  # noqa: BLE001  a backend may raise anything
            error = str(e)
            if isinstance(e, RateLimited) or is_rate_limit(error):
                waits += 1
                sleep(backoff_seconds(waits))
                continue
            failures += 1
            if failures >= retries:
                break
            continue
        got, error = _check(text, texts, score)
        if got is not None:
            return {"ok": True, "reply": got, "reprompts": n, "error": None}
        messages = [*messages, {"role": "assistant", "content": text}, {"role": "user", "content": f"The reply is not valid ({error}). Answer again in the form asked for."}]
    return {"ok": False, "reply": {}, "reprompts": n, "error": error}


def escalate(n: int, model: str, sixth: str | None = None, ninth: str | None = None) -> str:
    """Every ninth call goes to one larger model, every other sixth to another."""
    k = n + 1
    if ninth and k % 9 == 0:
        return ninth
    return sixth if sixth and k % 6 == 0 else model


_OUT = "predicted_label int, thought_process string, score int, error_analysis string, reprompt_counts int, error_info string"


def run_backend(df: DataFrame, make: Callable[[], Backend], prompt: Column, model: str, texts: tuple[str, ...], score: bool = False, id_col: str = "id", keep: tuple[str, ...] = (), at_once: int = 1, **options) -> DataFrame:
    """One reply for each row, with its id and the columns `keep`; a row without an id, or with that of another, is a row
    like any. A backend is made once for a partition and has at most at_once rows under way; failures come back with
    error_info.

    Tasks may run more than once, so keep one row for each id when the output is appended somewhere.
    """
    from .attempts import in_flight

    (asked,) = unused(df.select(*(f"`{c}`" for c in keep)), "_prompt")
    names = [x.split()[0] for x in _OUT.split(", ")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make()

        def one(text: str) -> tuple:
            got = ask(backend, text, model, texts, score, **options)
            r = got["reply"]
            return r.get("predicted_label", -1), r.get(texts[-1]), r.get("score"), r.get("error_analysis"), got["reprompts"], got["error"]

        for b in batches:
            rows = list(in_flight(b.column(asked).to_pylist(), one, at_once))
            kinds = [pa.string() if x.endswith("string") else pa.int32() for x in _OUT.split(", ")]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), *cols], [*b.schema.names[:-1], *names])

    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), *(f"`{c}`" for c in keep), prompt.alias(asked))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(step, f"{kinds}, {_OUT}")


def generate(df: DataFrame, make: Callable[[], Backend], prompt: Column, model: str = "base", **options) -> DataFrame:
    """Thoughts and labels; -1 where no valid reply came."""
    return run_backend(df, make, prompt, model, NLI.texts, **options)


def reflect(df: DataFrame, make: Callable[[], Backend], prompt: Column, true_label: str = "true_label", model: str = "base", **options) -> DataFrame:
    """Improved thoughts for wrong rows; a failed one keeps the true label and its error.

    A row for each row of df, in whatever number its id is there or is null: the label travels with its row.
    """
    (known,) = unused(df, "_true")
    got = run_backend(df.withColumn(known, F.col(f"`{true_label}`")), make, prompt, model, REFLECTION.texts, keep=(known,), **options)
    label = F.when(F.col("error_info").isNotNull(), F.col(known)).otherwise(F.col("predicted_label"))
    return got.withColumn("predicted_label", label.cast("int")).withColumnRenamed("thought_process", "improved_thought_process").drop(known)


def score_rounds(df: DataFrame, score_once: Callable[[DataFrame, int], DataFrame], rounds: int = 3, least: int = 4) -> DataFrame:
    """Score, keep what reaches `least`, score the rest again, for a bounded number of rounds.

    score_once(rows, round) returns the rows with a column score. The result has `tier` (gold or low) and `round`; each
    row is scored until it passes or the rounds end. A round's scores are written to the shared folder before they are
    split, so a scorer that answers otherwise when asked again neither loses nor doubles a row, and is asked once for
    each row and round. A null score doesn't pass.
    """
    done, left = None, df
    for k in range(rounds):
        scored = stored(score_once(left, k).withColumn("round", F.lit(k)), f"scores-{k}")
        passed = F.coalesce(F.col("score") >= least, F.lit(False))
        last = k == rounds - 1
        good = scored if last else scored.filter(passed)
        done = good if done is None else done.unionByName(good)
        left = scored.filter(~passed).drop("score", "round")
        if not last and left.isEmpty():
            break
    return done.withColumn("tier", F.when(F.col("score") >= least, "gold").otherwise("low"))


def checked(df: DataFrame, response: str, shape: Shape) -> DataFrame:
    """Replies that came from elsewhere, with the verdict of functions.validate as `checked`."""
    return df.withColumn("checked", validate(F.col(response), shape))


SHAPES = {"nli": NLI, "score": SCORE, "reflection": REFLECTION}
