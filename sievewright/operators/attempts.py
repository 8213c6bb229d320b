"""Asking a model until its replies are valid and good enough, with the state of every attempt in a table."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.validate import Shape, reprompt, validate
from ..storage import fresh_path, unused
from .backends import Backend, RateLimited

_STATE = (
    "struct<thought: string, turns: array<struct<role: string, content: string>>, model: string, retry: int, depth: int, calls: int, reprompts: int, "
    "waits: int, due: double, models: array<string>, status: string, reply: map<string, string>, label: int, score: int, error: string>"
)


class TokenBucket:
    """Lets `per_second` calls through, up to `burst` at once; threads that share it wait their turn."""

    def __init__(self, per_second: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = per_second, burst, clock, sleep
        self.left, self.at, self.lock = float(burst), clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.left = min(self.burst, self.left + (now - self.at) * self.rate) - 1
            self.at = now
            wait = -self.left / self.rate if self.left < 0 else 0.0
        if wait:
            self.sleep(wait)


def in_flight(items: Iterable, call: Callable, at_once: int) -> Iterator:
    """call(item) for each item, at most `at_once` at a time, results in the order of the items. Items are drawn as
    places fall free, so what is held is bounded by at_once."""
    if at_once <= 1:
        yield from map(call, items)
        return
    with ThreadPoolExecutor(at_once) as pool:
        waiting: deque = deque()
        for item in items:
            waiting.append(pool.submit(call, item))
            if len(waiting) == at_once:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def ask_once(df: DataFrame, make: Callable[[], Backend], messages: str, model: str, text: str, error: str, at_once: int = 1, batch: int = 1, per_second: float | None = None, **options) -> DataFrame:
    """df with the reply to each row's messages in column `text`, or what the backend raised in `error`.

    messages: array of (role, content); model: its name; both are columns. A partition makes one backend and has at most
    `at_once` requests under way, `per_second` of them begun in a second. With batch > 1 a request is the rows of one
    call of the backend's generate_many(list of messages, list of models); one that fails, fails for its rows. All other
    columns go through as they came; a row keeps its place, whatever its id.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{text}` string, `{error}` string"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend, bucket = make(), TokenBucket(per_second, at_once) if per_second else None

        def call(rows: list[tuple]) -> list[tuple]:
            if bucket:
                bucket.take()
            try:
                if batch > 1:
                    return [(x, None) for x in backend.generate_many([m for m, _ in rows], [n for _, n in rows], **options)]
                return [(backend.generate(m, n, **options), None) for m, n in rows]
            except RateLimited as e:
                return [(None, f"rate limit: {e}")] * len(rows)
            except Exception as e:  # noqa: BLE001  a backend may raise anything
                return [(None, str(e) or type(e).__name__)] * len(rows)

        for b in batches:
            asked = list(zip(b.column(messages).to_pylist(), b.column(model).to_pylist()))
            got = [x for some in in_flight((asked[k : k + batch] for k in range(0, len(asked), batch)), call, at_once) for x in some]
            more = [pa.array([x[k] for x in got], pa.string()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, text, error])

    return df.mapInArrow(step, kinds)


@dataclass(frozen=True)
class Policy:
    """How often, and whom, to ask.

    A row is asked 3 * retries times at most at each depth. Its context starts anew before every third call; from every
    sixth on the model is `sixth`, from every ninth on `ninth`, whichever was reached last, ninth where both are. A reply
    that scores below `least` is asked about again with its improved thought, by `again`, until `most_depth` is passed.
    Rate limits make a row due in min(2 ** n, most_wait) seconds; while a row is being limited, neither its context nor
    its model changes.
    """

    retries: int = 10
    sixth: str | None = None
    ninth: str | None = None
    again: str | None = None
    least: int = 4
    most_depth: int = 3
    most_wait: int = 60


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _turns(system: str | None, prompt: Callable[[Column], Column], thought: Column) -> Column:
    """The messages that open a conversation about this thought."""
    user = _turn("user", prompt(thought))
    return F.array(_turn("system", F.lit(system)), user) if system else F.array(user)


def _prepared(s: dict[str, Column], opening: Column, p: Policy) -> dict[str, Column]:
    """The state as a row is asked: its call counted, context and model changed where it is time."""
    nth, free = s["retry"] + 1, s["waits"] == 0
    model = s["model"]
    for every, other in ((6, p.sixth), (9, p.ninth)):
        if other:
            model = F.when(free & (nth % every == 0), other).otherwise(model)
    turns = F.when(free & (nth % 3 == 0), opening).otherwise(s["turns"])
    return s | {"model": model, "turns": turns, "calls": s["calls"] + 1, "models": F.concat(s["models"], F.array(model))}


def _after(s: dict[str, Column], text: Column, error: Column, v: Column, now: float, opening: Callable[[Column], Column], form: str, shape: Shape, p: Policy) -> dict[str, Column]:
    """The state after a reply or an error. v: the verdict on the reply."""
    answered = text.isNotNull()
    valid = answered & v["valid"]
    limited = ~answered & _is_limit(error)
    low = valid & (v["score"] < p.least) if shape.scores else F.lit(False)
    deeper = low & (s["depth"] <= p.most_depth)
    done = valid & ~deeper
    nth = s["retry"] + 1
    spent = ~valid & (nth >= 3 * p.retries)
    waits = F.when(limited, s["waits"] + 1).when(answered, 0).otherwise(s["waits"])
    wait = F.least(F.pow(F.lit(2.0), s["waits"] + 1), F.lit(float(p.most_wait)))
    improved = v["fields"][shape.texts[-1]]
    asked = F.concat(s["turns"], F.array(_turn("assistant", text), _turn("user", F.coalesce(reprompt(v["error_kind"], v["label"], form), F.lit(form)))))
    out = {
        "thought": F.when(deeper, improved).otherwise(s["thought"]),
        "turns": F.when(deeper, opening(improved)).when(done, F.concat(s["turns"], F.array(_turn("assistant", text)))).when(answered, asked).otherwise(s["turns"]),
        "model": F.when(deeper & F.lit(p.again is not None), F.lit(p.again)).otherwise(s["model"]),
        "retry": F.when(deeper, 0).otherwise(nth),
        "depth": s["depth"] + F.when(deeper, 1).otherwise(0),
        "reprompts": F.when(deeper, 0).otherwise(s["reprompts"] + F.when(~valid & ~limited, 1).otherwise(0)),
        "waits": F.when(deeper, 0).otherwise(waits),
        "due": F.when(limited, F.lit(now) + wait).otherwise(s["due"]),
        "status": F.when(done, F.when(low, "low").otherwise("done")).when(spent, "failed").otherwise("open"),
        "reply": F.when(valid, v["fields"]).otherwise(s["reply"]),
        "label": F.when(valid, v["label"]).otherwise(s["label"]),
        "score": F.when(valid, v["score"]).otherwise(s["score"]),
        "error": F.when(valid, F.lit(None)).when(answered, v["error_kind"]).otherwise(error),
    }
    return s | out


def _is_limit(error: Column) -> Column:
    low = F.lower(error)
    return F.coalesce(low.contains("rate limit") | low.contains("too many requests") | low.contains("429"), F.lit(False))


def run(
    df: DataFrame, make: Callable[[], Backend], prompt: Callable[[Column], Column], shape: Shape, model: str, thought: str | None = None, system: str | None = None,
    form: str = "a JSON object", policy: Policy = Policy(), clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, **options,
) -> DataFrame:
    """Ask about every row until its reply has `shape` and, where that has a score, reaches policy.least.

    prompt: the user's message from the row's thought, as a column expression; thought: the column that it begins with.
    Returns df's columns and `attempt`, a struct of the state in the end: status (done, low: the depth was passed with a
    low score, failed: no valid reply), reply (the object's fields), label, score, thought, turns (the whole
    conversation, the reply last), models (of every call), calls, depth, reprompts (of the last depth), waits, error.

    Rows are asked in rounds. A round is one call for each row that is open and due; the replies are judged and the
    state moved on by column expressions, and the whole state is written, so a lost executor repeats calls of its own
    tasks of one round only. Rows that a backend keeps off are due later: other rows go on meanwhile, and only where
    none is due the driver waits, never a task. Rounds are bounded by 3 * retries * (most_depth + 2), and by the waits.

    Every row comes back, as often as it was there, null and repeated ids too: state travels with its row, without a
    join. An empty table gives no rows.
    """
    spark = df.sparkSession
    state, text, error, verdict, messages, named, attempt = unused(df, "_state", "_text", "_error", "_verdict", "_messages", "_model", "attempt")
    names = T.StructType.fromDDL(_STATE[7:-1]).names
    first = F.col(f"`{thought}`").cast("string") if thought else F.lit(None).cast("string")
    opening = lambda t: _turns(system, prompt, t)
    none = {"thought": first, "turns": opening(first), "model": F.lit(model), "models": F.array().cast("array<string>"), "status": F.lit("open"), "due": F.lit(0.0)}
    none |= {k: F.lit(0) for k in ("retry", "depth", "calls", "reprompts", "waits")} | {k: F.lit(None) for k in ("reply", "label", "score", "error")}
    as_state = lambda s: F.struct(*(s[k].alias(k) for k in names)).cast(_STATE).alias(state)
    folder, k = fresh_path(spark, "attempts"), 0
    kinds = df.select("*", as_state(none)).schema

    def put(rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{folder}/round={k}")
        return spark.read.schema(kinds).parquet(f"{folder}/round={k}")

    now_state = put(df.select("*", as_state(none)))
    is_open = F.col(f"{state}.status") == "open"
    while True:
        left = now_state.filter(is_open)
        next_due = left.agg(F.min(f"{state}.due")).first()[0]
        if next_due is None:
            break
        now = clock()
        if next_due > now:
            sleep(next_due - now)
            now = max(clock(), next_due)
        due = F.col(f"{state}.due") <= now
        s = {n: F.col(f"{state}.{n}") for n in names}
        ready = left.filter(due).withColumn(state, as_state(_prepared(s, opening(s["thought"]), policy)))
        ready = ready.select("*", F.col(f"{state}.turns").alias(messages), F.col(f"{state}.model").alias(named))
        asked = ask_once(ready, make, messages, named, text, error, **options).drop(messages, named)
        judged = asked.withColumn(verdict, validate(F.col(text), shape))
        moved = judged.withColumn(state, as_state(_after(s, F.col(text), F.col(error), F.col(verdict), now, opening, form, shape, policy)))
        k += 1
        now_state = put(moved.drop(text, error, verdict).unionByName(left.filter(~due)))
    # A row is open in all rounds but the one that ended it.
    ended = spark.read.schema(kinds).option("basePath", folder).parquet(*(f"{folder}/round={i}" for i in range(k + 1))).filter(~is_open)
    return ended.select(*(f"`{c}`" for c in df.columns), F.col(state).alias(attempt))


def generation_record(df: DataFrame, attempt: str = "attempt", true_label: str = "true_label") -> DataFrame:
    """Generations as they are kept: the row's own columns, then thought_process, predicted_label (-1 where no valid reply
    came), correct, chat_history, reprompt_counts and error_info."""
    s = F.col(attempt)
    label = F.coalesce(s["label"], F.lit(-1))
    own = [c for c in df.columns if c not in (attempt, "thought_process", "predicted_label", "correct", "chat_history", "reprompt_counts", "error_info")]
    return df.select(
        *(f"`{c}`" for c in own), s["reply"]["thought_process"].alias("thought_process"), label.alias("predicted_label"), (label == F.col(true_label)).alias("correct"),
        s["turns"].alias("chat_history"), s["reprompts"].alias("reprompt_counts"), s["error"].alias("error_info"),
    )
