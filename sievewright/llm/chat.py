"""Chat formatting with a grammar round trip, in DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secrets import _before, _let

# The grammar.
#   conversation = turn*    turn = OPEN role mark CLOSE text END    mark = "" (text as it is) or ESCAPED
OPEN, CLOSE, END, ESCAPED = "<s>[INST:", "]", "</s>", "/e"
#: Reversible escapes. An escaped text has none of the characters that control strings begin with.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\o"), ("]", "\\c"), ("/", "\\s"))


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _render(turn: Column, escaped: Column) -> Column:
    body = F.when(escaped, escape(turn["text"])).otherwise(turn["text"])
    return F.concat(F.lit(OPEN), escape(turn["role"]), F.when(escaped, F.lit(ESCAPED)).otherwise(F.lit("")), F.lit(CLOSE), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns that the deterministic parser recovers: array<struct<role, text, head, size>>.

    A turn ends at the first END, its role at the first CLOSE; head and size are the code points of the turn before
    its text, and of its text as it stands. What doesn't begin with OPEN becomes a turn with a null role.
    """
    parts = F.split(formatted, END, -1)

    def one(part: Column) -> Column:
        shut = F.locate(CLOSE, part)
        mark = F.substring(part, len(OPEN) + 1, shut - len(OPEN) - 1)
        marked = mark.endswith(ESCAPED)
        role = unescape(F.when(marked, F.left(mark, F.length(mark) - len(ESCAPED))).otherwise(mark))
        body = F.substring(part, shut + 1, F.length(part))
        good = part.startswith(OPEN) & (shut > 0)
        return F.struct(
            F.when(good, role).alias("role"),
            F.when(marked, unescape(body)).otherwise(body).alias("text"),
            F.when(good, shut).otherwise(F.lit(0)).alias("head"),
            F.length(body).alias("size"),
        )

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), one)


def _said(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def loss_spans(turns: Column, role: str) -> Column:
    """Spans (start, end, in code points, end exclusive) of the texts of one role within the formatted text."""
    sizes = F.transform(turns, lambda t: (t["head"] + t["size"] + len(END)).cast("int"))

    def span(t: Column, at: Column) -> Column:
        begin = at + t["head"]
        return F.struct(begin.cast("int").alias("start"), (begin + t["size"]).cast("int").alias("end"), (t["size"] != F.length(t["text"])).alias("escaped"))

    # What lies before each turn is a running sum, so a conversation of many turns takes time in proportion.
    spans = _let(_before(sizes), lambda at: F.transform(turns, lambda t, i: F.when(t["role"] == role, span(t, F.get(at, i)))))
    return F.filter(spans, lambda s: s.isNotNull())


def format_chats(rows: DataFrame, role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss (array<struct<start, end, escaped>>), n_turns, intact.

    rows: conv_id, turn, role, text. Turns are ordered by turn, then role and text, which settles ties; repeated rows
    are turns of their own. A conversation is rendered with its texts as they are, parsed, and compared with its source;
    where they differ, the texts that don't survive alone are escaped, and where that differs still, all are. `intact`
    tells that the last rendering gives back the source; the escapes make it true for every text.

    Null roles and texts are empty, null turns come first, and a null conv_id is a conversation like another. A
    conversation is one text in the end, so its rows meet in one group whatever the plan. Other columns are not read.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    plain = chats.withColumn("turns", _said(F.col("turns"))).withColumn("formatted", F.array_join(F.transform("turns", lambda t: _render(t, F.lit(False))), ""))
    once = plain.withColumn("same", _said(parse(F.col("formatted"))) == F.col("turns"))
    alone = lambda t: F.get(_said(parse(_render(t, F.lit(False)))), 0) == t
    some = F.array_join(F.transform("turns", lambda t: _render(t, ~F.coalesce(alone(t), F.lit(False)) | t["text"].contains(END))), "")
    twice = once.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(some)).withColumn("parsed", parse(F.col("formatted")))
    twice = twice.withColumn("same", _said(F.col("parsed")) == F.col("turns"))
    every = F.array_join(F.transform("turns", lambda t: _render(t, F.lit(True))), "")
    last = twice.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(every)).withColumn("parsed", parse(F.col("formatted")))
    return last.select(
        "conv_id",
        "formatted",
        loss_spans(F.col("parsed"), role).alias("loss"),
        F.size("turns").cast("long").alias("n_turns"),
        (_said(F.col("parsed")) == F.col("turns")).alias("intact"),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    piece = lambda s: F.substring(formatted, s["start"] + 1, s["end"] - s["start"])
    return F.array_join(F.transform(loss, lambda s: F.when(s["escaped"], unescape(piece(s))).otherwise(piece(s))), "")
