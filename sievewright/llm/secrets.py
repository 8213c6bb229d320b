"""Secret scans in DataFrame expressions: single-part patterns and multipart credential linking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import unused

# Patterns of the base kinds, in the order that breaks ties.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: Weak parts of credentials. Alone they are ordinary text.
KEY_ID = r"""(?i:access_?key(?:_?id)?|client_?id|account_?id|user_?name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.-]{6,}|AKIA[A-Z0-9]{4,}"""
#: A value may follow its name and `=` directly; `=` is padding at the end only.
KEY_SECRET = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""(?i:https?|s3|amqps?|postgres(?:ql)?|mysql|redis|mongodb)://[^\x20\x09-\x0D"'<>]+"""
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key_id": KEY_ID, "key_secret": KEY_SECRET, "endpoint": ENDPOINT}
BASE = ("assign", "access", "hex")
#: Code points of an assigned value that is a secret by itself; shorter ones are the weak kind weak_assign.
ALONE = 12
#: Code points between parts that may belong together.
SCOPE = 300
MASK = "[REDACTED]"


#: Values that one step of a running sum adds up, and code points of a part that texts are cut into for masking.
_BLOCK, _CHUNK, _LARGE = 128, 1024, 65_536


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column) -> Column:
    """For each of the integers the sum of those before it: block by block, so the time grows in proportion."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def within(v: Column, starts: Column) -> Column:
        return F.transform(v, lambda _, i: F.get(starts, F.floor(i / _BLOCK).cast("int")) + total(F.slice(v, i - i % _BLOCK + 1, i % _BLOCK)))

    def blocks(v: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(v, b * _BLOCK + 1, _BLOCK)))
        return _let(sums, lambda t: _let(F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b))), lambda starts: within(v, starts)))

    return _let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(v))


def _located(text: Column, pattern: str, matches: Column, kind: str, rank: int) -> Column:
    """Spans of all matches: what split() leaves between them gives their places, in code points."""
    empty = F.expr("cast(array() as array<struct<start: int, rank: int, end: int, kind: string, match: string>>)")

    def placed(gaps: Column) -> Column:
        size = F.transform(matches, lambda x, i: F.length(F.get(gaps, i)) + F.length(x))

        def span(x: Column, begin: Column) -> Column:
            return F.struct(begin.cast("int").alias("start"), F.lit(rank).alias("rank"), (begin + F.length(x)).cast("int").alias("end"), F.lit(kind).alias("kind"), x.alias("match"))

        return _let(_before(size), lambda at: F.transform(matches, lambda x, i: span(x, F.get(at, i) + F.length(F.get(gaps, i)))))

    return F.when(F.size(matches) > 0, _let(F.split(text, pattern, -1), placed)).otherwise(empty)


def _merged(own: Column, others: Column, test: Callable[[Column, Column, Column], Column]) -> Column:
    """Indices of own spans x for which test(x, last other that begins at x or before, next other) holds.

    Both are spans of one kind, in order and apart from each other, so the two neighbours are the nearest on either
    side. They are found by sorting all starts into one order: a sort-merge within the row, no nested loop.
    """
    nothing = F.expr("cast(array() as array<int>)")

    def merge(a: Column, o: Column) -> Column:
        starts = F.concat(F.transform(o, lambda x: F.struct(x["start"].alias("at"), F.lit(0).alias("own"))), F.transform(a, lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("own"))))
        place = F.transform(F.array_sort(starts), lambda x, p: F.struct(x["own"].alias("own"), p.alias("p")))
        # The j-th own start has p - j others before it or at it.
        ranks = F.transform(F.filter(place, lambda x: x["own"] == 1), lambda x, j: x["p"] - j)
        good = F.transform(ranks, lambda r, j: F.when(F.coalesce(test(F.get(a, j), F.get(o, r - 1), F.get(o, r)), F.lit(False)), j))
        return F.filter(good, lambda j: j.isNotNull())

    return F.when((F.size(own) > 0) & (F.size(others) > 0), _let(own, lambda a: _let(others, lambda o: merge(a, o)))).otherwise(nothing)


def _near(own: Column, *others: Column) -> Column:
    """Indices of own spans that lie within SCOPE of a span of one of the other kinds."""

    def close(x: Column, last: Column, after: Column) -> Column:
        return F.coalesce(last["end"] >= x["start"] - SCOPE, F.lit(False)) | F.coalesce(after["start"] <= x["end"] + SCOPE, F.lit(False))

    return F.array_distinct(F.concat(*(_merged(own, o, close) for o in others)))


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Add a column `out`, array<struct<start, rank, end, kind, match>> sorted by start, then kind, to each row; no shuffle.

    Base kinds: assign (its value has 12 characters or more), access (18 or more), hex (16 or more), leftmost
    without overlap within a kind. Weak parts are added when their complement lies within SCOPE code points of the
    same text: an access identifier with a secret, a secret (key_secret, or weak_assign: an assign with a shorter
    value) with an identifier, an endpoint with both. The interval join runs within the row, whose scope is its own
    text, so there is no key that could be hot; it sorts and merges, so time grows with the spans (times their
    logarithm), in very long texts too.

    Null and empty texts have no spans; repeated rows get equal ones. All columns are kept, whatever their names; that
    one is named `out` already is an error.
    """
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns]
    names = dict(zip((*KINDS, "weak_assign"), unused(docs, *(f"_at_{k}" for k in (*KINDS, "weak_assign")))))
    matched = dict(zip(KINDS, unused(docs, *(f"_all_{k}" for k in KINDS))))
    found = docs.select(*own, *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(matched[k]) for k, p in KINDS.items()))
    placed = found.select(*own, *(_located(text, KINDS[k], F.col(matched[k]), k, i).alias(names[k]) for i, k in enumerate(KINDS)))
    value = lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2))
    mixed = lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Z]") & x["match"].rlike("[a-z]")
    as_weak = lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), x["end"].alias("end"), F.lit("weak_assign").alias("kind"), x["match"].alias("match"))
    kept = placed.select(
        *own,
        F.filter(names["assign"], lambda x: value(x) >= ALONE).alias(names["assign"]),
        F.transform(F.filter(names["assign"], lambda x: value(x) < ALONE), as_weak).alias(names["weak_assign"]),
        F.filter(names["access"], lambda x: F.length(x["match"]) >= 18).alias(names["access"]),
        names["hex"],
        names["key_id"],
        F.filter(names["key_secret"], mixed).alias(names["key_secret"]),
        names["endpoint"],
    )
    c = {k: F.col(n) for k, n in names.items()}
    ids, secrets = (c["access"], c["key_id"]), (c["assign"], c["weak_assign"], c["hex"], c["key_secret"])
    same = _merged(c["key_id"], c["access"], lambda x, last, after: last["start"] == x["start"])
    at = {
        "key_id": F.array_except(_near(c["key_id"], *secrets), same),
        "key_secret": _near(c["key_secret"], *ids),
        "endpoint": F.array_intersect(_near(c["endpoint"], *ids), _near(c["endpoint"], *secrets)),
        "weak_assign": _near(c["weak_assign"], *ids),
    }
    pick = lambda spans, i: F.transform(i, lambda x: F.get(spans, x))
    linked = [pick(c[k], at[k]) if k in at else c[k] for k in names]
    return kept.select(*own, F.array_sort(F.concat(*linked)).alias(out))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of each row, spans as with_spans gives them."""
    return with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "spans")


def _cut(text: Column) -> Column:
    """The text in parts of _CHUNK code points; large parts first, as finding a place takes time with its distance."""
    parts = lambda x, n: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / n).cast("int")), lambda k: F.substring(x, k * n + 1, F.lit(n)))
    return F.flatten(F.transform(parts(text, _LARGE), lambda x: parts(x, _CHUNK)))


def _masked(text: Column, spans: Column) -> Column:
    """The text with MASK for each run of overlapping spans."""
    borders = F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("d"))), F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(-1).alias("d"))))

    def runs(b: Column) -> Column:
        """Places where no span is open before a start, or after an end, in turn."""
        free = _let(_before(F.transform(b, lambda x: x["d"])), lambda n: F.transform(b, lambda x, i: F.when(F.get(n, i) + F.least(x["d"], F.lit(0)) == 0, x["at"])))
        return F.filter(free, lambda x: x.isNotNull())

    def piece(parts: Column, begin: Column, end: Column) -> Column:
        first, last = F.floor(begin / _CHUNK).cast("int"), F.floor((end - 1) / _CHUNK).cast("int")
        some = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
        return F.when(end > begin, F.substring(some, begin - first * _CHUNK + 1, end - begin)).otherwise("")

    def joined(parts: Column, at: Column) -> Column:
        # at: start, end, start, end, ...; what stays lies from each end (or 0) to the next start (or the text's end).
        edges = F.concat(F.array(F.lit(0)), at, F.array(F.length(text)))
        pairs = F.sequence(F.lit(0), F.floor(F.size(at) / 2).cast("int"))
        return _let(edges, lambda e: F.array_join(F.transform(pairs, lambda k: piece(parts, F.get(e, 2 * k), F.get(e, 2 * k + 1))), MASK))

    return _let(_let(F.array_sort(borders), runs), lambda at: _let(_cut(text), lambda parts: joined(parts, at)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with every span of the text replaced by MASK (overlapping spans by one), n_chars following.

    Null and empty texts stay; time grows with the text and its spans.
    """
    (spans,) = unused(docs, "_spans")
    found = with_spans(docs, text_col, spans)
    clean = F.when(F.size(spans) > 0, _masked(F.col(text_col), F.col(spans))).otherwise(F.col(text_col))
    out = found.withColumn(text_col, clean).drop(spans)
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else out
