"""Mixing sources to target weights by systematic sampling of whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import numbered, running
from ..storage import stored, unused

#: Weights of the sources in order, repeating, and how often a source may be taken at most.
WEIGHTS = (5, 2, 1)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Share of its target by which a source may miss it without any row being rounded the other way.
NEAR = 0.001
#: Expected copies and offsets: exact numbers, whose sums don't depend on how rows are dealt.
EXACT = "decimal(17,15)"


def words(text: Column) -> Column:
    """Runs of what isn't white space; a null text has none. Each run is made one letter, and letters are counted, as an
    array of a long text's words would fill the heap."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with weight, target and copies (target over size, a decimal).

    Sources by code point, null last, get the weights in turn and share all sizes in proportion. A target stops at
    `most` times its source's size, and the excess is shared by weight among those that haven't stopped, until none is
    above. The rate (words a unit of weight) grows from round to round, and a source stops where the rate times its
    weight reaches its bound. A round is one aggregation, whose single row reaches the driver; it works with integers,
    so reruns agree. Each round but the last stops a source that none before did.

    A source without words gets nothing.
    """
    # Code points ascend as UTF-8 bytes do.
    ranked = numbered(sizes, "place", [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    ranked = stored(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    bound = (F.col("source_size") * most).cast("decimal(38,0)")
    first = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("pot"), F.coalesce(F.sum("weight"), F.lit(0)).alias("heavy")).first()
    rest, heavy, stopped = first["pot"], first["heavy"], 0
    while heavy:
        # The rate is rest / heavy.
        full = F.lit(rest).cast("decimal(38,0)") * F.col("weight") >= bound * F.lit(heavy)
        got = ranked.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, bound)).alias("words"), F.sum(F.when(full, F.col("weight"))).alias("weight")).first()
        if got["n"] == stopped:
            break
        stopped, rest, heavy = got["n"], first["pot"] - int(got["words"]), first["heavy"] - got["weight"]
    full = full if heavy else F.lit(True)
    target = F.when(full, bound.cast("double")).otherwise((F.lit(rest) * F.col("weight")).cast("double") / F.lit(float(heavy or 1)))
    copies = F.when(F.col("source_size") == 0, F.lit(0.0)).when(full, F.lit(float(most))).otherwise(F.least(target / F.col("source_size"), F.lit(float(most))))
    return ranked.select("source", "source_size", "weight", target.alias("target"), copies.cast(EXACT).alias("copies"))


def _settle(rows: DataFrame, near: float) -> DataFrame:
    """rows (grp, place, size, target, expected, copies, ...) with the copies of some rows rounded the other way.

    For each source whose words miss the target by more than `near` of it: from the largest row down, every row that was
    rounded to the wrong side and is no larger than what is still missing is rounded to the other. Rows taken one behind
    the other are found at once from running sums: a round finds where the next such run begins and where it ends, for
    all sources, in two aggregations, and what is missing about halves from round to round.
    """
    taken = rows.groupBy("grp").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"))
    miss = F.col("target") - F.col("taken")
    state = taken.filter(F.abs(miss) > near * F.col("target")).select("grp", (miss > 0).alias("up"), F.floor(F.abs(miss)).cast("long").alias("left"), F.lit(-1).cast("long").alias("at"))
    state = stored(state, "missing")
    if state.isEmpty():
        return rows
    wrong = F.when(F.col("up"), F.col("copies") < F.col("expected")).otherwise(F.col("copies") > F.col("expected"))
    some = rows.join(state.select("grp", "up"), "grp").filter(wrong & (F.col("size") > 0)).select("grp", "place", "size", "up")
    some = stored(running(some, {"total": F.col("size")}, [-F.col("size"), F.col("place")], by=["grp"], number="k"), "rounded")
    runs, state = None, state.drop("up")
    while True:
        begin = some.join(state, "grp").filter((F.col("k") > F.col("at")) & (F.col("size") <= F.col("left")))
        begin = begin.groupBy("grp").agg(F.min(F.struct("k", (F.col("total") - F.col("size")).alias("base"))).alias("b"), F.first("left").alias("left"))
        begin = begin.select("grp", "left", F.col("b.k").alias("first"), "b.base")
        end = some.join(begin, "grp").filter((F.col("k") >= F.col("first")) & (F.col("total") - F.col("base") <= F.col("left")))
        end = end.groupBy("grp", "first", "base", "left").agg(F.max(F.struct("k", "total")).alias("e"))
        found = stored(end.select("grp", "first", F.col("e.k").alias("at"), (F.col("left") - F.col("e.total") + F.col("base")).alias("left")), "runs")
        if found.isEmpty():
            break
        runs = found if runs is None else runs.unionByName(found)
        state = found.select("grp", "left", "at")
    if runs is None:
        return rows
    turned = some.join(runs.select("grp", "first", "at"), "grp").filter(F.col("k").between(F.col("first"), F.col("at")))
    turned = stored(turned.select("grp", "place", F.when(F.col("up"), 1).otherwise(-1).alias("turn")), "turned")
    return rows.join(turned, ["grp", "place"], "left").withColumn("copies", F.col("copies") + F.coalesce("turn", F.lit(0))).drop("turn")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 1, keep: Sequence[str] = (), near: float = NEAR, **options) -> DataFrame:
    """How often each row enters the mix: (id, source, size, source_size, target, copies, *keep), a row for each of df.

    size is the words of the text; options are those of `targets`. Every row of a source expects as many copies as the
    source's target holds its size. These are summed along the source, one random offset (of seed and source) is added,
    and a row is emitted once for each integer that the sum crosses at it: its copies are the expected ones rounded up
    or down, so never more than the bound on the source.

    Rows go by size, upwards through one random half of the source and downwards through the other, so that neighbours
    can stand for each other: the words taken miss the target by less than the size of the largest row, whatever the
    offset, and mostly by far less. Where that is still more than `near` of the target, as in a source of a few rows, some
    rows are rounded the other way, largest first (_settle). Sums run in two levels over ranges, exact decimals all along,
    so a source of any size fills many tasks and reruns agree, however the rows are dealt.

    Null and empty texts have no words and are mixed like others, at no cost; null sources are one source, the last.
    Null ids and repeated rows are rows of their own; of rows that share id and text either may get a copy more. An empty
    table gives no rows. Texts are read once, to be counted and marked; only `keep` travels. Of df's other columns none
    is read.
    """
    out = unused(df.select(*(f"`{c}`" for c in keep)), id_col, source_col, "size", "source_size", "target", "copies")
    if out != [id_col, source_col, "size", "source_size", "target", "copies"]:
        raise ValueError("keep: a column has the name of a result")
    text, named = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    mark = F.md5(F.coalesce(text, F.lit("")))
    half = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(named.cast("string"), F.lit("-")), mark)) < "8"
    held = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(0)
    # Written with a salt, so that rows that are equal in all else are dealt alike however often they are read.
    rows = df.select(named.alias("id"), F.col(f"`{source_col}`").alias("source"), words(text).alias("size"), mark.alias("mark"), half.alias("half"), F.rand(1).alias("salt"), held.alias("held"))
    rows = stored(rows.withColumn("grp", F.coalesce(F.concat(F.lit("+"), "source"), F.lit(""))), "sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **options)
    plan = stored(plan.select(F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")).alias("grp"), "source_size", "target", F.col("copies").alias("expected")), "targets")
    rows = rows.join(plan, "grp")
    along = [F.col("half"), F.when(F.col("half"), -F.col("size")).otherwise(F.col("size")), F.col("id").asc_nulls_first(), F.col("mark"), F.col("salt")]
    rows = running(rows, {"until": F.col("expected")}, along, by=["grp"], number="place")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "grp")), 1, 8), 16, 10)
    offset = (drawn.cast("decimal(10,0)") / F.lit(2**32).cast("decimal(10,0)")).cast(EXACT)
    until = F.col("until").cast("decimal(34,15)") + offset
    copies = (F.floor(until) - F.floor(until - F.col("expected"))).cast("long")
    rows = rows.select("grp", "place", "id", "source", "size", "source_size", "target", "expected", copies.alias("copies"), "held")
    rows = _settle(stored(rows, "mixed"), near)
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", *(F.col("held")[c].alias(c) for c in keep))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as its copies say, numbered from 1 in `copy`."""
    (copy,) = unused(mixed, "copy")
    return mixed.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
