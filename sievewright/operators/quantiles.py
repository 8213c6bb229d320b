"""Exact quantiles by histograms that narrow to the wanted ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored, unused

#: Buckets of a histogram.
BUCKETS = 1024


def _bucket(v: Column, low: Column, high: Column) -> Column:
    """The bucket of v between low and high, in equal widths; what is infinite or NaN has buckets of its own outside.

    It never falls as v grows, whatever is rounded, so ranks can be counted over buckets.
    """
    # Halves, as the whole width of all doubles is no double.
    part = F.least(F.greatest((v / 2 - low / 2) / (high / 2 - low / 2), F.lit(0.0)), F.lit(1.0))
    inner = F.when(high > low, F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1))).otherwise(0)
    return F.when(F.isnan(v), BUCKETS + 1).when(v == float("inf"), BUCKETS).when(v == float("-inf"), -1).otherwise(inner).cast("int")


def exact(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q): for each group an array of the exact quantiles of `value` as doubles, linear between neighbours, as
    Spark's percentile gives them; null where a group has no value. Without `by` one row, also for an empty table.

    Each quantile is a rank, or lies between two. A pass counts the rows of each rank's interval in BUCKETS buckets, with
    the least and the largest value of each; the bucket that has the rank is its next interval, until that is one value.
    So no task ever holds a group's distinct values, and only counts are shuffled. Of integers up to a million two
    passes are enough; doubles of a like size take six at most, and a pass reads the value and group columns alone.

    Nulls are left out; NaN is larger than any number. Null groups are a group like another.
    """
    if "q" in by:
        raise ValueError("by: a column has the name of the result")
    groups = [F.col(f"`{c}`") for c in by]
    src = df.select(F.struct(*groups, F.lit(0)).alias("g"), F.col(f"`{value}`").cast("double").alias("v")).filter("v is not null")
    rows = stored(src, "values")
    finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    whole = rows.groupBy("g").agg(F.count("*").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    at = F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * (F.col("n") - 1)).alias("place")) for k, p in enumerate(probs)))
    each = whole.select("g", F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"), F.explode(at).alias("at")).select("g", "low", "high", "at.*")
    ranks = each.select("g", "k", "place", "low", "high", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
    # `left` counts the rank within its interval; all: whether the interval is the whole group.
    open_ = stored(ranks.select("g", "k", "place", "rank", F.col("rank").alias("left"), "low", "high", F.lit(True).alias("all")), "ranks")
    found = None
    while not open_.isEmpty():
        spans = open_.select("g", "low", "high", "all").distinct().withColumnsRenamed({"g": "sg", "all": "whole"})
        inside = F.col("g").eqNullSafe(F.col("sg")) & (F.col("whole") | F.col("v").between(F.col("low"), F.col("high")))
        # A group has as many intervals as ranks at most.
        counted = rows.join(spans, inside).groupBy("sg", "low", "high", "whole", _bucket(F.col("v"), F.col("low"), F.col("high")).alias("b"))
        counted = stored(counted.agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")), "histogram")
        order = Window.partitionBy("sg", "low", "high", "whole").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumnsRenamed({"low": "sl", "high": "sh"})
        same = F.col("g").eqNullSafe(F.col("sg")) & (F.col("low") == F.col("sl")) & (F.col("high") == F.col("sh")) & (F.col("all") == F.col("whole"))
        hit = open_.join(counted, same & (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("n")))
        hit = stored(hit.select("g", "k", "place", "rank", (F.col("left") - F.col("before")).alias("left"), F.col("least").alias("low"), F.col("most").alias("high"), F.lit(False).alias("all")), "ranks")
        done = hit.filter("low = high")
        found = done if found is None else found.unionByName(done)
        open_ = hit.filter("low <> high")
    if found is None:
        none = df.select(*groups).distinct() if by else df.sparkSession.range(1).select()
        return none.withColumn("q", F.lit(None).cast("array<double>"))
    pair = found.groupBy("g", "k").agg(F.first("place").alias("place"), F.min_by("low", "rank").alias("a"), F.max_by("low", "rank").alias("b"), F.min("rank").alias("ra"), F.max("rank").alias("rb"))
    between = F.when(F.col("ra") == F.col("rb"), F.col("a")).otherwise((F.col("rb") - F.col("place")) * F.col("a") + (F.col("place") - F.col("ra")) * F.col("b"))
    out = pair.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", between.alias("q")))), lambda x: x["q"]).alias("q"))
    if not by:
        return out.select("q")
    every = df.select(*(c.alias(name) for c, name in zip(groups, by))).distinct()
    key, got = unused(every, "_key", "_got")
    same = F.struct(*(F.col(f"`{c}`") for c in by), F.lit(0)).eqNullSafe(F.col(key))
    return every.join(out.select(F.col("g").alias(key), F.col("q").alias(got)), same, "left").select(*(f"`{c}`" for c in by), F.col(got).alias("q"))
