"""Training series: rolling means, best steps, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import unused
from .scan import running


def drop_gaps(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is neither null nor NaN."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(value))


def rolling_mean(df: DataFrame, run: str, step: str, value: str, parts: int = 10) -> DataFrame:
    """Trailing mean over max(1, rows of the run // parts) rows of the run in step order; NaN and null are passed over.

    The width differs between runs, so running sums are taken in two levels (a run of any length fills many tasks), and
    the sum before the window is looked up by row number, a join that a single run spreads as well as many. A null run
    is a run like another; rows of an equal step are in an open order.
    """
    rn, n, w, total, count, at, total0, count0, run0 = unused(df, "_rn", "_n", "_w", "_s", "_c", "_at", "_s0", "_c0", "_run")
    clean = F.when(~F.isnan(value), F.col(value))
    sums = {total: clean.cast("decimal(30,8)"), count: F.when(clean.isNotNull(), 1).otherwise(0)}
    rows = running(df, sums, [F.col(step).asc_nulls_first()], by=[run], number=rn, total=n)
    rows = rows.withColumn(w, F.greatest(F.lit(1), F.floor(F.col(n) / parts)))
    past = rows.select(F.col(run).alias(run0), F.col(rn).alias(at), F.col(total).alias(total0), F.col(count).alias(count0))
    out = rows.join(past, F.col(run).eqNullSafe(F.col(run0)) & (F.col(rn) - F.col(w) == F.col(at)), "left")
    own = F.coalesce(total, F.lit(0)) - F.coalesce(total0, F.lit(0))
    mean = F.try_divide(own.cast("double"), (F.col(count) - F.coalesce(count0, F.lit(0))).cast("double"))
    return out.withColumn("rolling", mean).drop(rn, n, w, total, count, run0, at, total0, count0)


def best_step(df: DataFrame, run: str, step: str, value: str, largest: bool = False) -> DataFrame:
    """The step of the least (or largest) value of each run, the first on ties."""
    key = -F.col(value) if largest else F.col(value)
    best = drop_gaps(df, value).groupBy(run).agg(F.min(F.struct(key.alias("k"), F.col(step).alias("step"), F.col(value).alias("value"))).alias("b"))
    return best.select(run, "b.step", "b.value")


def as_percent(df: DataFrame, run: str, value: str) -> DataFrame:
    """Multiply a run's values by 100 where its largest is 1 or less: an aggregate per run, joined back."""
    most, run0 = unused(df, "_top", "_run")
    top = df.groupBy(F.col(run).alias(run0)).agg(F.max(F.when(~F.isnan(value), F.col(value))).alias(most))
    both = df.join(top, F.col(run).eqNullSafe(F.col(run0)))
    return both.withColumn(value, F.when(F.col(most) <= 1.0, F.col(value) * 100).otherwise(F.col(value))).drop(most, run0)


def latest_runs(runs: DataFrame, n: int = 3) -> DataFrame:
    """The newest finished runs, by id on ties."""
    return runs.filter("state = 'finished'").orderBy(F.col("created_at").desc(), "id").limit(n)


def progress(df: DataFrame, run: str, step: str, correct: str) -> DataFrame:
    """Accuracy so far in percent, in step order; null until a row of the run is judged.

    Running sums in two levels, so one run of all rows fills as many tasks as many runs.
    """
    hit, rn = unused(df, "_hit", "_rn")
    rows = running(df, {hit: F.col(correct).cast("long")}, [F.col(step).asc_nulls_first()], by=[run], number=rn)
    so_far = 100.0 * F.col(hit).cast("double") / (F.col(rn) + 1).cast("double")
    return rows.withColumn("accuracy_so_far", so_far).drop(hit, rn)


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    return F.try_divide(elapsed.cast("double"), done.cast("double")) * (total - done)
