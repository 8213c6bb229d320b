"""Metrics over predictions: one aggregation each, no row loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FIXED_BUCKETS, fixed_bucket, quartile_bucket
from ..storage import unused
from .quantiles import exact


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    return ratio(a * F.lit(100.0), b)


def _n(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def confusion(df: DataFrame, true: str, pred: str, *by: str, failed: str = "-1") -> DataFrame:
    """Counts of outputs, failures, right ones, and of class 1: tp, fp, fn. A prediction of -1 or null is a failure."""
    t, p = F.col(true), F.col(pred)
    ok = p.isNotNull() & (p != int(failed))
    return df.groupBy(*by).agg(
        _n(ok).alias("output_count"),
        _n(~ok | ok.isNull()).alias("failure_count"),
        _n(ok & (p == t)).alias("correct_count"),
        _n(ok & (p == 1) & (t == 1)).alias("true_positives"),
        _n(ok & (p == 1) & (t == 0)).alias("false_positives"),
        _n(ok & (p == 0) & (t == 1)).alias("false_negatives"),
    )


def binary_metrics(counts: DataFrame, *by: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 in percent, from confusion counts; 0 where undefined."""
    p = percent(F.col("true_positives"), F.col("true_positives") + F.col("false_positives"))
    r = percent(F.col("true_positives"), F.col("true_positives") + F.col("false_negatives"))
    out = counts.select(*by, percent(F.col("correct_count"), F.col("output_count")).alias("accuracy"), p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1_score", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_counts(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(class, tp, n_true, n_pred) of every class that occurs as truth or prediction.

    Truth and prediction are counted in pairs first, so no more rows than pairs of classes are exploded.
    """
    pairs = df.filter(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("t").cast("long").alias("class"), F.lit(1).alias("is_t"), F.lit(0).alias("is_p")), F.struct(F.col("p").cast("long").alias("class"), F.lit(0).alias("is_t"), F.lit(1).alias("is_p")))
    rows = pairs.select("t", "p", "n", F.explode(sides).alias("s")).select("t", "p", "n", "s.*")
    return rows.groupBy("class").agg(
        F.sum(F.when((F.col("t") == F.col("p")) & (F.col("is_t") == 1), F.col("n")).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.col("n") * F.col("is_t")).cast("long").alias("n_true"),
        F.sum(F.col("n") * F.col("is_p")).cast("long").alias("n_pred"),
    )


def per_class(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(class, precision, recall, f1_score, support), fractions."""
    c = class_counts(df, true, pred)
    out = c.select("class", ratio(F.col("tp"), F.col("n_pred")).alias("precision"), ratio(F.col("tp"), F.col("n_true")).alias("recall"), F.col("n_true").alias("support"))
    return out.select("class", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1_score"), "support")


def macro_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Unweighted means over all classes that occur, and accuracy, as fractions; macro F1 is the mean of F1s."""
    c = class_counts(df, true, pred)
    p, r = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("n_true"))
    return c.agg(
        ratio(F.sum("tp"), F.sum("n_true")).alias("accuracy"),
        F.coalesce(F.avg(p), F.lit(0.0)).alias("precision"),
        F.coalesce(F.avg(r), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg(ratio(2 * p * r, p + r)), F.lit(0.0)).alias("f1_score"),
    )


def class_report(df: DataFrame, true: str, pred: str, labels: tuple[int, ...] = (0, 1)) -> DataFrame:
    """per_class of fixed labels, then their macro and weighted averages: (name, precision, recall, f1_score, support)."""
    fixed = df.sparkSession.createDataFrame([(x,) for x in labels], "class long")
    rows = fixed.join(per_class(df, true, pred), "class", "left").na.fill(0)
    m = ("precision", "recall", "f1_score")
    named = rows.select(F.col("class").cast("string").alias("name"), *m, F.col("support").cast("long").alias("support"))
    total = F.sum("support").cast("long").alias("support")
    macro = rows.agg(*(F.avg(k).alias(k) for k in m), total).select(F.lit("macro avg").alias("name"), *m, "support")
    weighted = rows.agg(*(ratio(F.sum(F.col(k) * F.col("support")), F.sum("support")).alias(k) for k in m), total)
    return named.unionByName(macro).unionByName(weighted.select(F.lit("weighted avg").alias("name"), *m, "support"))


def value_stats(df: DataFrame, value: str, *by: str, digits: int | None = None, whole_quartiles: bool = False, refined: bool = False) -> DataFrame:
    """Average, least, most and exact quartiles (linear between neighbours); 0 where there are no rows.

    refined: find the quartiles by histograms (quantiles.exact), for values that are mostly distinct, whose aggregation
    buffers would hold every one of them.
    """
    shown = lambda c: c if digits is None else F.round(c, digits)
    own = [F.coalesce(F.avg(value), F.lit(0.0)).alias("avg"), F.coalesce(F.min(value), F.lit(0)).cast("long").alias("min"), F.coalesce(F.max(value), F.lit(0)).cast("long").alias("max")]
    if refined:
        out, found = df.groupBy(*by).agg(*own), exact(df, value, (0.25, 0.5, 0.75), by=by)
        (other,) = unused(out, "_q")
        found = found.select(F.struct(*by).alias(other), "q") if by else found
        out = out.join(found, F.struct(*by).eqNullSafe(F.col(other)), "left").drop(other) if by else out.crossJoin(F.broadcast(found))
    else:
        out = df.groupBy(*by).agg(*own, F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    out = out.withColumn("avg", shown(F.col("avg")))
    for k, name in enumerate(("q1", "q2", "q3")):
        x = F.coalesce(F.col("q")[k], F.lit(0.0))
        out = out.withColumn(name, F.floor(x).cast("long") if whole_quartiles else shown(x))
    return out.drop("q")


def component_stats(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """value_stats of several token columns: (component, avg, min, max, q1, q2, q3)."""
    long = df.unpivot([], columns, "component", "tokens")
    return value_stats(long, "tokens", "component", digits=digits)


def shares(df: DataFrame, *by: str, digits: int | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Counts by group, and percent of all rows (or of those in the same `within` columns)."""
    n = df.groupBy(*by).agg(F.count("*").cast("long").alias("n"))
    p = percent(F.col("n"), F.sum("n").over(Window.partitionBy(*within)))
    return n.withColumn("percent", p if digits is None else F.round(p, digits))


def entailment_class(label: Column) -> Column:
    """Any label as entailment or no_entailment; null stays null."""
    return F.when(F.lower(label.cast("string")).isin("1", "entailment"), "entailment").when(label.isNotNull(), "no_entailment")


def bucket_accuracy(df: DataFrame, tokens: str, correct: str, drop_empty: bool = False) -> DataFrame:
    """The four fixed length buckets with n, correct and accuracy in percent; empty buckets have 0."""
    rows = df.filter(F.col(tokens) > 0) if drop_empty else df
    got = rows.groupBy(fixed_bucket(F.col(tokens)).alias("bucket")).agg(F.count("*").alias("n"), _n(F.col(correct)).alias("correct"))
    fixed = df.sparkSession.createDataFrame([(b,) for b in FIXED_BUCKETS], "bucket string")
    out = fixed.join(got, "bucket", "left").na.fill(0, ["n", "correct"])
    return out.withColumn("accuracy", percent(F.col("correct"), F.col("n")))


def overall_accuracy(buckets: DataFrame) -> DataFrame:
    """Accuracy over all buckets, from their counts."""
    return buckets.agg(F.sum("n").cast("long").alias("n"), percent(F.sum("correct"), F.sum("n")).alias("accuracy"))


def quartile_bucket_accuracy(df: DataFrame, tokens: str, correct: str, refined: bool = False) -> DataFrame:
    """Accuracy by quartile bucket: quartiles first, truncated, as one broadcast row; then one aggregation.

    refined: find the quartiles by histograms (quantiles.exact), for values that are mostly distinct. Only the two columns
    are read, so no name of another can clash.
    """
    rows = df.select(F.col(f"`{tokens}`").alias("tokens"), F.col(f"`{correct}`").alias("correct"))
    if refined:
        q = exact(rows, "tokens", (0.25, 0.5, 0.75)).select(F.transform("q", lambda x: F.floor(x)).alias("q"))
    else:
        q = rows.agg(F.transform(F.percentile("tokens", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))), lambda x: F.floor(x)).alias("q"))
    rows = rows.crossJoin(F.broadcast(q)).withColumn("bucket", quartile_bucket(F.col("tokens"), F.col("q")))
    got = rows.groupBy("bucket").agg(F.count("*").alias("n"), _n(F.col("correct")).alias("correct"))
    return got.withColumn("accuracy", percent(F.col("correct"), F.col("n")))


def extraction_rates(df: DataFrame, true: str = "true_label", old: str = "predicted_label", new: str = "new_label", output: str = "output", original_accuracy: bool = True) -> DataFrame:
    """total_samples (also rows without output), success, failure, and accuracies before and after extraction."""
    has = F.col(output).isNotNull()
    ok = has & F.col(new).isNotNull() & (F.col(new) != -1)
    out = df.agg(
        F.count("*").alias("total_samples"),
        _n(ok).alias("success"),
        _n(has & ~F.coalesce(ok, F.lit(False))).alias("failure"),
        _n(F.col(old) == F.col(true)).alias("old_correct"),
        _n(ok & (F.col(new) == F.col(true))).alias("new_correct"),
    )
    total = F.col("total_samples")
    return out.select(
        "total_samples", "success", "failure",
        percent(F.col("success"), total).alias("success_rate"),
        percent(F.col("old_correct"), total).alias("original_accuracy"),
        percent(F.col("new_correct"), total).alias("new_accuracy"),
        percent(F.col("new_correct"), F.col("success")).alias("strict_accuracy"),
    )


def prediction_changes(df: DataFrame, old: str, new: str) -> DataFrame:
    """Changed predictions, and those from 0 to 1 and back; a failed extraction counts as a change of a known one."""
    o, n = F.col(old), F.col(new)
    return df.agg(_n(~o.eqNullSafe(n)).alias("changed"), _n((o == 0) & (n == 1)).alias("changed_0_to_1"), _n((o == 1) & (n == 0)).alias("changed_1_to_0"))


def method_counts(df: DataFrame, method: str = "method", true: str | None = None) -> DataFrame:
    """Counts by method and, with true, also by true label, in one pass of grouping sets (null label: all)."""
    if true is None:
        return df.groupBy(method).agg(F.count("*").cast("long").alias("n"))
    sets = df.groupingSets([[method], [true, method]], true, method).agg(F.grouping(true).alias("all_labels"), F.count("*").cast("long").alias("n"))
    return sets.select(F.col(true).alias("true_label"), method, F.col("all_labels").cast("int").alias("all_labels"), "n")


def compare_methods(df: DataFrame, models: list[str]) -> DataFrame:
    """(method, n of each model), 0 where a model has none. df: model, method."""
    return df.groupBy("method").pivot("model", models).agg(F.count(F.lit(1)).cast("long")).na.fill(0)


def ordered_names(df: DataFrame, name: str) -> DataFrame:
    """(name, place): the distinct names in lexicographic order, from 1; a few names, not rows."""
    return df.select(name).distinct().withColumn("place", F.row_number().over(Window.orderBy(name)))


def compare_models(**metrics: DataFrame) -> DataFrame:
    """One row for each model; columns that only some have are null for the others, one named model is an error."""
    out = None
    for name, df in metrics.items():
        if "model" in (c.lower() for c in df.columns):
            raise ValueError(f"{name} has a column model already")
        df = df.withColumn("model", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def worker_report(df: DataFrame, true: str, pred: str, worker: str = "worker_id") -> DataFrame:
    """Counts and accuracy of each worker, and of all (null worker), in one rollup."""
    ok = F.col(pred).isNotNull() & (F.col(pred) != -1)
    out = df.rollup(worker).agg(_n(ok).alias("output_count"), _n(ok & (F.col(pred) == F.col(true))).alias("correct_count"))
    return out.withColumn("accuracy", percent(F.col("correct_count"), F.col("output_count")))


def high_quality_share(df: DataFrame, score: str, least: int = 4) -> DataFrame:
    return df.agg(_n(F.col(score) >= least).alias("high"), F.count(score).alias("scored"), percent(_n(F.col(score) >= least), F.count(score)).alias("percent"))


def throughput(samples: Column, seconds: Column) -> Column:
    return ratio(samples, seconds)
