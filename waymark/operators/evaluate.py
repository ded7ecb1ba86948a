"""Evaluation of predictions against truth, with the three zero-denominator rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: str, predicted: str, key: str | None = None) -> DataFrame:
    """tp, fp, fn, tn (of 0/1 columns), per key or overall."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    sums = (count(t & p, "tp"), count(~t & p, "fp"), count(t & ~p, "fn"), count(~t & ~p, "tn"))
    return rows.groupBy(*([key] if key else [])).agg(*sums)


def ratio(over: Column, under: Column, empty: Column | float = 0.0) -> Column:
    return F.when(under > 0, over / under).otherwise(empty if isinstance(empty, Column) else F.lit(empty))


def with_metrics(c: DataFrame) -> DataFrame:
    """Precision, recall, f1, iou, accuracy. An empty side counts 1 if the other is empty;
    the accuracy of nothing is 0."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    both = F.when(tp + fp + fn == 0, 1.0).otherwise(0.0)
    c = c.withColumn("precision", ratio(tp, tp + fp, both)).withColumn("recall", ratio(tp, tp + fn, both))
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f1", ratio(2 * p * r, p + r)).withColumn("iou", ratio(tp, tp + fp + fn, both)).withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))


#: Additive supports of a task's class: areas, axis lengths and integrals of distances.
SUPPORTS = "tp double, fp double, fn double, tn double, truth_length double, predicted_length double, truth_integral double, predicted_integral double"


def pooled(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of additive supports over tasks (per keys, or of all), then ratios of the sums (0
    where empty); of lengths and integrals, where rows have them, the mean offset from truth
    to prediction, back, and of both (null unless both sides have a length)."""
    held = [x.split()[0] for x in SUPPORTS.split(", ")]
    held = held if set(held) <= set(rows.columns) else held[:4]
    s = rows.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in held], F.count("*").alias("tasks"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    s = s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * p * r, p + r)).withColumn("iou", ratio(tp, tp + fp + fn))
    if len(held) == 4:
        return s
    over, under = ("truth_integral", "predicted_integral"), ("truth_length", "predicted_length")
    both = (F.col(under[0]) > 0) & (F.col(under[1]) > 0)
    s = s.withColumn("truth_to_predicted", F.when(both, F.col(over[0]) / F.col(under[0]))).withColumn("predicted_to_truth", F.when(both, F.col(over[1]) / F.col(under[1])))
    return s.withColumn("mean_offset", F.when(both, (F.col(over[0]) + F.col(over[1])) / (F.col(under[0]) + F.col(under[1]))))
