"""Quality of predictions. Inputs: predictions (r_id, pred) and truth (id, target); rows whose truth is null do not count.
Each measure is one aggregation; `by` gives it for each value of columns that both inputs have (folds, candidates)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _met(predictions: DataFrame, truth: DataFrame, by: Sequence[str]) -> DataFrame:
    known = truth.where("target is not null").select(*by, F.col("id").alias("r_id"), F.col("target").alias("real"))
    return known.join(predictions.select(*by, "r_id", "pred"), [*by, "r_id"], "left")


def _per(rows: DataFrame, by: Sequence[str], *columns: Column) -> DataFrame:
    return rows.groupBy(*by).agg(*columns) if by else rows.agg(*columns)


def accuracy(predictions: DataFrame, truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per cent of the rows predicted right; a row without a prediction is wrong."""
    return _per(_met(predictions, truth, by), by, (100 * F.sum(F.when(F.col("pred") == F.col("real"), 1).otherwise(0)) / F.count("*")).alias("accuracy"))


def f_measure(predictions: DataFrame, truth: DataFrame, positive: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall and f_measure of the positive class; null for 0 / 0."""
    p, r = F.col("pred") == positive, F.col("real") == positive
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = _per(_met(predictions, truth, by), by, n(p & r).alias("tp"), n(p & ~r).alias("fp"), n(r & ~F.coalesce(p, F.lit(False))).alias("fn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return sums.select(*by, precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f_measure"))


def rmse(predictions: DataFrame, truth: DataFrame, nonzero_only: bool = True, by: Sequence[str] = ()) -> DataFrame:
    rows = _met(predictions, truth, by).where("pred is not null" + (" and real <> 0" if nonzero_only else ""))
    return _per(rows, by, F.sqrt(F.avg((F.col("pred") - F.col("real")) * (F.col("pred") - F.col("real")))).alias("rmse"))


def r_squared(predictions: DataFrame, truth: DataFrame, nonzero_only: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """r2_explained = 1 - sum (pred - mean)**2 / sum (real - mean)**2, and r2_standard = 1 - sum (pred - real)**2 / sum (real -
    mean)**2; the mean is that of all known rows (of a value of `by`: folds or candidates, a few dozen, so their means are broadcast), the sums are over those with a prediction (and, by default, a truth other than 0)."""
    rows = _met(predictions, truth, by)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.avg("real").alias("mean")))) if not by else rows.join(F.broadcast(rows.groupBy(*by).agg(F.avg("real").alias("mean"))), list(by))
    rows = rows.where("pred is not null" + (" and real <> 0" if nonzero_only else ""))
    square = lambda a, b: F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    sums = _per(rows, by, square("pred", "mean").alias("ess"), square("pred", "real").alias("rss"), square("real", "mean").alias("tss"))
    return sums.select(*by, (1 - F.try_divide("ess", "tss")).alias("r2_explained"), (1 - F.try_divide("rss", "tss")).alias("r2_standard"))
