"""Training and query sets: by position, by fold, by date; and the grid of hours to forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_RANGE = 1_000_000  # rows of a range


def numbered(rows: DataFrame, order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """rows with position (from 0) in the given total order, without a task for all rows: a range sort, counts by partition range, and
    positions within ranges. The ranges are cut at quantiles of the first column, which must be a number; there are as many as give a
    million rows to each, and 64 at least."""
    first = order[0]
    buckets = buckets or max(64, rows.count() // _RANGE + 1)
    cuts = sorted({x for x in rows.approxQuantile(first, [i / buckets for i in range(1, buckets)], min(0.001, 1 / (4 * buckets)))})
    place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(first))) if cuts else F.lit(0)
    placed = rows.withColumn("_b", place)
    counts = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return placed.withColumn("_r", own).join(F.broadcast(starts), "_b").withColumn("position", F.col("_s") + F.col("_r") - 1).drop("_b", "_r", "_s")


def positional_split(rows: DataFrame, order: Sequence[str], train_tenths: int = 9) -> DataFrame:
    """rows with side: S for the first train_tenths * N // 10 in the given order, R for the others."""
    n = rows.count()
    return numbered(rows, order, max(64, n // _RANGE + 1)).withColumn("side", F.when(F.col("position") < train_tenths * n // 10, "S").otherwise("R"))


def fold_column(rows: DataFrame, order: Sequence[str], folds: int) -> DataFrame:
    """rows with fold: i for the rows i * (N // folds) to (i + 1) * (N // folds) - 1, null for the rest, which is never tested."""
    n = rows.count()
    size = max(1, n // folds)
    fold = F.floor(F.col("position") / size).cast("int")
    return numbered(rows, order, max(64, n // _RANGE + 1)).withColumn("fold", F.when(fold < folds, fold))


def fold_sets(rows: DataFrame, folds: int) -> tuple[DataFrame, DataFrame]:
    """All folds at once, as column test_fold: (R, S), R the rows of that fold, S all others."""
    each = rows.withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    inside = F.coalesce(F.col("fold") == F.col("test_fold"), F.lit(False))
    return each.where(inside), each.where(~inside)


def split_by(rows: DataFrame, predicate: Column) -> DataFrame:
    """rows with side: R where the predicate holds, else S; each row goes to one side."""
    return rows.withColumn("side", F.when(F.coalesce(predicate, F.lit(False)), "R").otherwise("S"))


def at_hour_of_month(ts: Column, year: int, month: int, hour: int) -> Column:
    return (F.year(ts) == year) & (F.month(ts) == month) & (F.hour(ts) == hour)


def between_dates(ts: Column, first: str, last: str) -> Column:
    return F.to_date(ts).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def excluded(rows: DataFrame, ts: Column, year: int, month: int, key: Column, ids: Sequence) -> DataFrame:
    """rows outside that month whose key is not among the ids."""
    inside = (F.year(ts) == year) & (F.month(ts) == month)
    return rows.where(~F.coalesce(inside, F.lit(False)) & ~F.coalesce(key.isin(list(ids)), F.lit(False)))


def query_grid(rows: DataFrame, household: str, first: str, days: int) -> DataFrame:
    """(household, ts): each household of rows with each hour of so many days."""
    hours = F.sequence(F.lit(f"{first} 00:00:00").cast("timestamp"), F.lit(f"{first} 00:00:00").cast("timestamp") + F.expr(f"interval {days * 24 - 1} hours"), F.expr("interval 1 hour"))
    return rows.select(household).where(F.col(household).isNotNull()).distinct().withColumn("ts", F.explode(hours))
