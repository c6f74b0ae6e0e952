"""Quantile ranges of an ordered key and the assignment of rows to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_bounds(rows: DataFrame, groups: Sequence[str], key: str, buckets: int, sample_rate: float = 1.0, seed: int = 1) -> DataFrame:
    """(groups..., bounds): the buckets - 1 first keys of the second to last of `buckets` equal runs of keys; null keys do not count.

    With a sample rate below 1 the runs are those of rows chosen by a hash of the key, the same in any partitioning."""
    some = rows.where(F.col(key).isNotNull())
    if sample_rate < 1:
        some = some.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 32)) < int(sample_rate * (1 << 32)))
    w = Window.partitionBy(*groups).orderBy(key)
    firsts = some.select(*groups, key, F.ntile(buckets).over(w).alias("_b")).groupBy(*groups, "_b").agg(F.min(key).alias("_k"))
    return firsts.groupBy(*groups).agg(F.array_sort(F.collect_list(F.when(F.col("_b") > 1, F.col("_k")))).alias("bounds"))


def bucket_column(bounds: DataFrame, group: str, key: str) -> Column:
    """The number of bounds at or below the key. bounds has a row for each group and `buckets` values at most: they become literals."""
    cases = None
    for r in bounds.select(group, "bounds").collect():
        cuts = F.array(*[F.lit(x) for x in r["bounds"]]) if r["bounds"] else F.array().cast("array<string>")
        place = F.size(F.filter(cuts, lambda c: c <= F.col(key)))
        cases = (F if cases is None else cases).when(F.col(group) == r[group], place)
    return F.coalesce(cases, F.lit(0)) if cases is not None else F.lit(0)


def assigned(rows: DataFrame, bounds: Sequence, key: str, halo: int = 0) -> DataFrame:
    """rows with bucket; with a halo, a row also goes to so many buckets on each side."""
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda c: c <= F.col(key))) if bounds else F.lit(0)
    if not halo:
        return rows.withColumn("bucket", place)
    return rows.withColumn("bucket", F.explode(F.sequence(F.greatest(F.lit(0), place - halo), F.least(F.lit(len(bounds)), place + halo))))
