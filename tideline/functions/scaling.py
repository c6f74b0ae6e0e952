"""Feature rows to integer coordinates: parsing, scaling, quantising, shifting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = -9999.0


def cleaned(x: Column) -> Column:
    """A number; 0 where it is null, no number or at most -9999."""
    x = x.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x <= MISSING), F.lit(0.0)).otherwise(x)


def feature_rows(lines: DataFrame, dimension: int, mode: str, column: str = "value") -> DataFrame:
    """Lines `id,f1..fd,value,class` to (id, features, target); target is the class or the value, null for -1 and what is no number."""
    parts = F.split(F.col(column), ",")
    rows = lines.where(F.trim(F.col(column)) != "").select(parts.alias("p"))
    target = F.get("p", F.lit(dimension + (2 if mode == "classify" else 1))).try_cast("double")
    features = F.array(*[cleaned(F.get("p", F.lit(i + 1))) for i in range(dimension)])
    return rows.select(F.trim(F.get("p", F.lit(0))).alias("id"), features.alias("features"), F.when(target != -1, target).alias("target"))


def quantised(features: Column, scale: Sequence[float]) -> Column:
    """trunc(x * scale * 10) of each feature, as bigint; casts of doubles to integers cut toward zero."""
    weights = F.array(*[F.lit(float(s)) for s in scale])
    return F.zip_with(features, weights, lambda x, s: (cleaned(x) * s * 10).cast("bigint"))


def shifted(rows: DataFrame, vectors: Sequence[Sequence[int]], q: str = "q") -> DataFrame:
    """A row for each shift: shift_id and p, the coordinates plus the shift's vector."""
    each = F.array(*[F.struct(F.lit(i).alias("shift_id"), F.array(*[F.lit(int(x)).cast("bigint") for x in v]).alias("v")) for i, v in enumerate(vectors)])
    out = rows.withColumn("_s", F.explode(each))
    return out.withColumn("shift_id", F.col("_s.shift_id")).withColumn("p", F.zip_with(q, F.col("_s.v"), lambda a, b: a + b)).drop("_s")
