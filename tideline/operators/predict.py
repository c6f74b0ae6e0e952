"""Predictions from neighbours (r_id, s_id, d2, target, rank)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OK, ERROR = "OK", "ERROR"


def weighted(neighbours: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """neighbours with dist and weight: 1 if all distances of a query row are equal, else (max - dist) / (max - min)."""
    w = Window.partitionBy(*by, "r_id")
    rows = neighbours.withColumn("dist", F.sqrt(F.col("d2").cast("double")))
    near, far = F.min("dist").over(w), F.max("dist").over(w)
    return rows.withColumn("weight", F.when(near == far, F.lit(1.0)).otherwise((far - F.col("dist")) / (far - near)))


def class_votes(neighbours: DataFrame) -> DataFrame:
    """(r_id, label, votes): summed weights."""
    return weighted(neighbours).groupBy("r_id", F.col("target").cast("int").alias("label")).agg(F.sum("weight").alias("votes"))


def classify(neighbours: DataFrame, k: int, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., r_id, status, pred, p_1..p_n): the class of most votes, the lowest of equals, and each class's share of the votes.
    Fewer than k neighbours: status ERROR and nulls."""
    rows = weighted(neighbours, by).withColumn("label", F.col("target").cast("int"))
    sums = [F.coalesce(F.sum(F.when(F.col("label") == c, F.col("weight"))), F.lit(0.0)).alias(f"v{c}") for c in range(1, classes + 1)]
    per = rows.groupBy(*by, "r_id").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), *sums)
    votes = F.array(*[F.round(F.col(f"v{c}"), 9) for c in range(1, classes + 1)])
    enough = F.col("n") >= k
    shares = [F.when(enough, F.when(F.col("total") > 0, F.col(f"v{c}") / F.col("total")).otherwise(0.0)).alias(f"p_{c}") for c in range(1, classes + 1)]
    pred = F.when(enough, F.array_position(votes, F.array_max(votes))).cast("int")
    return per.select(*by, "r_id", F.when(enough, OK).otherwise(ERROR).alias("status"), pred.alias("pred"), *shares)


def regress(neighbours: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., r_id, pred): the mean of the neighbours' values."""
    return neighbours.groupBy(*by, "r_id").agg(F.avg("target").alias("pred"))


def _headed(predictions: DataFrame, queries: DataFrame) -> DataFrame:
    """The predictions of all query rows (id, target, and key where the id is not the name to print), with head: `key:target`, the
    target -1.0 where it is unknown."""
    name = F.col("key" if "key" in queries.columns else "id").cast("string")
    head = F.concat(F.coalesce(name, F.lit("")), F.lit(":"), F.coalesce(F.col("target").cast("double"), F.lit(-1.0)).cast("string"))
    return queries.select(F.col("id").alias("r_id"), head.alias("head")).join(predictions, "r_id", "left")


def class_lines(predictions: DataFrame, queries: DataFrame, classes: int) -> DataFrame:
    """`key:target | Result 2.0 | Class 1 probability p | ... | ` for each query row, or `key:target ERROR!` where there are too few
    neighbours, as column value."""
    rows = _headed(predictions, queries)
    shares = [F.concat(F.lit(f"Class {c} probability "), F.col(f"p_{c}").cast("string"), F.lit(" | ")) for c in range(1, classes + 1)]
    known = F.concat(F.col("head"), F.lit(" | Result "), F.col("pred").cast("double").cast("string"), F.lit(" | "), *shares)
    return rows.select(F.when(F.col("status") == OK, known).otherwise(F.concat(F.col("head"), F.lit(" ERROR!"))).alias("value"))


def value_lines(predictions: DataFrame, queries: DataFrame) -> DataFrame:
    """`key:target | Result: v` for each query row, v NaN without neighbours, as column value."""
    value = F.coalesce(F.col("pred"), F.lit(float("nan"))).cast("string")
    return _headed(predictions, queries).select(F.concat(F.col("head"), F.lit(" | Result: "), value).alias("value"))


def read_class_lines(lines: DataFrame) -> DataFrame:
    """(key, target, status, pred, p_1..) of class_lines, the probabilities as an array: probabilities."""
    head = F.regexp_extract("value", r"^(.*?)( \| Result | ERROR!$)", 1)
    pred = F.regexp_extract("value", r" \| Result ([0-9.]+) \| ", 1)
    shares = F.regexp_extract_all("value", F.lit(r"Class \d+ probability ([^ ]+) \|"), F.lit(1))
    key, target = F.regexp_extract(head, "^(.*):([^:]*)$", 1), F.regexp_extract(head, "^(.*):([^:]*)$", 2).try_cast("double")
    return lines.select(key.alias("key"), F.when(target != -1, target).alias("target"), F.when(pred != "", OK).otherwise(ERROR).alias("status"), pred.try_cast("double").cast("int").alias("pred"), F.transform(shares, lambda x: x.cast("double")).alias("probabilities"))


def read_value_lines(lines: DataFrame) -> DataFrame:
    """(key, target, pred) of value_lines; NaN is null."""
    part = lambda i: F.regexp_extract("value", r"^(.*):([^:]*) \| Result: (.*)$", i)
    number = lambda c: F.when(~F.isnan(c), c)
    target = part(2).try_cast("double")
    return lines.select(part(1).alias("key"), F.when(target != -1, target).alias("target"), number(part(3).try_cast("double")).alias("pred"))
