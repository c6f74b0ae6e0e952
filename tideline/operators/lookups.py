"""Code tables joined to readings. Code tables have a row for each code or household of a fixed registry; Spark broadcasts them where
they are below its own threshold and shuffles beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_outliers(rows: DataFrame, outliers: DataFrame, household: str = "household") -> DataFrame:
    """rows whose household is not among the outliers (household)."""
    return rows.join(outliers.select(household).distinct(), household, "left_anti")


def with_codes(rows: DataFrame, codes: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the code (key, code) of a column, as name. A value without a code is an error, found when rows are read."""
    joined = rows.join(codes.select(F.col("key").cast("string").alias("_k"), F.col("code").alias(name)), F.col(key).cast("string") == F.col("_k"), "left").drop("_k")
    return joined.withColumn(name, F.coalesce(name, F.raise_error(F.concat(F.lit(f"no {name} for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(dict(joined.dtypes)[name])))


def membership(categories: DataFrame) -> DataFrame:
    """(key, households array) to (household, customer_category): key + 1, the smallest where there are several."""
    each = categories.select((F.col("key").cast("int") + 1).alias("c"), F.explode("households").alias("household"))
    return each.groupBy("household").agg(F.min("c").alias("customer_category"))


def with_customers(rows: DataFrame, categories: DataFrame, hourly: DataFrame, monthly: DataFrame, household: str = "household", hour: str = "hour") -> DataFrame:
    """rows with customer_category (household), customer (hour and household) and customer_monthly (household); rows that lack any
    of them are dropped."""
    out = rows.join(membership(categories), household)
    out = out.join(hourly.select(hour, household, F.col("code").alias("customer")), [hour, household])
    return out.join(monthly.select(household, F.col("code").alias("customer_monthly")), household)
