"""Readers and writers: feature rows, raw readings, JSON code tables, results. Paths go through Spark's file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.calendar import consumption_class, parsed_reading_time, reading_key
from tideline.functions.scaling import feature_rows

#: The code tables of a data set, by file.
CODE_TABLES = ("outliers", "hour_codes", "timezone_codes", "day_codes", "month_codes", "season_codes", "customer_category_codes", "customer_codes", "customer_category_monthly_codes", "day_of_month_codes")


def read_feature_rows(spark: SparkSession, path: str, dimension: int, mode: str, header: bool = False) -> DataFrame:
    lines = spark.read.text(path)
    return feature_rows(lines.where(~F.lower("value").startswith("id,")) if header else lines, dimension, mode)


def read_readings(spark: SparkSession, path: str, header: bool = False, class_column: int = 2, value_column: int = 3) -> DataFrame:
    """`household;dd/MM/yyyy HH...;c2;c3` to (id, household, ts, value, class). Amounts that are missing or no number are null."""
    schema = "household string, at string, c2 string, c3 string"
    rows = spark.read.schema(schema).option("sep", ";").option("header", header).csv(path)
    ts, amount = parsed_reading_time(F.col("at")), lambda i: F.col(f"c{i}").try_cast("double")
    return rows.select(reading_key(F.col("household"), ts).alias("id"), "household", ts.alias("ts"), amount(value_column).alias("value"), consumption_class(amount(class_column)).alias("class"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """The JSON object of a file's first line, {key: code}, as (key, code)."""
    return _entries(spark, path, "map<string,string>", "code").withColumn("code", F.col("code").try_cast("double"))


def read_code_lists(spark: SparkSession, path: str) -> DataFrame:
    """{key: [household, ...]} as (key, households)."""
    return _entries(spark, path, "map<string,array<string>>", "households")


def read_nested_codes(spark: SparkSession, path: str) -> DataFrame:
    """{hour: {household: code}} as (hour, household, code)."""
    rows = _entries(spark, path, "map<string,map<string,string>>", "inner").withColumnRenamed("key", "hour")
    return rows.select("hour", F.explode("inner").alias("household", "code")).withColumn("code", F.col("code").try_cast("double"))


#: A code table's file and the name that features know it by.
_CODES = {"hour_codes": "hour", "timezone_codes": "timezone", "day_codes": "day_of_week", "month_codes": "month", "season_codes": "season", "day_of_month_codes": "day_of_month"}


def read_code_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All code tables of a folder, as extract_features takes them. Keys of hours, days and months are numbers, zero-padded or not."""
    at = lambda name: f"{folder}/{name}.txt"
    number = lambda c: F.col(c).try_cast("int")
    out = {name: read_codes(spark, at(file)).select(number("key").alias("key"), "code") for file, name in _CODES.items()}
    out["outliers"] = read_code_lists(spark, at("outliers")).where("key = '0'").select(F.explode("households").alias("household"))
    out["categories"] = read_code_lists(spark, at("customer_category_codes"))
    out["hourly"] = read_nested_codes(spark, at("customer_codes")).withColumn("hour", number("hour"))
    out["monthly"] = read_codes(spark, at("customer_category_monthly_codes")).withColumnRenamed("key", "household")
    return out


def feature_lines(rows: DataFrame) -> DataFrame:
    """(id, features, value, class) as `id,f1..fd,value,class`, -1 where a value or class is unknown."""
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).cast("string") if c in rows.columns else F.lit("-1.0")
    numbers = F.array_join(F.transform("features", lambda x: x.cast("string")), ",")
    return rows.select(F.concat_ws(",", F.col("id").cast("string"), numbers, known("value"), known("class")).alias("value"))


def keyed_series_lines(series: DataFrame) -> DataFrame:
    """(key `household_dd/MM/yyyy-HH`, value) as `household;dd/MM/yyyy HH:00:00;value`."""
    household, at = F.regexp_extract("key", "^(.*)_([^_]*)$", 1), F.regexp_extract("key", "^(.*)_([^_]*)$", 2)
    when = F.concat(F.substring(at, 1, 10), F.lit(" "), F.substring(at, 12, 2), F.lit(":00:00"))
    return series.select(F.concat_ws(";", household, when, F.col("value").cast("string")).alias("value"))


def _entries(spark: SparkSession, path: str, kind: str, name: str) -> DataFrame:
    line = spark.read.text(path, wholetext=True).select(F.split("value", "\n")[0].alias("j"))
    return line.select(F.explode(F.from_json("j", kind)).alias("key", name))


def write_lines(lines: DataFrame, path: str, single_file: bool = False) -> None:
    """Text lines (column value), replacing what is there; a single file only where a reader needs one."""
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def series_lines(series: DataFrame) -> DataFrame:
    """(household, ts, value) as `household;date HH:00:00;value`."""
    return series.select(F.concat_ws(";", F.col("household").cast("string"), F.date_format("ts", "dd/MM/yyyy HH:00:00"), F.col("value").cast("string")).alias("value"))


def write_vectors(spark: SparkSession, vectors, path: str) -> None:
    write_lines(spark.createDataFrame([(i, " ".join(map(str, v))) for i, v in enumerate(vectors)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value"), path)


def read_vectors(spark: SparkSession, path: str) -> tuple[tuple[int, ...], ...]:
    """A line for each shift, so a handful of lines."""
    return tuple(tuple(map(int, r["value"].split())) for r in spark.read.text(path).collect())
