"""python -m tideline [COMMAND] --base-path FOLDER ...

features   FOLDER/R and FOLDER/S, raw readings, and the code tables in FOLDER/codes become FOLDER/RClassification and SClassification
run        FOLDER/R<Mode> against FOLDER/S<Mode>, feature rows, by --mode; the lines go to FOLDER/<Mode>Results (the default)
forecast   both stages: classify, hand the positive rows on (RRegression, SRegression, UnifiedNonZeroDataset), regress, FinalResults
validate   measures of cross-validation over --folds folds of FOLDER/S<Mode>
"""

from __future__ import annotations

import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.config import CLASSIFY, REGRESS, KnnConfig, parse
from tideline.operators import predict
from tideline.plans import forecast as plans
from tideline.plans.search import SearchConfig, search
from tideline.sources import tables

NAMES = {CLASSIFY: "Classification", REGRESS: "Regression"}


def _rows(spark: SparkSession, config: KnnConfig, side: str) -> DataFrame:
    """Feature rows (id, key, features, value, class, target) of a file. The ids are numbers that no two rows share; they are stored, so
    that every plan sees the same ones."""
    path = f"{config.base_path}/{side}{NAMES[config.mode]}"
    rows = tables.read_feature_rows(spark, path, config.dimension, config.mode)
    stored = f"{config.base_path}/work/{side}{NAMES[config.mode]}"
    tables.write_table(rows.withColumnRenamed("id", "key").withColumn("id", F.monotonically_increasing_id()), stored)
    return spark.read.parquet(stored)


def _searched(r: DataFrame, s: DataFrame, config: KnnConfig) -> KnnConfig:
    if not config.search:
        return config
    best = search(plans.scorer(r, s, config), config.scale_domain, SearchConfig(seed=config.seed))[0]
    print(f"best scale {list(best[1])}: {best[0]}")
    return replace(config, scale=best[1])


def features(spark: SparkSession, config: KnnConfig) -> None:
    base = config.base_path
    codes = tables.read_code_tables(spark, f"{base}/codes")
    for side, drop in (("R", False), ("S", True)):
        readings = tables.read_readings(spark, f"{base}/{side}")
        tables.write_lines(tables.feature_lines(plans.extract_features(readings, codes, drop)), f"{base}/{side}Classification")


def run(spark: SparkSession, config: KnnConfig) -> DataFrame:
    r, s = (_rows(spark, config, side) for side in "RS")
    config = _searched(r, s, config)
    found = plans.forecast(r, s, config, config.exact)
    lines = predict.class_lines(found, r, config.classes) if config.mode == CLASSIFY else predict.value_lines(found, r)
    tables.write_lines(lines, f"{config.base_path}/{NAMES[config.mode]}Results")
    return r


def forecast(spark: SparkSession, config: KnnConfig) -> None:
    base, first = config.base_path, replace(config, mode=CLASSIFY)
    r = run(spark, first)
    results = predict.read_class_lines(spark.read.text(f"{base}/ClassificationResults"))
    chosen = results.where("pred = 2").select("key").distinct()
    lines = spark.read.text(f"{base}/RClassification").withColumn("key", F.trim(F.split("value", ",")[0]))
    tables.write_lines(lines.join(chosen, "key", "left_semi").select("value"), f"{base}/RRegression")
    positive = F.get(F.split("value", ","), F.lit(config.dimension + 2)).try_cast("double") == 2
    tables.write_lines(spark.read.text(f"{base}/SClassification").where(positive), f"{base}/SRegression")
    tables.write_lines(spark.read.text(f"{base}/RRegression").union(spark.read.text(f"{base}/SRegression")), f"{base}/UnifiedNonZeroDataset")
    run(spark, replace(config, mode=REGRESS, search=False))
    values = predict.read_value_lines(spark.read.text(f"{base}/RegressionResults")).groupBy("key").agg(F.first("pred").alias("pred"))
    series = r.select("key").join(values, "key", "left").withColumn("value", F.coalesce("pred", F.lit(0.0)))
    tables.write_lines(tables.keyed_series_lines(series), f"{base}/FinalResults", single_file=config.single_file)


def validate(spark: SparkSession, config: KnnConfig) -> None:
    rows = _rows(spark, config, "S").where("target is not null")
    config = _searched(rows, rows, config) if config.search else config
    found = plans.cross_validate(rows, ["id"], config, config.exact).first()
    print(" ".join(f"{name} {found[name]}" for name in found.asDict()))


COMMANDS = {"features": features, "run": run, "forecast": forecast, "validate": validate}


def main(argv: list[str]) -> None:
    command, rest = (argv[0], argv[1:]) if argv and argv[0] in COMMANDS else ("run", argv)
    config = parse(rest)
    COMMANDS[command](SparkSession.builder.appName("tideline").getOrCreate(), config)


if __name__ == "__main__":
    main(sys.argv[1:])
