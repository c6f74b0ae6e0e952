"""Runs made of the operators: neighbours by a configuration, two-stage forecasts, cross-validation, the final series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.config import CLASSIFY, KnnConfig
from tideline.functions.calendar import calendar_columns
from tideline.functions.scaling import cleaned, quantised
from tideline.operators import knn, lookups, metrics, predict, splits

FEATURES = ("hour", "timezone", "day_of_week", "month", "season", "weekend", "customer_category", "customer", "customer_monthly", "day_of_month")


def extract_features(readings: DataFrame, tables: dict[str, DataFrame], drop_outliers: bool) -> DataFrame:
    """Readings (id, household, ts, value, class) to (id, household, ts, features, value, class): ten codes in the order of FEATURES.

    tables: outliers (household), codes (key, code) named hour, timezone, day_of_week, month, season, day_of_month, and
    categories (key, households), hourly (hour, household, code), monthly (household, code)."""
    rows = lookups.without_outliers(readings, tables["outliers"]) if drop_outliers else readings
    rows = rows.where("ts is not null").select(*[c for c in ("id", "household", "ts", "value", "class") if c in rows.columns], *calendar_columns(F.col("ts")))
    rows = lookups.with_customers(rows, tables["categories"], tables["hourly"], tables["monthly"])
    for name in ("hour", "timezone", "day_of_week", "month", "season", "day_of_month"):
        rows = lookups.with_codes(rows, tables[name], name, f"{name}_code")
    code = lambda n: F.col(f"{n}_code" if f"{n}_code" in rows.columns else n).cast("double")
    return rows.select(*[c for c in ("id", "household", "ts", "value", "class") if c in rows.columns], F.array(*[code(n) for n in FEATURES]).alias("features"))


def neighbours(r: DataFrame, s: DataFrame, config: KnnConfig, exact: bool = False) -> DataFrame:
    """r (id, features), s (id, features, target) to the k nearest, exactly or along the curve."""
    of = lambda df: df.select("id", quantised(F.col("features"), config.scale).alias("q"), *(["target"] if "target" in df.columns else []))
    left, right = of(r), of(s)
    if exact:
        return knn.knn_exact(left, right, config.k)
    offset, bits = knn.coordinate_span(left, right, config.vectors)
    rate = knn.sample_rate(s.count(), config.epsilon)
    return knn.knn_curve(left, right, config.k, config.vectors, config.curve, bits, offset, config.buckets, rate)


def forecast(r: DataFrame, s: DataFrame, config: KnnConfig, exact: bool = False) -> DataFrame:
    near = neighbours(r, s, config, exact)
    return predict.classify(near, config.k, config.classes) if config.mode == CLASSIFY else predict.regress(near)


def positive_rows(r: DataFrame, s: DataFrame, predictions: DataFrame, positive: int = 2) -> tuple[DataFrame, DataFrame]:
    """What the second stage works on: query rows that the first predicts positive, and training rows of the positive class."""
    chosen = predictions.where(F.col("pred") == positive).select(F.col("r_id").alias("id"))
    return r.join(chosen, "id", "left_semi"), s.where(F.col("label") == positive)


def unified(r: DataFrame, s: DataFrame) -> DataFrame:
    return r.unionByName(s, allowMissingColumns=True)


def two_stage(r: DataFrame, s: DataFrame, classify_config: KnnConfig, regress_config: KnnConfig, exact: bool = False, positive: int = 2) -> DataFrame:
    """r (id, features), s (id, features, label, value): classify, then regress the rows predicted positive, then the final series."""
    first = forecast(r, s.withColumn("target", F.col("label")), classify_config, exact)
    left, right = positive_rows(r, s, first, positive)
    return final_series(r, forecast(left, right.withColumn("target", F.col("value")), regress_config, exact))


def final_series(r: DataFrame, predictions: DataFrame) -> DataFrame:
    """r with forecast, 0.0 where nothing is predicted."""
    return r.join(predictions.select(F.col("r_id").alias("id"), F.col("pred").alias("forecast")), "id", "left").withColumn("forecast", F.coalesce("forecast", F.lit(0.0)))


def cross_validate(rows: DataFrame, order: Sequence[str], config: KnnConfig, exact: bool = True) -> DataFrame:
    """Mean measures over the folds: accuracy and f_measure, or r2_explained and rmse. rows: (id, features, target).

    The exact join serves all folds at once: a row meets the rows of other folds only. Curve joins have a training set a fold, and run
    fold by fold."""
    held = splits.fold_column(rows, order, config.folds)
    tested = held.where("fold is not null")
    if exact:
        of = lambda df: df.select("id", "fold", "target", quantised(F.col("features"), config.scale).alias("q"))
        near = knn.knn_exact(of(tested), of(held), config.k, differ="fold")
        found = predict.classify(near, config.k, config.classes) if config.mode == CLASSIFY else predict.regress(near)
        predictions = found.join(tested.select(F.col("id").alias("r_id"), "fold"), "r_id").select("fold", "r_id", "pred")
    else:
        parts = []
        for fold in range(config.folds):
            inside = F.coalesce(F.col("fold") == fold, F.lit(False))
            parts.append(forecast(held.where(inside), held.where(~inside), config, exact).select(F.lit(fold).alias("fold"), "r_id", "pred"))
        predictions = parts[0]
        for p in parts[1:]:
            predictions = predictions.unionByName(p)
    truth = tested.select("fold", "id", "target")
    if config.mode == CLASSIFY:
        both = metrics.accuracy(predictions, truth, by=["fold"]).join(metrics.f_measure(predictions, truth, by=["fold"]), "fold")
        return both.agg(F.avg("accuracy").alias("accuracy"), F.avg("f_measure").alias("f_measure"))
    both = metrics.r_squared(predictions, truth, by=["fold"]).join(metrics.rmse(predictions, truth, by=["fold"]), "fold")
    return both.agg(F.avg("r2_explained").alias("r2_explained"), F.avg("rmse").alias("rmse"))


def score_scales(r: DataFrame, s: DataFrame, scales: Sequence[Sequence[int]], config: KnnConfig) -> DataFrame:
    """(candidate, score) of each list of scales, all in one plan: accuracy, or r2_explained. The list is a generation of a search, so a
    few dozen rows, and each row of r and s goes along once for each of them."""
    spark = r.sparkSession
    tried = F.broadcast(spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(scales)], "candidate bigint, scale array<double>"))
    scaled = F.zip_with("features", "scale", lambda x, w: (cleaned(x) * w * 10).cast("bigint"))
    of = lambda df: df.crossJoin(tried).select("candidate", "id", "target", scaled.alias("q"))
    near = knn.knn_exact(of(r), of(s), config.k, r.count(), s.count(), by="candidate")
    truth = r.crossJoin(tried).select("candidate", "id", "target")
    if config.mode == CLASSIFY:
        found = predict.classify(near, config.k, config.classes, by=["candidate"])
        return metrics.accuracy(found, truth, by=["candidate"]).select("candidate", F.col("accuracy").alias("score"))
    return metrics.r_squared(predict.regress(near, by=["candidate"]), truth, by=["candidate"]).select("candidate", F.col("r2_explained").alias("score"))


def scorer(r: DataFrame, s: DataFrame, config: KnnConfig):
    """What search() scores a generation with: one job. Without a score a candidate counts 0."""

    def score(population: Sequence[Sequence[int]]) -> list[float]:
        found = {x["candidate"]: x["score"] for x in score_scales(r, s, population, config).collect()}  # a row for each candidate
        return [found.get(i) or 0.0 for i in range(len(population))]

    return score
