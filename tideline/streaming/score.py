"""Scoring a stream of query rows against a static training table, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tideline.config import KnnConfig
from tideline.plans.forecast import forecast


def score_stream(queries: DataFrame, training: DataFrame, config: KnnConfig, path: str, checkpoint: str, exact: bool = True) -> StreamingQuery:
    """queries: a stream of (id, features); predictions go to Parquet under path/batch=<number>. A batch that is run again after a
    failure replaces its own folder, so each query row is scored once."""

    def score(batch: DataFrame, number: int) -> None:
        forecast(batch, training, config, exact).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
