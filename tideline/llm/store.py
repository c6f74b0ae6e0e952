"""Shared storage, input sizes and row blocks for the operators of this subpackage."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
_scopes: list[list[str]] = [[]]


def _drop_local() -> None:
    for path in _local:
        shutil.rmtree(path, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder serves a local master
    only; a cluster without the setting is an error, since its machines would write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tideline-"))
        atexit.register(_drop_local)
    return _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    _scopes[-1].append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _scopes[-1][-1]


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths that are made inside, for release() once nothing reads them any more."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.pop()


def release(spark: SparkSession, made: list[str]) -> None:
    """Delete what a scope has written to the shared folder. A result that is not stored yet may still read it."""
    while made:
        at = spark._jvm.org.apache.hadoop.fs.Path(made.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends there and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def byte_blocks(docs: DataFrame, each: int) -> tuple[int, list[int]]:
    """For docs (doc_id, text) the number n of blocks of about `each` bytes of text, the session's shuffle partitions at least, and
    n - 1 or fewer ascending ids that part them. A text counts as often as it has sixteenths of a block, so long texts fill blocks of
    their own. The bounds take 8 bytes a block on the driver and in the plan."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    total = docs.agg(F.sum(size.cast("bigint")).alias("n")).first()["n"] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / each))
    if n < 2:
        return n, []
    weighed = docs.where("doc_id is not null").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(size * 16 / each).cast("int"))).alias("part")).select("doc_id")
    return n, sorted({int(x) for x in weighed.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))})


def block_of(column: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below the value, found by binary search, plus 1: smaller values never get larger blocks. Null: 0."""
    if not bounds:
        return F.when(column.isNull(), 0).otherwise(1).cast("int")
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    cuts = F.array(*[F.lit(x) for x in bounds]) if len(bounds) < 50 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, s: F.when(F.coalesce(F.get(cuts, low + s - 1) <= column, F.lit(False)), low + s).otherwise(low))
    return F.when(column.isNull(), 0).otherwise(found + 1).cast("int")
