"""A training corpus from `documents`: quality, near duplicates, benchmark passages, secrets, token ids.

STAGES: (name, function) in order; each function takes (spark, docs, sf_dir) and returns what it keeps, with the columns of docs (the
last one: ids). A caller writes each result as Parquet and gives the next stage what it reads back, as run() does.

Rows with a null doc_id pass every filter of their own text; rows with equal ids are one document. Null texts have no words: they
are kept, and encode to no ids. An empty table stays empty. Columns that the stages do not know are carried along, whatever their
names, up to the last stage.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import store
from tideline.llm.decontaminate import contamination
from tideline.llm.minhash import near_duplicates
from tideline.llm.quality import quality
from tideline.llm.queries import contaminated
from tideline.llm.secret_scan import BlobLedger, masked
from tideline.llm.sentence_pieces import encode_pieces


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs lacks."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


#: What the stages of a run have made for themselves, by application and folder.
_left: dict[tuple[str, str], list[str]] = {}


def _cleaned(stage):
    """The stage, which first deletes what the stage before it made for itself: its result is stored by then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = spark.sparkContext.applicationId, sf_dir
        store.release(spark, _left.pop(key, []))
        with store.scope() as made:
            out = stage(spark, docs, sf_dir)
        _left[key] = made
        return out

    return run


def _without(docs: DataFrame, out: DataFrame) -> DataFrame:
    """docs without the rows of out (doc_id, text_hash)."""
    key, text = _free(docs, "out_id"), _free(docs, "out_hash")
    out = out.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text))
    return docs.join(out, same, "left_anti")


@_cleaned
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample rejects go."""
    found = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, found.where("not kept"))


@_cleaned
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    key = _free(docs, "out_id")
    gone = near_duplicates(docs, words=5, percent=80).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id").cast("bigint") == F.col(key), "left_anti")


@_cleaned
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are a twentieth or more go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where(contaminated()))


@_cleaned
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows; all documents stay."""
    ledger = BlobLedger(spark)
    ledger.update(docs)
    key, spans = _free(docs, "blob_id"), _free(docs, "blob_spans")
    found = ledger.blobs().where(F.size("spans") > 0).select(F.col("blob").alias(key), F.col("spans").alias(spans))
    blob = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    joined = docs.join(found, blob == F.col(key), "left")
    text = F.when(F.col(spans).isNotNull(), masked(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    kind = dict(docs.dtypes).get("n_chars")
    new = {"text": text} | ({"n_chars": F.when(F.col(spans).isNotNull(), F.char_length(text).cast(kind)).otherwise(F.col("n_chars"))} if kind else {})
    return joined.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


@_cleaned
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces; parity tells for each document whether the original library gives the same ones."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_ids", "ids", "round_trip", "parity")


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("benchmark", benchmark_stage), ("secrets", secret_stage), ("tokens", token_stage)]

#: None: SQL does not express the classifier and the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result. Of the stages' stored results only the one that it reads is left."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = f"{store.shared_dir(spark)}/stage-{name}-{store.uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        store.release(spark, stored)
        stored.append(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
