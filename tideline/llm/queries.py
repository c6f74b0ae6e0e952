"""One query for each operator of this subpackage, with production parameters over the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.decontaminate import contamination
from tideline.llm.language import identify, train
from tideline.llm.licenses import license_scan
from tideline.llm.media import read_media, text_media
from tideline.llm.minhash import near_duplicates
from tideline.llm.sentence_pieces import encode_pieces
from tideline.llm.oracles import ORACLE_SQL  # noqa: F401
from tideline.llm.quality import quality
from tideline.llm.secret_scan import BASE_RULES, BlobLedger, listed
from tideline.llm.store import written
from tideline.llm.substring_dedup import remove_repeats
from tideline.llm.token_files import read_token_files, token_index, write_token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """ledger: a path that keeps the ledger from run to run; without one it begins empty."""
    found = BlobLedger(spark, ledger).scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs.where(~held_out))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "log_weight", "score", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=13, gram=5)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def contaminated():
    """A twentieth of the words at least is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_media(written(text_media(_table(spark, sf_dir, "documents")), "media"))
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path, bounds = write_token_files(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_index(read_token_files(spark, path), bounds)


def op8_sentence_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    coded = encode_pieces(_table(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_ids", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip", "parity")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_table(spark, sf_dir, "documents"), width=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(license_scan(_table(spark, sf_dir, "documents")))


def license_digest(found: DataFrame) -> DataFrame:
    places = F.transform(F.filter("matches", lambda m: m["exact"]), lambda m: m["start"])
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        labels(F.filter("matches", lambda m: m["exact"])).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_media_columns": op5_media_columns,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_token_files": op7_token_files,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_license_scan": op10_license_scan,
}