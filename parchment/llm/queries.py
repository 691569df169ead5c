"""The queries of this folder's operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each record of the shards, read back from them: its slot, place and the digest of its ids' bytes."""
    from .training_order import training_order

    return training_order(_table(spark, sf_dir, "documents"), with_ids=False)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest, find_secrets

    return digest(find_secrets(_table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def held_out(id_col) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 by 4."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import encode_pieces, with_digests

    return with_digests(encode_pieces(_table(spark, sf_dir, "documents")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find_pii

    return digest(find_pii(_table(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that occurs in it with at most 10 % edits."""
    from .decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_wrapper import extract

    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_training_order": op1_training_order,
        "op2_secret_scan": op2_secret_scan,
        "op3_token_counts": op3_token_counts,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_quality": op5_quality,
        "op6_order_minhash": op6_order_minhash,
        "op7_piece_codec": op7_piece_codec,
        "op8_pii": op8_pii,
        "op9_decontamination": op9_decontamination,
        "op10_main_text": op10_main_text,
    }


def oracle_sql() -> dict[str, str]:
    return {}
