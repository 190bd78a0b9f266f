"""Corpus pipeline: language ID, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir); ``docs`` is what the stage before it kept. All but the last
return the columns of documents. Stages are written as Parquet and read again.

Rows are told apart by id and text, so a repeated id costs no other text; rows with a null id pass
the near and substring stages as they are. Null and empty texts go in the first stage. Empty tables and
columns of other names are allowed; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _few_rows_a_batch(spark: SparkSession) -> None:
    from tallyloom.llm.queries import BATCH_ROWS

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters) go; the others get the language found."""
    from public_tokenizers import path

    from tallyloom.llm.langid import fit, held_out, predicted

    _few_rows_a_batch(spark)
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))), path("piece_bpe_32k.model"))
    kept = predicted(docs.select(*COLUMNS), model).where("lang_pred <> 'und'")
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    from tallyloom.llm.exact_dedup import exact_duplicates

    _few_rows_a_batch(spark)
    gone = exact_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), "text_sha256")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("text_sha256")), "left_anti").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    from tallyloom.llm.near_dedup import near_duplicates

    _few_rows_a_batch(spark)
    gone = near_duplicates(docs).where("not kept").select("doc_id", "text_hash")
    return docs.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents stay once; documents left without a word go."""
    from tallyloom.llm.substring_dedup import without_repeats

    _few_rows_a_batch(spark)
    kept = without_repeats(docs.select(*COLUMNS)).where("n_removed = 0 or text rlike '\\\\S'")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts cut and packed into sequences of at most 1024 tokens."""
    from public_tokenizers import path

    from tallyloom.llm.packing import pack_documents

    _few_rows_a_batch(spark)
    return pack_documents(docs, path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", packing),
]

#: Language models and tokenizers are outside SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
