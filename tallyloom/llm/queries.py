"""The registered queries of this subpackage; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch that goes to Python at a time: texts may be long, so few.
BATCH_ROWS = 500


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .langid import identified

    return identified(_table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op1_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .packing import pack_documents

    found = pack_documents(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))
    return found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .preferences import format_preferences, stale_reply_pairs

    return format_preferences(*stale_reply_pairs(_table(spark, sf_dir, "conversations"))).withColumnRenamed("pair_id", "conv_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(_table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))).withColumnRenamed("id", "doc_id")


def op7_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .nbest import decoded, n_best

    model = path("piece_bpe_32k.model")
    found = decoded(n_best(_table(spark, sf_dir, "documents"), model), model)
    return found.select("doc_id", "rank", "score", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"))


def op8_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_paragraph_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import without_repeats

    kept = without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "text", "n_removed", (F.col("n_removed") > 0).alias("has_repeats"))


def op11_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .bpe import decoded, encoded

    tokenizer = path("word_bpe_49k.json")
    found = decoded(encoded(_table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def looped(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The contract's change of one document in ten: from a word on it repeats itself."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words or doc_id is None:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(len(words) - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs

    found = periodic_runs(_table(spark, sf_dir, "documents"), rewrite=looped)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.encode(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )


def op13_prefix_suffix_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"), misspell=97).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wrapper_induction": op1_wrapper_induction,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_speculative_bpe": op11_speculative_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_suffix_tiling": op13_prefix_suffix_tiling,
    "op2_vector_best_fit": op2_vector_best_fit,
    "op3_language_id": op3_language_id,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_preference_pairs": op5_preference_pairs,
    "op6_token_files": op6_token_files,
    "op7_nbest_segmentation": op7_nbest_segmentation,
    "op8_adaptive_scan": op8_adaptive_scan,
    "op9_paragraph_banding": op9_paragraph_banding,
}
