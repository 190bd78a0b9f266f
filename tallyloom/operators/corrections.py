"""Human corrections: accepted matches, rejected records, threshold hints, review rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def human_matches(corrections: DataFrame, dedupe: bool = False) -> DataFrame:
    """Accepts with a counterpart. Source ``bank`` names the credit, ``settlement`` the settlement.

    Accepts of source ``payment`` have no side to stand on and are left out, see :func:`skipped`.
    dedupe: of accepts that name the same pair only the first is kept.
    """
    bank = F.col("source") == "bank"
    rows = corrections.where("decision = 'accept' and corrected_match_id is not null and source in ('bank', 'settlement')")
    out = rows.select(
        F.when(bank, F.col("record_id")).otherwise(F.col("corrected_match_id")).alias("bank_credit_id"), F.when(bank, F.col("corrected_match_id")).otherwise(F.col("record_id")).alias("settlement_id"),
        "components", F.lit(1.0).alias("confidence"), F.lit("human").alias("matched_by"), F.lit("accepted in review").alias("reasoning"), "seq",
    )
    if dedupe:
        first = Window.partitionBy("bank_credit_id", "settlement_id").orderBy("seq")
        out = out.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return out.drop("seq")


def skipped(corrections: DataFrame) -> DataFrame:
    return corrections.where("decision = 'accept' and (corrected_match_id is null or source not in ('bank', 'settlement'))")


def rejected(corrections: DataFrame) -> DataFrame:
    return corrections.where("decision = 'reject'").select("source", "record_id", "seq")


def removed(corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of the credits and of the settlements that are matched by hand or rejected."""
    human, gone = human_matches(corrections), rejected(corrections)
    parts = human.select(F.explode(F.coalesce("components", F.array("settlement_id"))).alias("settlement_id"))
    of = lambda source, name: gone.where(F.col("source") == source).select(F.col("record_id").alias(name))
    return human.select("bank_credit_id").union(of("bank", "bank_credit_id")).distinct(), parts.union(of("settlement", "settlement_id")).distinct()


def pools_after(credits: DataFrame, settlements: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What corrections leave: neither matched by hand nor rejected."""
    bank, settlement = removed(corrections)
    return credits.join(bank, "bank_credit_id", "left_anti"), settlements.join(settlement, "settlement_id", "left_anti")


def reject_exceptions(corrections: DataFrame) -> DataFrame:
    return rejected(corrections).select(
        "record_id", "source", F.lit("rejected for good in review").alias("reason"), F.lit(None).cast("string").alias("exception_type"), F.lit(7).alias("precedence"), "seq"
    )


def suggested_threshold(corrections: DataFrame, low: float = 0.65, high: float = 0.75, least: int = 3) -> DataFrame:
    """One row (n, suggestion): a hint from accepts just below the threshold; never applied by itself."""
    near = corrections.where((F.col("decision") == "accept") & (F.col("score") >= low) & (F.col("score") < high))
    hint = F.round(F.greatest(F.lit(0.5), F.avg("score") - 0.05), 2)
    return near.agg(F.count("*").alias("n"), F.when(F.count("*") >= least, hint).alias("suggestion"))


def counterparts(exceptions: DataFrame) -> DataFrame:
    """(record_id, source, counterpart_id): an exception of the other side with the same reason.

    One with the same digits in its id comes first, else the first of the other side. Reasons are
    shared by very many rows, so the sides meet on (reason, digits), and per reason only the first
    record of a side is carried.
    """
    rows = exceptions.where("source in ('bank', 'settlement')").select("record_id", "source", "reason", "seq", F.regexp_replace("record_id", r"\D", "").alias("digits"))
    other = F.when(F.col("source") == "bank", "settlement").otherwise("bank")
    least = lambda keys, name: rows.groupBy("reason", *keys, "source").agg(F.min(F.struct("seq", "record_id"))["record_id"].alias(name)).withColumn("source", other)
    # reasons of one side alone, which may be as many as rows, have no counterpart
    shared = rows.groupBy("reason").agg(F.min("source").alias("a"), F.max("source").alias("b")).where("a <> b").select("reason")
    return (
        rows.join(least(["digits"], "equal"), ["reason", "digits", "source"], "left").join(least([], "first").join(shared, "reason", "left_semi"), ["reason", "source"], "left")
        .select("record_id", "source", F.coalesce("equal", "first").alias("counterpart_id"), "seq")
    )


def review_rows(decisions: DataFrame, counterpart: DataFrame) -> DataFrame:
    """Correction rows of review decisions (record_id, source, decision); accepts carry the counterpart."""
    both = decisions.join(counterpart.select("record_id", "source", "counterpart_id"), ["record_id", "source"], "left")
    return both.select("record_id", "source", "decision", F.when(F.col("decision") == "accept", F.col("counterpart_id")).alias("corrected_match_id"))
