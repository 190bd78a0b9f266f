"""All passes together: one match list, one exception per record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MATCHED_BY, ReconConfig
from ..functions import columns as C
from .matching import own
from .split import Stage, part_ids

LEFT_BANK, LEFT_SETTLEMENT = 5, 6


def all_matches(passes: list[DataFrame]) -> DataFrame:
    """The matches of all passes, with the place of their pass."""
    order = F.array_position(F.array(*map(F.lit, MATCHED_BY)), F.col("matched_by")).cast("int")
    return reduce(DataFrame.unionByName, passes).withColumn("pass_order", order)


def matched_ids(matches: DataFrame) -> DataFrame:
    """(source, record_id) of everything matched, components included."""
    bank = matches.select(F.lit("bank").alias("source"), F.col("bank_credit_id").alias("record_id")).distinct()
    return bank.union(part_ids(matches).select(F.lit("settlement"), "settlement_id"))


def _claims(matches: DataFrame) -> DataFrame:
    """As :func:`matched_ids`, but a record is named as often as it is matched; for joins that ask only whether it is."""
    parts = F.explode(F.array_distinct(F.concat(F.array("settlement_id"), F.coalesce("components", F.array().cast("array<string>")))))
    return matches.select(F.lit("bank").alias("source"), F.col("bank_credit_id").alias("record_id")).union(matches.select(F.lit("settlement"), parts))


def leftover_banks(credits: DataFrame, settlements: DataFrame, config: ReconConfig = DEFAULT) -> DataFrame:
    """An exception for every credit given, classified against all settlements.

    Existence only: settlements are reduced to one row per bucket, day and amount before the joins.
    """
    more = own(credits, settlements)
    keys = settlements.where(C.may_link(F.col("utr"))).select(*more, F.explode(C.link_keys(F.col("utr"))).alias("utr")).distinct()
    linked = credits.select(*more, "bank_credit_id", "utr").join(keys, [*more, "utr"], "left_semi").select("bank_credit_id", F.lit(True).alias("linked"))
    width = config.date_window_days + 1
    right = settlements.select(
        *more, "currency", "settled_at", "net", C.date_bucket(F.col("settled_at"), width).alias("bucket"), F.floor(C.amount_place(F.col("net"), config)).cast("long").alias("place")
    ).distinct()
    left = credits.select(*more, "bank_credit_id", "currency", "credited_at", "amount", F.explode(C.places_around(F.col("amount"), config)).alias("place"), C.date_bucket(F.col("credited_at"), width).alias("bucket"))
    left = left.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1))).alias("l")
    near = (
        (F.col("l.currency") == F.col("r.currency")) & (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.place") == F.col("r.place"))
        & (F.abs(F.datediff("credited_at", "settled_at")) <= config.date_window_days) & (F.abs(F.col("amount") - F.col("net")) <= C.amount_tolerance(F.col("amount"), config))
    )
    for c in more:
        near = near & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    plausible = left.join(right.alias("r"), near, "left_semi").select("bank_credit_id").distinct().withColumn("plausible", F.lit(True))
    both = credits.join(linked, "bank_credit_id", "left").join(plausible, "bank_credit_id", "left")
    kind = F.when(F.col("linked"), "batched_payout").when(F.col("plausible"), "unclaimed_bank_credit").otherwise("unresolvable_noise")
    reason = F.when(F.col("linked"), "linked settlements do not make up the credit").when(F.col("plausible"), "no settlement is left for this credit").otherwise("nothing near this credit")
    return both.select(F.col("bank_credit_id").alias("record_id"), F.lit("bank").alias("source"), reason.alias("reason"), kind.alias("exception_type"), F.lit(LEFT_BANK).alias("precedence"), "seq")


def leftover_settlements(settlements: DataFrame) -> DataFrame:
    return settlements.select(
        F.col("settlement_id").alias("record_id"), F.lit("settlement").alias("source"), F.lit("no credit came for this settlement").alias("reason"),
        F.lit("settlement_pending_bank").alias("exception_type"), F.lit(LEFT_SETTLEMENT).alias("precedence"), "seq",
    )


def all_exceptions(found: list[DataFrame], matches: DataFrame) -> DataFrame:
    """One exception per record that no match claims: the first by precedence, then input order."""
    # ids begin alike, so sorting them compares whole rows; a number in front decides almost always
    key, mark = ["mark", "source", "record_id"], F.xxhash64("source", "record_id")
    rows = reduce(DataFrame.unionByName, found).withColumn("mark", mark).join(_claims(matches).withColumn("mark", mark), key, "left_anti")
    first = Window.partitionBy(*key).orderBy("precedence", "seq")
    return rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "mark")


def swept(exceptions: DataFrame, matches: DataFrame, credits: DataFrame, settlements: DataFrame, config: ReconConfig = DEFAULT, stage: Stage | None = None) -> DataFrame:
    """The exceptions, and a leftover for every credit and settlement that is neither matched nor flagged.

    stage: writes the credits that are left, mostly none, so that settlements are read for their class only if there are some.
    """
    done = _claims(matches).union(exceptions.select("source", "record_id"))
    of = lambda source, name: done.where(F.col("source") == source).select(F.col("record_id").alias(name))
    bank = credits.join(of("bank", "bank_credit_id"), "bank_credit_id", "left_anti")
    settlement = settlements.join(of("settlement", "settlement_id"), "settlement_id", "left_anti")
    if stage is not None:
        bank = stage(bank, "unseen")
    found = exceptions.unionByName(leftover_settlements(settlement))
    return found if stage is not None and bank.isEmpty() else found.unionByName(leftover_banks(bank, settlements, config))
