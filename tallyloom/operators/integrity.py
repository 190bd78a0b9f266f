"""Payment against settlement: fee, tax, gross and currency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ReconConfig
from ..functions.columns import money_text

PRECEDENCE = 1


def last_payments(payments: DataFrame) -> DataFrame:
    """One row per payment id: the last in input order."""
    last = Window.partitionBy("payment_id").orderBy(F.desc("seq"))
    return payments.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def checked(payments: DataFrame, settlements: DataFrame, config: ReconConfig = DEFAULT) -> DataFrame:
    """Settlements with one boolean per rule: bad_fee_tax, orphan, bad_gross, bad_currency."""
    pay = last_payments(payments).select("payment_id", F.col("amount").alias("paid"), F.col("currency").alias("paid_currency"), F.lit(True).alias("known"))
    t = config.integrity_tolerance
    return settlements.join(pay, "payment_id", "left").select(
        "settlement_id", "payment_id", "gross", "fee", "tax", "net", "currency", "seq", "paid", "paid_currency",
        (F.abs(F.col("gross") - F.col("fee") - F.col("tax") - F.col("net")) > t).alias("bad_fee_tax"), F.col("known").isNull().alias("orphan"),
        F.coalesce(F.abs(F.col("gross") - F.col("paid")) > t, F.lit(False)).alias("bad_gross"), F.coalesce(F.col("currency") != F.col("paid_currency"), F.lit(False)).alias("bad_currency"),
    )


def integrity_exceptions(payments: DataFrame, settlements: DataFrame, config: ReconConfig = DEFAULT) -> DataFrame:
    """One exception per flagged settlement: the first rule that fails."""
    fee = F.concat(F.lit("net "), money_text(F.col("net")), F.lit(" is not gross less fee and tax, "), money_text(F.col("gross") - F.col("fee") - F.col("tax")))
    gross = F.concat(F.lit("gross "), money_text(F.col("gross")), F.lit(" is not the paid amount, "), money_text(F.col("paid")))
    money = F.concat(F.lit("settled in "), F.col("currency"), F.lit(", paid in "), F.col("paid_currency"))
    reason = (
        F.when(F.col("bad_fee_tax"), fee).when(F.col("orphan"), F.concat(F.lit("no payment "), F.col("payment_id"))).when(F.col("bad_gross"), gross).when(F.col("bad_currency"), money)
    )
    kind = F.when(F.col("bad_fee_tax"), "fee_tax_mismatch").when(~F.col("orphan") & ~F.col("bad_gross") & F.col("bad_currency"), "currency_mismatch")
    return checked(payments, settlements, config).where("bad_fee_tax or orphan or bad_gross or bad_currency").select(
        F.col("settlement_id").alias("record_id"), F.lit("settlement").alias("source"), reason.alias("reason"), kind.alias("exception_type"), F.lit(PRECEDENCE).alias("precedence"), "seq"
    )


def clean(settlements: DataFrame, flagged: DataFrame) -> DataFrame:
    return settlements.join(flagged.select(F.col("record_id").alias("settlement_id")), "settlement_id", "left_anti")
