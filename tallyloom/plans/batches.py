"""Many batches in one job, kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reconcile import Reconciliation

OPEN, CLOSE = "\x1e", "\x1f"  # around the batch at the start of an id; they do not occur in records


def _named(df: DataFrame, *names: str) -> DataFrame:
    """Ids that are unique over all batches."""
    mark = F.concat(F.lit(OPEN), F.col("batch").cast("string"), F.lit(CLOSE))
    for name in names:
        column = F.transform(name, lambda x: F.concat(mark, x)) if df.schema[name].dataType.typeName() == "array" else F.concat(mark, F.col(name))
        df = df.withColumn(name, column)
    return df


def _plain(column: Column) -> Column:
    return F.regexp_replace(column, f"{OPEN}[^{CLOSE}]*{CLOSE}", "")


def _batch(column: Column) -> Column:
    return F.regexp_extract(column, f"^{OPEN}([^{CLOSE}]*){CLOSE}", 1)


class Batches:
    """All batches of some tables with a column ``batch`` reconciled together: one plan, one set of tables, no batch meeting another.

    Ids carry their batch while the run lasts, so all joins and windows by id are apart; those by reference, amount or day
    take ``batch`` as a further key. Results are those of separate runs, with the batch as text.
    """

    def __init__(self, payments: DataFrame, settlements: DataFrame, credits: DataFrame, log: DataFrame | None = None, replies: DataFrame | None = None, mode: str = "linked"):
        self.run = Reconciliation(
            _named(payments, "payment_id").drop("batch"), _named(settlements, "settlement_id", "payment_id"), _named(credits, "bank_credit_id"),
            None if log is None else _named(log, "record_id", "corrected_match_id", "components").drop("batch"), None if replies is None else _named(replies, "bank_credit_id", "settlement_id").drop("batch"), mode=mode,
        )

    @property
    def matches(self) -> DataFrame:
        m = self.run.matches
        out = m.withColumn("batch", _batch(F.col("bank_credit_id"))).withColumn("components", F.transform("components", _plain))
        return out.withColumns({c: _plain(F.col(c)) for c in ("bank_credit_id", "settlement_id", "reasoning")})

    @property
    def exceptions(self) -> DataFrame:
        e = self.run.exceptions.withColumn("batch", _batch(F.col("record_id")))
        return e.withColumns({c: _plain(F.col(c)) for c in ("record_id", "reason")})
