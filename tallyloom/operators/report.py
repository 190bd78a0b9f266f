"""Tables of the report: exception lists, previews, difficulty and match-source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LEVELS, MATCHED_BY
from ..sources.tables import with_seq


def exceptions_view(exceptions: DataFrame, wanted: str | None = None, sort_by: str = "type") -> DataFrame:
    """Exceptions of one type or source (null: all), with their place, from 1, in the chosen order: by type or source, then as they were found."""
    rows = exceptions if wanted is None else exceptions.where((F.col("exception_type") == wanted) | (F.col("source") == wanted))
    order = F.col("source") if sort_by == "source" else F.coalesce("exception_type", F.lit(""))
    rows = rows.select("record_id", "source", "exception_type", "reason", order.alias("sort_key"), "precedence", "seq")
    return with_seq(rows, "sort_key", "precedence", "seq", "source", "record_id", name="place", first=1)


def exception_types(exceptions: DataFrame) -> DataFrame:
    return exceptions.select(F.coalesce("exception_type", "source").alias("kind")).distinct()


def exception_preview(exceptions: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` exceptions and how many more there are."""
    total = exceptions.agg(F.count("*").alias("total"))
    first = exceptions.orderBy("precedence", "seq", "source", "record_id").limit(n)
    return first.crossJoin(F.broadcast(total)).select("record_id", "source", "exception_type", F.greatest(F.col("total") - n, F.lit(0)).alias("n_more"))


def _percent(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.format_string("%.2f%%", x * 100))


def difficulty_table(levels: DataFrame, deferred: DataFrame) -> DataFrame:
    """(place, level, match_rate, precision, deferred) in fixed order; '—' where undefined."""
    place = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")).cast("int")
    return levels.join(deferred.select("level", "rate"), "level", "left").select(
        place.alias("place"), "level", _percent(F.col("recall")).alias("match_rate"), _percent(F.col("precision")).alias("precision"), _percent(F.col("rate")).alias("deferred")
    )


def match_source_bars(breakdown: DataFrame) -> DataFrame:
    """Counts scaled by the largest (1 at least); a table of five rows."""
    most = breakdown.agg(F.greatest(F.max("n"), F.lit(1)).alias("most"))
    place = F.array_position(F.array(*map(F.lit, MATCHED_BY)), F.col("matched_by")).cast("int")
    return breakdown.crossJoin(F.broadcast(most)).select(place.alias("place"), "matched_by", "n", F.round(F.col("n") / F.col("most"), 6).alias("share"))


def match_lookup(matches: DataFrame, ids: DataFrame) -> DataFrame:
    """Matches that hold one of the ids, on either side or as a component."""
    own = F.concat(F.array("bank_credit_id", "settlement_id"), F.coalesce("components", F.array().cast("array<string>")))
    exploded = matches.withColumn("id", F.explode(F.array_distinct(own)))
    return exploded.join(ids.select("id").distinct(), "id").select("id", "bank_credit_id", "settlement_id", "matched_by", "confidence")


def report_document(score: DataFrame, matches: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(kind, body): a JSON text per row, null fields included and rates with six digits, so the report is written in parallel."""
    rates = score.select(*[F.col(c).cast("decimal(9,6)").alias(c) if t == "double" else F.col(c) for c, t in score.dtypes])
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("body"))
    return line(rates, "metrics").unionByName(line(matches, "match")).unionByName(line(exceptions.select("record_id", "source", "reason", "exception_type", "precedence", "seq"), "exception"))

