"""Scores of matches and exceptions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LEVELS, MATCHED_BY


def _list_key(components: Column, settlement: Column, many: Column) -> Column:
    return F.when(many, F.array_join(F.array_sort(components), "+")).otherwise(settlement)


def paired(matches: DataFrame, labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Predictions joined with the label each of them claims; a label is claimed once.

    A label of several settlements wants the same set of components; any other wants the same
    settlement. Set labels and single labels are different keys, so each kind is one equi-join.
    """
    want = labels.where("label = 'match'").withColumn("many", F.size(F.coalesce("settlement_ids", F.array().cast("array<string>"))) > 1)
    want = want.withColumn("key", _list_key(F.col("settlement_ids"), F.col("settlement_id"), F.col("many")))
    have = matches.withColumn("m_id", F.struct("bank_credit_id", "settlement_id", "matched_by"))
    out = None
    for many in (True, False):
        own = F.coalesce("components", F.array("settlement_id"))
        key = F.array_join(F.array_sort(own), "+") if many else F.col("settlement_id")
        side = [*by, "bank_credit_id", "key"]
        a = have.withColumn("key", key).withColumn("rn", F.row_number().over(Window.partitionBy(*side).orderBy("pass_order")))
        b = want.where(F.col("many") if many else ~F.col("many")).withColumn("rn", F.row_number().over(Window.partitionBy(*side).orderBy("seq")))
        hit = a.join(b.select(*side, "rn", F.col("class").alias("label_class"), "level"), [*side, "rn"]).select(*by, "bank_credit_id", "settlement_id", "matched_by", "label_class", "level")
        out = hit if out is None else out.unionByName(hit)
    return out


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.greatest(b, F.lit(1)))


def counts(matches: DataFrame, labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, tp, fp, fn, n_predicted, n_true)."""
    tag = lambda df, name: df.select(*by, F.lit(name).alias("what"))
    rows = tag(paired(matches, labels, by), "tp").union(tag(matches, "predicted")).union(tag(labels.where("label = 'match'"), "true"))
    n = lambda what: F.count_if(F.col("what") == what)
    out = rows.groupBy(*by).agg(n("tp").alias("tp"), n("predicted").alias("n_predicted"), n("true").alias("n_true"))
    return out.select(*by, "tp", (F.col("n_predicted") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), "n_predicted", "n_true")


def headline(counted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    tp, predicted, true = F.col("tp"), F.col("n_predicted"), F.col("n_true")
    recall = F.round(ratio(tp, true, 1.0), 6)
    return counted.select(
        *by, F.round(ratio(tp, predicted, 1.0), 6).alias("precision"), recall.alias("recall"), recall.alias("match_rate"), F.round(ratio(F.col("fp"), predicted, 0.0), 6).alias("fp_rate")
    )


def label_exception_ids(labels: DataFrame) -> DataFrame:
    """(source, record_id) of exception labels, both sides."""
    sides = F.explode(F.array(F.struct(F.lit("bank").alias("source"), F.col("bank_credit_id").alias("record_id")), F.struct(F.lit("settlement").alias("source"), F.col("settlement_id").alias("record_id"))))
    return labels.where("label = 'exception'").select(sides.alias("s")).select("s.source", "s.record_id").where("record_id is not null").distinct()


def exception_accuracy(exceptions: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: true, predicted and correct exception records, and correct / predicted."""
    true, said = label_exception_ids(labels), exceptions.select("source", "record_id").distinct()
    both = said.withColumn("said", F.lit(1)).join(true.withColumn("true", F.lit(1)), ["source", "record_id"], "full")
    out = both.agg(F.count("true").alias("n_true"), F.count("said").alias("n_predicted"), F.count_if(F.col("said").isNotNull() & F.col("true").isNotNull()).alias("n_correct"))
    return out.withColumn("accuracy", F.round(ratio(F.col("n_correct"), F.col("n_predicted"), 1.0), 6))


def by_source(matches: DataFrame) -> DataFrame:
    """(matched_by, n) with all sources, also those without a match."""
    every = matches.sparkSession.createDataFrame([(m,) for m in MATCHED_BY], "matched_by string")
    found = matches.groupBy("matched_by").agg(F.count("*").alias("found"))
    return every.join(found, "matched_by", "left").select("matched_by", F.coalesce("found", F.lit(0)).cast("long").alias("n"))


def slices(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """(level, tp, fp, fn, ...): predictions that touch a level's credits or settlements; one may count in several levels."""
    bank = labels.where("bank_credit_id is not null").select("bank_credit_id", "level").distinct()
    first = F.coalesce(F.col("settlement_id"), F.try_element_at("settlement_ids", F.lit(1)))
    some = labels.select(first.alias("settlement_id"), "level").where("settlement_id is not null").distinct()
    key = matches.withColumn("m", F.monotonically_increasing_id()) if "m" not in matches.columns else matches
    parts = key.select("m", F.explode(F.array_distinct(F.concat(F.array("settlement_id"), F.coalesce("components", F.array().cast("array<string>"))))).alias("settlement_id"))
    member = key.join(bank, "bank_credit_id").select("m", "level").union(parts.join(some, "settlement_id").select("m", "level")).distinct()
    own = key.join(member, "m").drop("m")
    every = matches.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    found = _level_counts(own, labels)
    return every.join(found, "level", "left").fillna(0)


def _level_counts(own: DataFrame, labels: DataFrame) -> DataFrame:
    """As :func:`counts`, within each level."""
    want = labels.where("label = 'match'").withColumn("many", F.size(F.coalesce("settlement_ids", F.array().cast("array<string>"))) > 1)
    want = want.withColumn("key", _list_key(F.col("settlement_ids"), F.col("settlement_id"), F.col("many")))
    side, tp = ["level", "bank_credit_id", "key"], None
    for many in (True, False):
        key = F.array_join(F.array_sort(F.coalesce("components", F.array("settlement_id"))), "+") if many else F.col("settlement_id")
        a = own.withColumn("key", key).withColumn("rn", F.row_number().over(Window.partitionBy(*side).orderBy("pass_order")))
        b = want.where(F.col("many") if many else ~F.col("many")).withColumn("rn", F.row_number().over(Window.partitionBy(*side).orderBy("seq")))
        hit = a.select(*side, "rn").join(b.select(*side, "rn"), [*side, "rn"]).select("level", F.lit("tp").alias("what"))
        tp = hit if tp is None else tp.union(hit)
    rows = tp.union(own.select("level", F.lit("predicted"))).union(want.select("level", F.lit("true")))
    n = lambda what: F.count_if(F.col("what") == what)
    out = rows.groupBy("level").agg(n("tp").alias("tp"), n("predicted").alias("n_predicted"), n("true").alias("n_true"))
    return out.select("level", "tp", (F.col("n_predicted") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), "n_predicted", "n_true")


def level_metrics(sliced: DataFrame) -> DataFrame:
    tp, predicted, true = F.col("tp"), F.col("n_predicted"), F.col("n_true")
    return sliced.withColumn("precision", F.when(predicted > 0, F.round(tp / F.greatest(predicted, F.lit(1)), 6))).withColumn("recall", F.when(true > 0, F.round(tp / F.greatest(true, F.lit(1)), 6)))


def deferral(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """(level, n, deferred, rate) for the levels that should be left to people.

    An exception label is deferred if neither of its records is matched (a decoy's label only asks
    for the decoy settlement); a true match with a decoy is deferred unless its credit took the decoy.
    """
    parts = F.explode(F.array_distinct(F.concat(F.array("settlement_id"), F.coalesce("components", F.array().cast("array<string>")))))
    taken = matches.select("bank_credit_id", parts.alias("settlement_id")).distinct()
    bank = taken.select("bank_credit_id", F.lit(True).alias("b")).distinct()
    settlement = taken.select("settlement_id", F.lit(True).alias("s")).distinct()
    own = labels.where("level in ('decoy', 'unresolvable')")
    left = own.where("label = 'exception'").join(bank, "bank_credit_id", "left").join(settlement, "settlement_id", "left")
    wrong = F.when(F.col("class") == "near_duplicate_decoy", F.coalesce("s", F.lit(False))).otherwise(F.coalesce("s", F.lit(False)) | F.coalesce("b", F.lit(False)))
    one = left.select("level", wrong.alias("wrong"))
    true = own.where("label = 'match' and decoy_settlement_id is not null").select("level", "bank_credit_id", F.col("decoy_settlement_id").alias("settlement_id"))
    two = true.join(taken.withColumn("t", F.lit(True)), ["bank_credit_id", "settlement_id"], "left").select("level", F.coalesce("t", F.lit(False)).alias("wrong"))
    out = one.union(two).groupBy("level").agg(F.count("*").alias("n"), F.count_if(~F.col("wrong")).alias("deferred"))
    return out.withColumn("rate", F.round(F.col("deferred") / F.col("n"), 6))


def robustness(per_batch: DataFrame) -> DataFrame:
    """(metric, mean, min, max) over batches."""
    names = ["precision", "recall", "match_rate", "fp_rate"]
    long = per_batch.select(F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in names])).alias("e")).select("e.metric", "e.value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def gate(score: DataFrame, bounds: DataFrame) -> DataFrame:
    """(metric, value, op, bound, passed) for bounds (metric, op, bound) with op '>=' or '<='."""
    names = ["precision", "recall", "match_rate", "fp_rate"]
    long = score.select(F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in names])).alias("e")).select("e.metric", "e.value")
    passed = F.when(F.col("op") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return long.join(bounds, "metric").select("metric", "value", "op", "bound", passed.alias("passed"))
