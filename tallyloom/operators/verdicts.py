"""Verdicts on ambiguous pairs as table work: requests out, reply texts in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_CONFIDENCE = 0.8


def requests(pairs: DataFrame, credits: DataFrame, settlements: DataFrame) -> DataFrame:
    """(bank_credit_id, settlement_id, request): one JSON document per pair."""
    bank = credits.select("bank_credit_id", F.struct(F.col("bank_credit_id").alias("id"), "utr", "amount", F.col("credited_at").cast("string").alias("date"), "currency").alias("bank"))
    settlement = settlements.select("settlement_id", F.struct(F.col("settlement_id").alias("id"), "utr", F.col("net").alias("amount"), F.col("settled_at").cast("string").alias("date"), "currency").alias("settlement"))
    both = pairs.join(bank, "bank_credit_id").join(settlement, "settlement_id")
    return both.select("bank_credit_id", "settlement_id", F.to_json(F.struct("bank", "settlement", "score", "reasoning")).alias("request"))


def parsed(replies: DataFrame) -> DataFrame:
    """(bank_credit_id, settlement_id, verdict, reasoning, error) of free-text replies.

    The text from the first ``{`` to the last ``}`` is read as JSON; whatever is not a clear verdict
    is ``unsure``.
    """
    text = F.coalesce("reply", F.lit(""))
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    missing = (first == 0) | (F.instr(text, "}") == 0)
    body = F.when(~missing & (first < last), F.expr("substring(coalesce(reply, ''), instr(coalesce(reply, ''), '{'), length(coalesce(reply, '')) - instr(reverse(coalesce(reply, '')), '}') + 2 - instr(coalesce(reply, ''), '{'))"))
    said = replies.withColumn("missing", missing).withColumn("body", body).withColumn("doc", F.try_parse_json("body"))
    verdict, why = F.get_json_object("body", "$.verdict"), F.get_json_object("body", "$.reasoning")
    kind = F.schema_of_variant(F.try_variant_get("doc", "$.reasoning", "variant"))
    invalid = F.col("doc").isNull() | (F.col("doc").isNotNull() & kind.isNotNull() & ~kind.isin("STRING", "VOID"))
    known = verdict.isin("match", "no_match", "unsure")
    return said.select(
        "bank_credit_id", "settlement_id", F.when(F.col("missing") | invalid | ~F.coalesce(known, F.lit(False)), "unsure").otherwise(verdict).alias("verdict"),
        F.when(F.col("missing"), "reply holds no JSON").when(invalid, "reply holds invalid JSON").when(~F.coalesce(known, F.lit(False)), "reply holds no known verdict")
        .when(F.trim(F.coalesce(why, F.lit(""))) == "", "no reason given").otherwise(F.trim(why)).alias("reasoning"),
        "error",
    )


def routed(pairs: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, exceptions). A pair without a verdict, or with a failed call, leaves both sides as exceptions."""
    both = pairs.join(verdicts.withColumnRenamed("reasoning", "said"), ["bank_credit_id", "settlement_id"], "left")
    good = F.coalesce((F.col("verdict") == "match") & F.col("error").isNull(), F.lit(False))
    matches = both.where(good).select(
        "bank_credit_id", "settlement_id", F.lit(None).cast("array<string>").alias("components"), F.greatest("score", F.lit(LEAST_CONFIDENCE)).alias("confidence"), F.lit("llm").alias("matched_by"), F.col("said").alias("reasoning")
    )
    reason = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("ambiguous, verdict failed: "), F.col("error"))).when(F.col("verdict").isNull(), "ambiguous, no verdict source")
        .otherwise(F.concat(F.lit("verdict "), F.col("verdict"), F.lit(": "), F.col("said")))
    )
    sides = F.explode(F.array(F.struct(F.col("bank_credit_id").alias("id"), F.lit("bank").alias("source"), F.col("b_seq").alias("seq")), F.struct(F.col("settlement_id").alias("id"), F.lit("settlement").alias("source"), F.col("s_seq").alias("seq"))))
    open_ = both.where(~good).select(reason.alias("reason"), sides.alias("side"))
    return matches, open_.select(F.col("side.id").alias("record_id"), F.col("side.source").alias("source"), "reason", F.lit(None).cast("string").alias("exception_type"), F.lit(4).alias("precedence"), F.col("side.seq").alias("seq"))


def resolved(pairs: DataFrame, make_resolver: Callable[[], Callable[[dict], str]]) -> DataFrame:
    """(bank_credit_id, settlement_id, reply, error) from a user's resolver; one resolver per partition.

    A pair whose call raises carries the error text instead of a reply. Every evaluation asks again; see
    :func:`asked` for resolvers whose calls cost something.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resolve = make_resolver()
        for pdf in batches:
            out = []
            for pair in pdf.to_dict("records"):
                try:
                    out.append((pair["bank_credit_id"], pair["settlement_id"], resolve(pair), None))
                except Exception as e:  # the resolver is the user's code and may raise anything
                    out.append((pair["bank_credit_id"], pair["settlement_id"], None, str(e)))
            yield pd.DataFrame(out, columns=["bank_credit_id", "settlement_id", "reply", "error"])

    return pairs.mapInPandas(run, "bank_credit_id string, settlement_id string, reply string, error string")


LEDGER = "digest string, reply string, error string, run string"


def digested(pairs: DataFrame) -> DataFrame:
    """The pairs with the digest of what is asked about them: all columns but the input positions, by name."""
    asked = sorted(c for c in pairs.columns if c not in ("b_seq", "s_seq"))
    return pairs.withColumn("digest", F.sha2(F.to_json(F.struct(*asked), {"ignoreNullFields": "false"}), 256))


def asked(
    pairs: DataFrame, make_resolver: Callable[[], Callable[[dict], str]], ledger: str, run: str, wave: int = 10_000, at_once: int = 8
) -> DataFrame:
    """(bank_credit_id, settlement_id, reply, error), each question asked once whatever fails in between.

    Answers go to a ledger, a Parquet folder keyed by the digest of the question. What it holds already is never asked
    again, by this run, a repeated one or another; calls that failed are asked again by runs of another name. Questions go out in
    waves, each committed as a whole, so a lost task or a stopped run repeats its wave at most, and resolvers
    find the digest in the pair, to recognise a question they have answered. Each task holds ``at_once`` calls open.
    """
    spark = pairs.sparkSession

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resolve = make_resolver()

        def one(pair: dict) -> tuple:
            try:
                return pair["digest"], resolve(pair), None, run
            except Exception as e:  # the resolver is the user's code and may raise anything
                return pair["digest"], None, str(e), run

        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                yield pd.DataFrame(list(pool.map(one, pdf.to_dict("records"))), columns=["digest", "reply", "error", "run"])

    questions = digested(pairs)
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)  # there from the start
    while True:
        known = spark.read.schema(LEDGER).parquet(ledger).where((F.col("reply").isNotNull()) | (F.col("run") == run))
        todo = questions.join(known.select("digest"), "digest", "left_anti").dropDuplicates(["digest"]).limit(wave)
        if todo.isEmpty():
            break
        todo.repartition(spark.sparkContext.defaultParallelism).mapInPandas(ask, LEDGER).write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger).where((F.col("reply").isNotNull()) | (F.col("run") == run))
    answer = known.groupBy("digest").agg(F.max("reply").alias("reply"), F.max("error").alias("error"))
    return questions.join(answer, "digest").select("bank_credit_id", "settlement_id", "reply", F.when(F.col("reply").isNull(), F.col("error")).alias("error"))
