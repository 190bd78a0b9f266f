"""The registered queries over the derived workload, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions import columns as C
from ..operators import consolidate, corrections, integrity, matching, report, scoring, split, verdicts
from ..sources import tables
from . import sql
from .batches import Batches
from .cluster import metered, new_path, staged
from .reconcile import Answered, Reconciliation
from .rerun import Rerun
from .workload import Workload, check_size, degrade_reference

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Case:
    """The workload of one data folder and the runs over it, computed as far as a query asks."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.work = spark, Workload(spark, sf_dir)

    @cached_property
    def records(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Payments, settlements and credits of a whole run. Its passes read them again and again, so they are derived and written once."""
        settlements = staged(self.work.settlements(), "settlements")
        return self.work.payments(settlements), settlements, staged(self.work.credits(), "credits")

    @cached_property
    def plain(self) -> Reconciliation:
        return Reconciliation(*self.records)

    @cached_property
    def general(self) -> Reconciliation:
        """Any settlement of the window may be a part of a batch."""
        return Reconciliation(*self.records, mode="full")

    @cached_property
    def with_verdicts(self) -> Reconciliation:
        return Answered(self.plain, self.work.replies(self.plain.ambiguous))

    @cached_property
    def complete(self) -> Reconciliation:
        run = Reconciliation(*self.records, self.work.corrections())
        run.replies = self.work.replies(run.ambiguous)
        return run

    @cached_property
    def batched(self) -> Batches:
        of = lambda df: df.withColumn("batch", F.floor(F.col("seq") / 10_000) % sql.BATCHES)
        return Batches(*map(of, self.records))

    @cached_property
    def corrected(self) -> Rerun:
        run = Rerun(self.plain, self.work.corrections())
        run.replies = self.work.replies(run.ambiguous)
        return run

    @cached_property
    def spoiled(self) -> DataFrame:
        """Payments with some missing, and some amounts and currencies changed."""
        h = F.floor(F.col("seq") / 100) % 40
        amount = F.when(h == 1, F.col("amount") + 2).when(h == 3, F.col("amount") + 1).otherwise(F.col("amount"))
        return self.work.payments().where(h != 0).select("payment_id", amount.alias("amount"), F.when(h == 2, "USD").otherwise(F.col("currency")).alias("currency"), "seq")

    @cached_property
    def checked(self) -> DataFrame:
        return integrity.checked(self.spoiled, self.work.settlements())

    @cached_property
    def labels(self) -> DataFrame:
        return self.work.labels()


def query(sql_text: str | None = None) -> Callable:
    def add(f: Callable[[Case], DataFrame]) -> Callable[[Case], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Case(spark, sf_dir))
        if sql_text:
            ORACLE[f.__name__] = sql.select(sql_text)
        return f

    return add


EXC = "record_id, source, reason, exception_type, precedence, seq"
MATCH = "bank_credit_id, settlement_id, array_to_string(components, '+') AS components, confidence, matched_by, reasoning"


def _flat(matches: DataFrame) -> DataFrame:
    return matches.select("bank_credit_id", "settlement_id", F.array_join("components", "+").alias("components"), "confidence", "matched_by", "reasoning")


# ---------------------------------------------------------------- tables and workload


@query("""SELECT 'payments' AS name, count(*) AS n, sum(amount)::BIGINT AS total FROM payments UNION ALL SELECT 'settlements', count(*), sum(net)::BIGINT FROM settlements
  UNION ALL SELECT 'credits', count(*), sum(amount)::BIGINT FROM credits UNION ALL SELECT 'labels', count(*), NULL FROM labels""")
def load_tables(c: Case) -> DataFrame:
    one = lambda name, df, x: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), (F.sum(x) if x else F.lit(None)).cast("long").alias("total"))
    w = c.work
    return one("payments", w.payments(), "amount").union(one("settlements", w.settlements(), "net")).union(one("credits", w.credits(), "amount")).union(one("labels", w.labels(), None))


@query("SELECT k, m, class, level FROM bl")
def workload_classes(c: Case) -> DataFrame:
    return c.work.classes()


@query("SELECT settlement_id, payment_id, gross, fee, tax, net, settled_at, utr, currency, seq FROM settlements")
def derive_settlements(c: Case) -> DataFrame:
    return c.work.settlements()


@query("SELECT bank_credit_id, utr, amount, credited_at, currency, seq FROM credits")
def derive_bank_credits(c: Case) -> DataFrame:
    return c.work.credits()


@query("SELECT order_id, payment_id, amount, currency, status, created_at, seq FROM payments")
def derive_payments(c: Case) -> DataFrame:
    return c.work.payments()


@query("SELECT k, d, utr, n, price FROM parts")
def derive_batches(c: Case) -> DataFrame:
    return c.work.parts().select("k", "d", "utr", F.col("n").cast("long").alias("n"), "price")


@query("""SELECT bank_credit_id, settlement_id, array_to_string(settlement_ids, '+') AS settlement_ids, decoy_settlement_id, label, exception_type, class, level, seq FROM labels""")
def derive_ground_truth(c: Case) -> DataFrame:
    return c.labels.withColumn("settlement_ids", F.array_join("settlement_ids", "+"))


@query("""SELECT record_id, source, decision, corrected_match_id, score FROM log WHERE decision = 'accept' ORDER BY seq LIMIT 2""")
def derive_corrections(c: Case) -> DataFrame:
    return c.work.demo_corrections().select("record_id", "source", "decision", "corrected_match_id", "score")


@query("""SELECT k, left(utr, (length(utr) - round((1 - 0.78::DOUBLE) * length(utr)))::INTEGER) AS r78, left(utr, (length(utr) - round((1 - 0.65::DOUBLE) * length(utr)))::INTEGER) AS r65 FROM b""")
def degrade_references(c: Case) -> DataFrame:
    return c.work.base().select("k", degrade_reference(F.col("utr"), 0.78).alias("r78"), degrade_reference(F.col("utr"), 0.65).alias("r65"))


QUERIES["degrade_reference"] = QUERIES.pop("degrade_references")
ORACLE["degrade_reference"] = ORACLE.pop("degrade_references")


@query("SELECT record_id, source, decision, corrected_match_id, score FROM log")
def corrections_load(c: Case) -> DataFrame:
    return c.work.corrections().select("record_id", "source", "decision", "corrected_match_id", "score")


@query("SELECT settlement_id, payment_id, gross, fee, tax, net, settled_at, utr, currency, row_number() OVER (ORDER BY settlement_id) - 1 AS seq FROM settlements")
def read_json_settlements(c: Case) -> DataFrame:
    """Written in the exchange format and read back; ``seq`` is the rank by id."""
    path = new_path(c.spark, "json")
    tables.write_json(c.work.settlements(), path, "settlements")
    return tables.read_json(c.spark, path, "settlements", "settlement_id")


@query("SELECT settlement_id, payment_id, gross, fee, tax, net, settled_at, utr, currency FROM settlements")
def read_json_array(c: Case) -> DataFrame:
    """Written as JSON array files and read back in byte ranges."""
    path = new_path(c.spark, "array")
    tables.write_array(c.work.settlements(), path, "settlements")
    return tables.read_json(c.spark, f"{path}/part-*", "settlements").drop("seq")


@query("""SELECT count(*) FILTER (WHERE k % 7 > 1) AS n_rows, count(*) FILTER (WHERE k % 7 <= 1) AS n_rejects FROM b""")
def read_json_rejects(c: Case) -> DataFrame:
    """Credits of which some are broken off or no numbers: rows and rejects together are all records."""
    path, k = new_path(c.spark, "array"), F.col("k")
    amount = F.when(k % 7 == 1, F.lit('"many"')).otherwise(F.col("net").cast("string"))
    text = F.concat(F.lit('{"id": "bank_'), k.cast("string"), F.lit('", "utr": "a } \\" { b", "creditedAmount": '), amount, F.lit(', "currency": "INR"}, '))
    broken = F.concat(F.lit('{"id": ['), k.cast("string"), F.lit(", }, "))
    c.work.base().select(F.when(k % 7 == 0, broken).otherwise(text)).write.text(path)
    rows, rejects = tables.read_json_checked(c.spark, f"{path}/part-*", "bank_credits")
    one = lambda df, good: df.select(F.lit(good).alias("good"))
    return one(rows, True).union(one(rejects, False)).agg(F.count_if("good").alias("n_rows"), F.count_if(~F.col("good")).alias("n_rejects"))


@query("SELECT record_id, source, decision, corrected_match_id, score, true AS stamped FROM log")
def corrections_append(c: Case) -> DataFrame:
    """Accepts, then rejects appended to a log; a missing first log falls back to it."""
    path, rows = new_path(c.spark, "log"), c.work.corrections()
    for decision in ("accept", "reject"):
        tables.append_corrections(rows.where(F.col("decision") == decision), path)
    read = tables.read_corrections(c.spark, new_path(c.spark, "none"), path)
    return read.select("record_id", "source", "decision", "corrected_match_id", "score", F.col("ts").isNotNull().alias("stamped"))


# ---------------------------------------------------------------- integrity


@query("SELECT settlement_id, gross, fee, tax, net FROM chk_spoiled WHERE bad_fee_tax")
def integrity_fee_tax(c: Case) -> DataFrame:
    return c.checked.where("bad_fee_tax").select("settlement_id", "gross", "fee", "tax", "net")


@query("SELECT settlement_id, payment_id FROM chk_spoiled WHERE orphan")
def integrity_orphan(c: Case) -> DataFrame:
    return c.checked.where("orphan").select("settlement_id", "payment_id")


@query("SELECT settlement_id, gross, paid FROM chk_spoiled WHERE bad_gross")
def integrity_gross(c: Case) -> DataFrame:
    return c.checked.where("bad_gross").select("settlement_id", "gross", "paid")


@query("SELECT settlement_id, currency, paid_currency FROM chk_spoiled WHERE bad_currency")
def integrity_currency(c: Case) -> DataFrame:
    return c.checked.where("bad_currency").select("settlement_id", "currency", "paid_currency")


@query(f"SELECT {EXC} FROM flagged_spoiled")
def integrity_check(c: Case) -> DataFrame:
    return integrity.integrity_exceptions(c.spoiled, c.work.settlements())


@query("SELECT settlement_id, net, settled_at, utr FROM settlements WHERE settlement_id NOT IN (SELECT record_id FROM flagged_spoiled)")
def clean_settlements(c: Case) -> DataFrame:
    return integrity.clean(c.work.settlements(), integrity_check(c)).select("settlement_id", "net", "settled_at", "utr")


# ---------------------------------------------------------------- corrections


@query("SELECT bank_credit_id, settlement_id, confidence, matched_by FROM human")
def human_matches(c: Case) -> DataFrame:
    return corrections.human_matches(c.work.corrections()).select("bank_credit_id", "settlement_id", "confidence", "matched_by")


@query("SELECT 'bank' AS source, bank_credit_id AS record_id FROM bank1 UNION ALL SELECT 'settlement', settlement_id FROM setl1")
def pools_after_corrections(c: Case) -> DataFrame:
    bank, settlement = c.complete.pools
    return bank.select(F.lit("bank").alias("source"), F.col("bank_credit_id").alias("record_id")).union(settlement.select(F.lit("settlement"), "settlement_id"))


@query("SELECT record_id, source, 'rejected for good in review' AS reason, 7 AS precedence FROM log WHERE decision = 'reject'")
def reject_exceptions(c: Case) -> DataFrame:
    return corrections.reject_exceptions(c.work.corrections()).select("record_id", "source", "reason", "precedence")


@query("""SELECT count(*) AS n, CASE WHEN count(*) >= 3 THEN round(greatest(0.5, avg(score) - 0.05), 2) END AS suggestion FROM log WHERE decision = 'accept' AND score >= 0.65 AND score < 0.75""")
def suggest_threshold(c: Case) -> DataFrame:
    return corrections.suggested_threshold(c.work.corrections())


@query("SELECT record_id, source, counterpart_id FROM counterpart")
def counterpart(c: Case) -> DataFrame:
    return corrections.counterparts(c.plain.exceptions).select("record_id", "source", "counterpart_id")


@query("""SELECT record_id, source, CASE WHEN seq % 2 = 0 THEN 'accept' ELSE 'reject' END AS decision, CASE WHEN seq % 2 = 0 THEN counterpart_id END AS corrected_match_id FROM counterpart""")
def review_to_corrections(c: Case) -> DataFrame:
    found = corrections.counterparts(c.plain.exceptions)
    decided = found.select("record_id", "source", F.when(F.col("seq") % 2 == 0, "accept").otherwise("reject").alias("decision"))
    return corrections.review_rows(decided, found)


# ---------------------------------------------------------------- exact and fuzzy


@query("SELECT bank_credit_id, settlement_id, confidence, matched_by FROM exact")
def exact_match(c: Case) -> DataFrame:
    return matching.exact_matches(c.records[2], c.plain.clean).select("bank_credit_id", "settlement_id", "confidence", "matched_by")


@query("SELECT bank_credit_id, utr, amount, credited_at FROM xb")
def exact_remaining_bank(c: Case) -> DataFrame:
    return c.plain.after_exact[0].select("bank_credit_id", "utr", "amount", "credited_at")


@query("SELECT settlement_id, utr, net, settled_at FROM xs")
def exact_remaining_settlements(c: Case) -> DataFrame:
    return c.plain.after_exact[1].select("settlement_id", "utr", "net", "settled_at")


@query("SELECT settlement_id, regexp_replace(upper(utr), '[^A-Z0-9]', '', 'g') AS reference FROM settlements")
def normalize_reference(c: Case) -> DataFrame:
    return c.work.settlements().select("settlement_id", C.normalised_reference(F.col("utr")).alias("reference"))


def _own_pairs(c: Case) -> DataFrame:
    """Credits beside the settlements of the same order."""
    order = lambda name: F.regexp_extract(name, r"_(\d+)", 1)
    bank = c.work.credits().select("bank_credit_id", F.col("utr").alias("b_utr"), F.col("amount").alias("b_amount"), "credited_at", "currency", order("bank_credit_id").alias("o"))
    return bank.join(c.work.settlements().select("settlement_id", F.col("utr").alias("s_utr"), "net", "settled_at", F.col("currency").alias("s_currency"), order("settlement_id").alias("o")), "o")


_OWN = """(SELECT bank_credit_id, settlement_id, c.utr AS b_utr, s.utr AS s_utr, c.amount AS b_amount, s.net AS net, c.credited_at AS credited_at, s.settled_at AS settled_at, c.currency AS currency,
  s.currency AS s_currency FROM credits c JOIN settlements s ON substr(bank_credit_id, 6, 9) = substr(settlement_id, 6, 9))"""


@query(f"SELECT bank_credit_id, settlement_id, levenshtein({sql._NORM.format('b_utr')}, {sql._NORM.format('s_utr')})::INTEGER AS distance FROM {_OWN}")
def reference_distance(c: Case) -> DataFrame:
    norm = C.normalised_reference
    return _own_pairs(c).select("bank_credit_id", "settlement_id", F.levenshtein(norm(F.col("b_utr")), norm(F.col("s_utr"))).alias("distance"))


@query(f"SELECT bank_credit_id, settlement_id, round({sql._sim('b_utr', 's_utr')}, 6) AS similarity FROM {_OWN}")
def reference_similarity(c: Case) -> DataFrame:
    return _own_pairs(c).select("bank_credit_id", "settlement_id", F.round(C.reference_similarity(F.col("b_utr"), F.col("s_utr")), 6).alias("similarity"))


@query(f"SELECT bank_credit_id, round({sql._TOL.format('amount')}, 6) AS tolerance FROM credits")
def amount_tolerance(c: Case) -> DataFrame:
    return c.work.credits().select("bank_credit_id", F.round(C.amount_tolerance(F.col("amount")), 6).alias("tolerance"))


@query(f"""SELECT bank_credit_id, settlement_id, round({sql._AMOUNT}, 6) AS amount_score, round({sql._DATE}, 6) AS date_score,
  round(CASE WHEN currency <> s_currency OR {sql._AMOUNT} = 0 OR {sql._DATE} = 0 THEN 0 ELSE {sql._AMOUNT} * 0.4::DOUBLE + {sql._DATE} * 0.3::DOUBLE + similarity * 0.3::DOUBLE END, 6) AS score,
  {sql._REASON} AS reason FROM (SELECT *, {sql._sim('b_utr', 's_utr')} AS similarity FROM {_OWN})""")
def pair_scores(c: Case) -> DataFrame:
    p = _own_pairs(c).withColumn("similarity", C.reference_similarity(F.col("b_utr"), F.col("s_utr")))
    args = [F.col(x) for x in ("b_amount", "net", "credited_at", "settled_at", "similarity")]
    score = F.when(F.col("currency") != F.col("s_currency"), 0.0).otherwise(C.pair_score(*args))
    return p.select(
        "bank_credit_id", "settlement_id", F.round(C.amount_score(*args[:2]), 6).alias("amount_score"), F.round(C.date_score(*args[2:4]), 6).alias("date_score"), F.round(score, 6).alias("score"), C.pair_reason(*args).alias("reason")
    )


@query("SELECT bank_credit_id, settlement_id, round(similarity, 6) AS similarity, round(score, 6) AS score, reasoning FROM e0")
def fuzzy_candidates(c: Case) -> DataFrame:
    return c.plain.candidates.select("bank_credit_id", "settlement_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "reasoning")


@query("""SELECT DISTINCT 'bank' AS source, bank_credit_id AS record_id FROM xb c JOIN xs s ON c.utr = s.utr AND c.amount = s.net AND c.credited_at = s.settled_at AND c.currency <> s.currency
  UNION SELECT 'settlement', settlement_id FROM xb c JOIN xs s ON c.utr = s.utr AND c.amount = s.net AND c.credited_at = s.settled_at AND c.currency <> s.currency""")
def currency_mismatch_pairs(c: Case) -> DataFrame:
    bank, settlement = matching.currency_pairs(*c.plain.after_exact)
    return bank.select(F.lit("bank").alias("source"), F.col("bank_credit_id").alias("record_id")).union(settlement.select(F.lit("settlement"), "settlement_id"))


@query("SELECT bank_credit_id, settlement_id, round(score, 6) AS score FROM assigned")
def fuzzy_assign(c: Case) -> DataFrame:
    return c.plain.assigned.select("bank_credit_id", "settlement_id", F.round("score", 6).alias("score"))


@query("SELECT bank_credit_id, settlement_id, confidence, matched_by, reasoning FROM fuzzy")
def fuzzy_match(c: Case) -> DataFrame:
    return c.plain.fuzzy.drop("components")


@query("SELECT bank_credit_id, settlement_id, score, reasoning FROM amb")
def fuzzy_ambiguous(c: Case) -> DataFrame:
    return c.plain.ambiguous.drop("b_seq", "s_seq")


@query(f"SELECT {EXC} FROM cur")
def currency_mismatch_exceptions(c: Case) -> DataFrame:
    return c.plain.other_currency


@query("SELECT bank_credit_id, utr, amount FROM fb")
def fuzzy_remaining_bank(c: Case) -> DataFrame:
    return c.plain.after_fuzzy[0].select("bank_credit_id", "utr", "amount")


@query("SELECT settlement_id, utr, net FROM fs")
def fuzzy_remaining_settlements(c: Case) -> DataFrame:
    return c.plain.after_fuzzy[1].select("settlement_id", "utr", "net")


# ---------------------------------------------------------------- split


@query("""SELECT bank_credit_id, count(*) AS n_candidates FROM fb c JOIN fs s ON c.currency = s.currency AND s.settled_at BETWEEN c.credited_at - 5 AND c.credited_at + 5 GROUP BY 1""")
def split_candidates(c: Case) -> DataFrame:
    return split.window_candidates(*c.plain.after_fuzzy)


@query("SELECT bank_credit_id, settlement_id, n_linked FROM link")
def split_linked(c: Case) -> DataFrame:
    return split.linked(*c.plain.after_fuzzy).select("bank_credit_id", "settlement_id", "n_linked")


@query("SELECT bank_credit_id, settlement_id, place FROM pool")
def split_pool(c: Case) -> DataFrame:
    return split.pools(split.linked(*c.plain.after_fuzzy)).select("bank_credit_id", "settlement_id", F.col("place").cast("long").alias("place"))


@query("SELECT bank_credit_id, n_solutions, array_to_string(components, '+') AS components, listed FROM solved")
def subset_sums(c: Case) -> DataFrame:
    return c.plain.solved.where("size(nets) > 0").select("bank_credit_id", "n_solutions", F.array_join("components", "+").alias("components"), "listed")


@query(f"SELECT {MATCH} FROM split")
def split_match(c: Case) -> DataFrame:
    return _flat(c.plain.split)


@query(f"SELECT {EXC} FROM splitx")
def split_ambiguous_exceptions(c: Case) -> DataFrame:
    return split.split_exceptions(c.plain.solved)


@query("SELECT bank_credit_id, utr, amount FROM pb")
def split_remaining_bank(c: Case) -> DataFrame:
    return c.plain.after_split[0].select("bank_credit_id", "utr", "amount")


@query("SELECT settlement_id, utr, net FROM ps")
def split_remaining_settlements(c: Case) -> DataFrame:
    return c.plain.after_split[1].select("settlement_id", "utr", "net")


@query(f"SELECT bank_credit_id, b_seq, amount, n_solutions, array_to_string(components, '+') AS components, listed FROM turn_{sql.TURNS}")
def split_general(c: Case) -> DataFrame:
    """Batched payouts from any settlement of the window, credits taking turns."""
    return c.general.solved.where("size(nets) > 0").select("bank_credit_id", "b_seq", "amount", "n_solutions", F.array_join("components", "+").alias("components"), "listed")


# ---------------------------------------------------------------- verdicts


@query("""SELECT bank_credit_id, settlement_id, to_json({'bank': {'id': bank_credit_id, 'utr': c.utr, 'amount': c.amount, 'date': c.credited_at::VARCHAR, 'currency': c.currency},
  'settlement': {'id': settlement_id, 'utr': s.utr, 'amount': s.net, 'date': s.settled_at::VARCHAR, 'currency': s.currency}, 'score': score, 'reasoning': reasoning})::VARCHAR AS request
  FROM amb JOIN credits c USING (bank_credit_id) JOIN settlements s USING (settlement_id)""")
def verdict_requests(c: Case) -> DataFrame:
    return verdicts.requests(c.plain.ambiguous, c.records[2], c.records[1])


@query("SELECT bank_credit_id, settlement_id, verdict, said AS reasoning FROM said")
def parse_verdicts(c: Case) -> DataFrame:
    return verdicts.parsed(c.work.replies(c.plain.ambiguous)).drop("error")


@query(f"SELECT 'match' AS kind, bank_credit_id AS record_id, 'pair' AS source, confidence, reasoning AS reason FROM llm UNION ALL SELECT 'exception', record_id, source, NULL, reason FROM llmx")
def route_verdicts(c: Case) -> DataFrame:
    found, left = c.with_verdicts.verdicts
    one = found.select(F.lit("match").alias("kind"), F.col("bank_credit_id").alias("record_id"), F.lit("pair").alias("source"), "confidence", F.col("reasoning").alias("reason"))
    return one.union(left.select(F.lit("exception"), "record_id", "source", F.lit(None).cast("double"), "reason"))


def _cautious() -> Callable[[dict], str]:
    """A resolver for the registered query: it takes pairs of one amount and cannot judge others far below the threshold."""

    def resolve(pair: dict) -> str:
        if pair["reasoning"].startswith("amount off"):
            if pair["score"] < 0.7:
                raise ValueError("amounts differ")
            return '{"verdict": "unsure"}'
        return '{"verdict": "match", "reasoning": "same amount"}'

    return resolve


@query("""SELECT bank_credit_id, settlement_id, CASE WHEN NOT starts_with(reasoning, 'amount off') THEN '{"verdict": "match", "reasoning": "same amount"}'
    WHEN score >= 0.7::DOUBLE THEN '{"verdict": "unsure"}' END AS reply, CASE WHEN starts_with(reasoning, 'amount off') AND score < 0.7::DOUBLE THEN 'amounts differ' END AS error FROM amb""")
def resolve_verdicts(c: Case) -> DataFrame:
    return verdicts.asked(c.plain.ambiguous, _cautious, new_path(c.spark, "ledger"), "query")


@query(f"SELECT {EXC} FROM nollmx")
def verdicts_unavailable(c: Case) -> DataFrame:
    return c.plain.verdicts[1]


# ---------------------------------------------------------------- consolidation


@query(f"SELECT {MATCH}, pass_order FROM matches_a")
def all_matches(c: Case) -> DataFrame:
    m = c.complete.matches
    return m.withColumn("components", F.array_join("components", "+"))


@query("SELECT source, record_id FROM ids_0")
def matched_ids(c: Case) -> DataFrame:
    return consolidate.matched_ids(c.plain.matches)


@query(f"SELECT {EXC} FROM leftb_0")
def classify_leftover_bank(c: Case) -> DataFrame:
    return consolidate.leftover_banks(c.plain.after_split[0], c.records[1])


@query(f"SELECT {EXC} FROM lefts_0")
def leftover_settlements(c: Case) -> DataFrame:
    return consolidate.leftover_settlements(c.plain.after_split[1])


@query(f"SELECT {EXC} FROM exc_0")
def all_exceptions(c: Case) -> DataFrame:
    return c.plain.exceptions


@query("""SELECT (SELECT count(*) FROM credits) AS n_credits, (SELECT count(*) FROM settlements) AS n_settlements, (SELECT count(*) FROM matches_v) AS n_matches,
  (SELECT count(*) FROM exc_v) AS n_exceptions, (SELECT count(*) FROM llm) AS n_verdict_matches""")
def run_counts(c: Case) -> DataFrame:
    run = c.with_verdicts
    tag = lambda df, name: df.select(F.lit(name).alias("what"))
    rows = tag(run.credits, "c").union(tag(run.settlements, "s")).union(tag(run.matches, "m")).union(tag(run.exceptions, "e")).union(tag(run.matches.where("matched_by = 'llm'"), "v"))
    n = lambda what, name: F.count_if(F.col("what") == what).alias(name)
    return rows.agg(n("c", "n_credits"), n("s", "n_settlements"), n("m", "n_matches"), n("e", "n_exceptions"), n("v", "n_verdict_matches"))


@query(f"SELECT {MATCH} FROM matches_a")
def reconcile_matches(c: Case) -> DataFrame:
    return _flat(c.complete.matches)


@query(f"SELECT {EXC} FROM exc_a")
def reconcile_exceptions(c: Case) -> DataFrame:
    return c.complete.exceptions


@query(f"SELECT {MATCH} FROM matches_a")
def rerun_matches(c: Case) -> DataFrame:
    """The run with corrections, from the tables of the run without them."""
    return _flat(c.corrected.matches)


@query(f"SELECT {EXC} FROM exc_a")
def rerun_exceptions(c: Case) -> DataFrame:
    return c.corrected.exceptions


# ---------------------------------------------------------------- scoring


@query("SELECT bank_credit_id, settlement_id, matched_by, label_class, level FROM tp_0")
def score_pairs(c: Case) -> DataFrame:
    return scoring.paired(c.plain.matches, c.labels)


@query("SELECT tp, fp, fn, n_predicted, n_true FROM cnt_0")
def score_counts(c: Case) -> DataFrame:
    return scoring.counts(c.plain.matches, c.labels)


@query("SELECT precision, recall, match_rate, fp_rate FROM head_0")
def score_headline(c: Case) -> DataFrame:
    return scoring.headline(score_counts(c))


@query("""SELECT (SELECT count(*) FROM true_ids) AS n_true, count(*) AS n_predicted, count(*) FILTER (WHERE (source, record_id) IN (SELECT (source, record_id) FROM true_ids)) AS n_correct,
  round(count(*) FILTER (WHERE (source, record_id) IN (SELECT (source, record_id) FROM true_ids))::DOUBLE / count(*), 6) AS accuracy FROM exc_0""")
def exception_accuracy(c: Case) -> DataFrame:
    return scoring.exception_accuracy(c.plain.exceptions, c.labels)


@query("SELECT matched_by, n FROM src_0")
def match_source_breakdown(c: Case) -> DataFrame:
    return scoring.by_source(c.plain.matches)


@query("""SELECT level, tp, fp, fn, n_predicted, n_true, CASE WHEN n_predicted > 0 THEN round(tp::DOUBLE / n_predicted, 6) END AS precision,
  CASE WHEN n_true > 0 THEN round(tp::DOUBLE / n_true, 6) END AS recall FROM lvl_0""")
def score_by_level(c: Case) -> DataFrame:
    return scoring.level_metrics(scoring.slices(c.plain.matches, c.labels))


@query("SELECT level, n, deferred, rate FROM defer_0")
def deferral_by_level(c: Case) -> DataFrame:
    return scoring.deferral(c.plain.matches, c.labels)


def _batch(name: str) -> F.Column:
    return (F.floor(F.regexp_extract(name, r"_(\d+)", 1).cast("long") / 100) % sql.BATCHES).alias("batch_id")


@query(f"SELECT batch_id, {MATCH} FROM matches_q")
def reconcile_batches(c: Case) -> DataFrame:
    """Separate batches in one run; none meets another."""
    return c.batched.matches.select(F.col("batch").cast("long").alias("batch_id"), *_flat(c.batched.matches).columns[:2], F.array_join("components", "+").alias("components"), "confidence", "matched_by", "reasoning")


@query("""SELECT metric, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM (UNPIVOT batch_head ON precision, recall, match_rate, fp_rate INTO NAME metric VALUE value) GROUP BY metric""")
def robustness(c: Case) -> DataFrame:
    matches = c.batched.matches.withColumn("batch_id", F.col("batch").cast("long"))
    labels = c.labels.where("label = 'match'").withColumn("batch_id", _batch("bank_credit_id"))
    return scoring.robustness(scoring.headline(scoring.counts(matches, labels, ("batch_id",)), ("batch_id",)))


@query("""SELECT 'integrity' AS pass, count(*) AS n_rows FROM flagged UNION ALL SELECT 'clean', count(*) FROM clean UNION ALL SELECT 'exact', count(*) FROM exact UNION ALL SELECT 'edges', count(*) FROM e0
  UNION ALL SELECT 'currency', count(*) FROM cur UNION ALL SELECT 'matches', count(*) FROM matches_0 UNION ALL SELECT 'swept', count(*) FROM exc_0""")
def pass_rows(c: Case) -> DataFrame:
    """Rows that each pass of a run writes, counted while they are written."""
    run = Reconciliation(*c.records)
    with metered() as seen:
        run.exceptions  # noqa: B018  runs all passes
    names = {"integrity", "clean", "exact", "edges", "currency", "matches", "swept"}
    return c.spark.createDataFrame([(name, n) for name, n, _ in seen if name in names], "pass string, n_rows long")


@query("SELECT name, least(n, 50) AS n, n >= 50 AS enough FROM (SELECT 'settlements' AS name, count(*) AS n FROM settlements UNION ALL SELECT 'credits', count(*) FROM credits)")
def workload_size(c: Case) -> DataFrame:
    """The guard against batches too small to score: counting stops at its bound."""
    one = lambda name, df: df.limit(50).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    check_size(c.work.settlements(), c.work.credits())
    return one("settlements", c.work.settlements()).union(one("credits", c.work.credits())).withColumn("enough", F.col("n") >= 50)


@query("""SELECT a.precision AS precision_without, b.precision AS precision_with, a.recall AS recall_without, b.recall AS recall_with, a.fp_rate AS fp_rate_without, b.fp_rate AS fp_rate_with
  FROM head_0 a, head_v b""")
def ablation(c: Case) -> DataFrame:
    labels = staged(c.labels, "labels")
    a, b = (scoring.headline(scoring.counts(r.matches, labels)) for r in (c.plain, c.with_verdicts))
    side = lambda df, name: df.select(*[F.col(x).alias(f"{x}_{name}") for x in ("precision", "recall", "fp_rate")])
    return side(a, "without").crossJoin(side(b, "with")).select("precision_without", "precision_with", "recall_without", "recall_with", "fp_rate_without", "fp_rate_with")  # one row each


BOUNDS = (("precision", ">=", 0.90), ("recall", ">=", 0.88), ("match_rate", ">=", 0.88), ("fp_rate", "<=", 0.05))


@query("""SELECT metric, value, op, bound::DOUBLE AS bound, CASE WHEN op = '>=' THEN value >= bound ELSE value <= bound END AS passed
  FROM (UNPIVOT head_0 ON precision, recall, match_rate, fp_rate INTO NAME metric VALUE value)
  JOIN (VALUES ('precision', '>=', 0.90), ('recall', '>=', 0.88), ('match_rate', '>=', 0.88), ('fp_rate', '<=', 0.05)) v(metric, op, bound) USING (metric)""")
def baseline_gate(c: Case) -> DataFrame:
    return scoring.gate(score_headline(c), c.spark.createDataFrame(BOUNDS, "metric string, op string, bound double"))


# ---------------------------------------------------------------- report


_VIEW = """SELECT record_id, source, exception_type, reason, {0} AS sort_key, precedence, seq, row_number() OVER (ORDER BY {0}, precedence, seq, source, record_id) AS place FROM exc_0 WHERE {1}"""


@query(_VIEW.format("coalesce(exception_type, '')", "exception_type = 'batched_payout' OR source = 'batched_payout'"))
def exceptions_view(c: Case) -> DataFrame:
    return report.exceptions_view(c.plain.exceptions, "batched_payout")


@query(_VIEW.format("source", "true"))
def exceptions_by_source(c: Case) -> DataFrame:
    return report.exceptions_view(c.plain.exceptions, sort_by="source")


@query("SELECT DISTINCT coalesce(exception_type, source) AS kind FROM exc_0")
def exception_types(c: Case) -> DataFrame:
    return report.exception_types(c.plain.exceptions)


@query("""SELECT record_id, source, exception_type, greatest((SELECT count(*) FROM exc_0) - 20, 0) AS n_more FROM exc_0 ORDER BY precedence, seq, source, record_id LIMIT 20""")
def exception_preview(c: Case) -> DataFrame:
    return report.exception_preview(c.plain.exceptions)


_P = "CASE WHEN {0} IS NULL THEN '—' ELSE printf('%.2f%%', {0} * 100) END"


@query(f"""SELECT list_position(['clear', 'boundary', 'decoy', 'unresolvable'], level)::INTEGER AS place, level,
  {_P.format('recall')} AS match_rate, {_P.format('precision')} AS precision, {_P.format('rate')} AS deferred
  FROM (SELECT level, CASE WHEN n_predicted > 0 THEN round(tp::DOUBLE / n_predicted, 6) END AS precision, CASE WHEN n_true > 0 THEN round(tp::DOUBLE / n_true, 6) END AS recall FROM lvl_0)
  LEFT JOIN defer_0 USING (level)""")
def difficulty_table(c: Case) -> DataFrame:
    return report.difficulty_table(score_by_level(c), deferral_by_level(c))


@query("""SELECT list_position(['human', 'exact', 'fuzzy', 'split', 'llm'], matched_by)::INTEGER AS place, matched_by, n, round(n::DOUBLE / (SELECT greatest(max(n), 1) FROM src_0), 6) AS share FROM src_0""")
def match_source_bars(c: Case) -> DataFrame:
    return report.match_source_bars(match_source_breakdown(c))


@query("""SELECT id, bank_credit_id, settlement_id, matched_by, confidence FROM (
  SELECT bank_credit_id AS id, * FROM matches_0 UNION ALL SELECT unnest(list_distinct(list_append(coalesce(components, []), settlement_id))), * FROM matches_0)
  WHERE id IN (SELECT bank_credit_id FROM labels WHERE level = 'boundary') OR id IN (SELECT settlement_id FROM labels WHERE level = 'boundary')""")
def match_lookup(c: Case) -> DataFrame:
    some = c.labels.where("level = 'boundary'")
    return report.match_lookup(c.plain.matches, some.select(F.col("bank_credit_id").alias("id")).union(some.select("settlement_id")))


@query("""SELECT 'metrics' AS kind, printf('{"precision":%.6f,"recall":%.6f,"match_rate":%.6f,"fp_rate":%.6f}', precision, recall, match_rate, fp_rate) AS body FROM head_0
  UNION ALL SELECT 'match', to_json({'bank_credit_id': bank_credit_id, 'settlement_id': settlement_id, 'components': components, 'confidence': confidence, 'matched_by': matched_by,
    'reasoning': reasoning, 'pass_order': pass_order})::VARCHAR FROM matches_0
  UNION ALL SELECT 'exception', to_json({'record_id': record_id, 'source': source, 'reason': reason, 'exception_type': exception_type, 'precedence': precedence, 'seq': seq})::VARCHAR FROM exc_0""")
def report_document(c: Case) -> DataFrame:
    return report.report_document(score_headline(c), c.plain.matches, c.plain.exceptions)


