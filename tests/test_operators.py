"""Cases of single operators, with values of our own."""

import json
from datetime import date, timedelta

import pytest
from helpers import DAY, credits, pairs, payments, settlements
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.functions import columns as C
from tallyloom.operators import consolidate, corrections, integrity, matching, report, scoring, split, verdicts
from tallyloom.plans.cluster import staged
from tallyloom.plans.reconcile import Reconciliation
from tallyloom.plans.workload import check_size
from tallyloom.sources import tables
from tallyloom.streaming import reviews


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_exact(spark):
    """The n-th credit of a key takes its n-th settlement, by seq; any other currency, day or cent is another key."""
    b = credits(spark, ("late", "R9", 7312, DAY, "EUR"), ("lone", "R9", 7312, DAY, "GBP"), ("next", "R9", 7312, DAY, "EUR"), ("cent", "R9", 7313, DAY, "EUR"), ("third", "R9", 7312, DAY, "EUR"))
    s = settlements(spark, ("x", "R9", 7312, DAY, "EUR"), ("y", "R9", 7312, DAY + timedelta(1), "EUR"), ("z", "R9", 7312, DAY, "EUR"))
    found = matching.exact_matches(b, s)
    assert pairs(found) == [("late", "x"), ("next", "z")]
    assert pairs(matching.without_credits(b, found), "bank_credit_id") == [("cent",), ("lone",), ("third",)]
    assert pairs(matching.without_settlements(s, found), "settlement_id") == [("y",)]


def test_references_and_scores(spark):
    lit = F.lit
    assert [one(spark, C.normalised_reference(lit(x))) for x in ("k.9/q_7", "  ", "ÄB1")] == ["K9Q7", "", "B1"]
    assert one(spark, C.reference_similarity(lit("q7 / k9"), lit("Q-7-K-9"))) == 1.0
    assert one(spark, C.reference_similarity(lit("ABCDE"), lit("ABXDE"))) == pytest.approx(0.8)
    assert one(spark, C.reference_similarity(lit("./"), lit("Z"))) == 0.0
    assert [one(spark, C.amount_tolerance(lit(x))) for x in (0, 2499, 2501, -40000)] == [50.0, 50.0, pytest.approx(50.02), 800.0]
    assert one(spark, C.amount_score(lit(40000), lit(40800))) == 0.0 and one(spark, C.amount_score(lit(40000), lit(39800))) == pytest.approx(0.75)
    assert [one(spark, C.date_score(lit(DAY), lit(DAY - timedelta(n)))) for n in (0, 1, 3, 4)] == [1.0, 0.75, 0.25, 0.0]
    assert [one(spark, C.money_text(lit(x))) for x in (8090, 3, -4501, 600)] == ["80.9", "0.03", "-45.01", "6"]
    assert one(spark, C.link_keys(lit("_S_Sx_S"))) == ["", "_S", "_S_Sx"] and one(spark, C.link_keys(lit("plain"))) == []


@pytest.mark.parametrize(("net", "days", "hit"), [(52000, 0, True), (52000, 3, True), (52000, -4, False), (53039, 1, True), (53040, 0, False), (50961, 0, True), (50960, 0, False)])
def test_fuzzy_candidates(spark, net, days, hit):
    """The edge of the amount and of the day window scores nothing; a shared reference does not help."""
    b = credits(spark, ("c", "PAY-77", 52000, DAY, "EUR"), ("other", "PAY-77", 52000, DAY, "CHF"))
    s = settlements(spark, ("s", "pay77", net, DAY + timedelta(days), "EUR"))
    assert pairs(matching.fuzzy_candidates(b, s)) == [("c", "s")] * hit


def test_currency(spark):
    b = credits(spark, ("B1", "U", 500, DAY, "USD"), ("B2", "U", 500, DAY, "INR"))
    s = settlements(spark, ("S1", "U", 500, DAY, "INR"))
    bank, settlement = matching.currency_pairs(b, s)
    assert pairs(bank, "bank_credit_id") == [("B1",)] and pairs(settlement, "settlement_id") == [("S1",)]


def test_bands(spark):
    rows = spark.createDataFrame([("B1", "S1", 0.75), ("B2", "S2", 0.7), ("B3", "S3", 0.5), ("B4", "S4", 0.49)], "bank_credit_id string, settlement_id string, score double")
    rows = rows.select("*", F.lit(0).alias("b_seq"), F.lit(0).alias("s_seq"), F.lit("").alias("reasoning"))
    kept = matching.usable_bands(rows)
    assert pairs(matching.fuzzy_matches(kept)) == [("B1", "S1")] and pairs(matching.ambiguous(kept)) == [("B2", "S2"), ("B3", "S3")]


def test_subsets():
    """Depth first over places, two to six parts, sums within the tolerance of the target."""
    assert split.subset_sums([7700, 1900, 4100, 8300], 12400) == [(2, 3)]
    assert split.subset_sums([6400, 3600, 2500, 7500], 10000) == [(0, 1), (2, 3)]
    assert split.subset_sums([9000, 40, 60, 900], 10000) == [(0, 1, 2, 3), (0, 1, 3), (0, 2, 3), (0, 3)]
    assert split.subset_sums([700] * 9, 1400, limit=4) == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert split.subset_sums([], 5) == split.subset_sums([5], 5) == split.subset_sums([2000] * 7, 14000) == []


def test_split_modes(spark):
    """One set fits: a match. Two sets fit: an exception that lists both. None fits: nothing."""
    b = credits(spark, ("two", "K", 9100, DAY, "EUR"), ("one", "L", 8800, DAY, "EUR"), ("none", "M", 5000, DAY, "EUR"))
    s = settlements(
        spark, ("k1", "K_S9", 3300, DAY, "EUR"), ("k2", "K_S8", 5800, DAY, "EUR"), ("k3", "K_S7", 4600, DAY, "EUR"), ("k4", "K_S6", 4500, DAY, "EUR"),
        ("l1", "L_S1", 1100, DAY, "EUR"), ("l2", "L_S2", 2900, DAY, "EUR"), ("l3", "L_S3", 4800, DAY, "EUR"), ("m1", "M_S1", 700, DAY, "EUR"), ("m2", "M_S2", 900, DAY, "EUR"),
    )
    for linked_only in (True, False):
        solved = split.solve(b, s, staged, linked_only=linked_only)
        assert [(r.bank_credit_id, r.components) for r in split.split_matches(solved).collect()] == [("one", ["l1", "l2", "l3"])]
        assert pairs(split.split_exceptions(solved), "record_id", "reason") == [("two", "several sets of settlements fit: k1+k2 | k3+k4")]


def test_split_consumes_and_caps(spark):
    """Credits of one reference take turns; what one has used the next cannot have. Only the first 25 links are tried."""
    b = credits(spark, ("b", "K", 6200, DAY, "EUR"), ("a", "K", 6200, DAY, "EUR"))
    s = settlements(spark, ("k1", "K_S1", 2100, DAY, "EUR"), ("k2", "K_S2", 4100, DAY, "EUR"), ("k3", "K_S3", 9900, DAY, "EUR"))
    for linked_only in (True, False):
        solved = split.solve(b, s, staged, linked_only=linked_only)
        assert pairs(split.split_matches(solved)) == [("b", "k1")]
    many = lambda n: settlements(spark, *[(f"k{i:02d}", f"K_S{i}", 10 if i < n else 3100, DAY, "EUR") for i in range(n + 2)])
    assert [split.solve(b.limit(1), many(n), staged, linked_only=True).first()["n_solutions"] for n in (23, 25)] == [5, 0]


def test_integrity(spark):
    """A broken fee sum comes first, then a missing payment, the gross amount and the currency; the last payment of an id counts."""
    s = spark.createDataFrame(
        [("sum", "p1", 5400, 110, 19, 5290, DAY, "R", "EUR", 0), ("gone", "p2", 5400, 110, 19, 5271, DAY, "R", "EUR", 1), ("gross", "p3", 640, 0, 0, 640, DAY, "R", "EUR", 2),
         ("cur", "p4", 640, 0, 0, 640, DAY, "R", "EUR", 3), ("cent", "p5", 640, 5, 0, 634, DAY, "R", "EUR", 4)],
        schemas.SETTLEMENTS,
    )
    p = payments(spark, ("p1", 1, "GBP"), ("p3", 637, "EUR"), ("p4", 9, "EUR"), ("p4", 640, "GBP"), ("p5", 641, "EUR"))
    found = {r.record_id: r.exception_type for r in integrity.integrity_exceptions(p, s).collect()}
    assert found == {"sum": "fee_tax_mismatch", "gone": None, "gross": None, "cur": "currency_mismatch"}  # one cent is tolerated


REPLIES = [
    ('x {"verdict": "match", "reasoning": " ok "} y', "match", "ok"), ('{"verdict": "no_match"}', "no_match", "no reason given"), ("none", "unsure", "reply holds no JSON"), ("} {", "unsure", "reply holds invalid JSON"),
    ("{bad}", "unsure", "reply holds invalid JSON"), ('{"verdict": "perhaps"}', "unsure", "reply holds no known verdict"), ('{"verdict": "match", "reasoning": 5}', "unsure", "reply holds invalid JSON"), (None, "unsure", "reply holds no JSON"),
]


def test_verdict_texts(spark):
    rows = spark.createDataFrame([(f"B{i}", "S", r[0], None) for i, r in enumerate(REPLIES)], "bank_credit_id string, settlement_id string, reply string, error string")
    assert [(r.verdict, r.reasoning) for r in verdicts.parsed(rows).orderBy("bank_credit_id").collect()] == [r[1:] for r in REPLIES]


def test_verdict_routes(spark):
    amb = spark.createDataFrame([("B1", "S1", 0.6, "", 1, 1), ("B2", "S2", 0.6, "", 2, 2), ("B3", "S3", 0.6, "", 3, 3)], "bank_credit_id string, settlement_id string, score double, reasoning string, b_seq long, s_seq long")

    def make():
        def resolve(pair):
            if pair["bank_credit_id"] == "B2":
                raise ValueError("down")
            return json.dumps({"verdict": "match" if pair["bank_credit_id"] == "B1" else "no_match", "reasoning": "r"})

        return resolve

    matches, left = verdicts.routed(amb, verdicts.parsed(staged(verdicts.resolved(amb, make), "replies")))
    assert [(r.bank_credit_id, r.confidence) for r in matches.collect()] == [("B1", 0.8)]
    assert pairs(left, "record_id", "reason") == [("B2", "ambiguous, verdict failed: down"), ("B3", "verdict no_match: r"), ("S2", "ambiguous, verdict failed: down"), ("S3", "verdict no_match: r")]


def log(spark, *rows):
    return spark.createDataFrame([(*r[:4], r[4] if len(r) > 4 else None, r[5] if len(r) > 5 else None, None, i) for i, r in enumerate(rows)], schemas.CORRECTIONS)


def test_corrections(spark):
    rows = log(spark, ("B1", "bank", "accept", "S1", None, 0.7), ("S2", "settlement", "accept", "B2", ["S2", "S3"], 0.7), ("P1", "payment", "accept", "S9"), ("B3", "bank", "accept", None, None, 0.72), ("B4", "bank", "reject", None))
    assert pairs(corrections.human_matches(rows)) == [("B1", "S1"), ("B2", "S2")]
    assert corrections.skipped(rows).count() == 2
    b = credits(spark, *[(f"B{i}", "U", 1, DAY, "INR") for i in range(1, 6)])
    s = settlements(spark, *[(f"S{i}", "U", 1, DAY, "INR") for i in range(1, 5)])
    bank, settlement = corrections.pools_after(b, s, rows)
    assert pairs(bank, "bank_credit_id") == [("B3",), ("B5",)] and pairs(settlement, "settlement_id") == [("S4",)]
    assert tuple(corrections.suggested_threshold(rows).first()) == (3, 0.66)
    assert tuple(corrections.suggested_threshold(rows.limit(0)).first()) == (0, None)


def test_counterparts(spark):
    rows = spark.createDataFrame(
        [("bank_2", "bank", "r", None, 5, 0), ("bank_7", "bank", "r", None, 5, 1), ("setl_7", "settlement", "r", None, 5, 2), ("setl_9", "settlement", "r", None, 5, 3), ("setl_1", "settlement", "q", None, 5, 4)], schemas.EXCEPTIONS
    )
    found = {r.record_id: r.counterpart_id for r in corrections.counterparts(rows).collect()}
    assert found == {"bank_2": "setl_7", "bank_7": "setl_7", "setl_7": "bank_7", "setl_9": "bank_2", "setl_1": None}


LABELS = [
    ("c1", "t1", None, None, "match", None, "clean", "clear", 0), ("c2", "t2", None, None, "match", None, "date_shifted", "boundary", 1), ("c3", "t3", None, None, "match", None, "clean", "clear", 2),
    (None, "t7", None, None, "exception", "settlement_pending_bank", "settlement_pending_bank", "unresolvable", 3), ("c8", None, None, None, "exception", "unclaimed_bank_credit", "unclaimed_bank_credit", "decoy", 4),
]


def test_scores(spark):
    """Two right of three, one settlement that should have stayed open; a level counts what touches its labels."""
    labels = spark.createDataFrame(LABELS, schemas.LABELS)
    matches = spark.createDataFrame([("c1", "t1", None, 1.0, "exact", None, 2), ("c2", "t7", None, 0.8, "fuzzy", None, 3), ("c3", "t3", None, 0.9, "fuzzy", None, 3)], schemas.MATCHES + ", pass_order int")
    counted = scoring.counts(matches, labels)
    assert counted.first().asDict() == {"tp": 2, "fp": 1, "fn": 1, "n_predicted": 3, "n_true": 3}
    assert scoring.headline(counted).first()["precision"] == pytest.approx(2 / 3)
    levels = {r.level: (r.tp, r.fp, r.fn) for r in scoring.slices(matches, labels).collect()}
    assert levels == {"clear": (2, 0, 0), "boundary": (0, 1, 1), "decoy": (0, 0, 0), "unresolvable": (0, 1, 0)}
    assert sorted((r.level, r.deferred) for r in scoring.deferral(matches, labels).collect()) == [("decoy", 1), ("unresolvable", 0)]
    none = scoring.headline(scoring.counts(matches.limit(0), labels.limit(0))).first()
    assert (none.precision, none.recall, none.fp_rate) == (1.0, 1.0, 0.0)
    assert {r.matched_by: r.n for r in scoring.by_source(matches).collect()} == {"human": 0, "exact": 1, "fuzzy": 2, "split": 0, "llm": 0}


def test_components_count_as_a_set(spark):
    labels = spark.createDataFrame([("B1", "S1", ["S2", "S1"], None, "match", None, "batched_payout", "clear", 0)], schemas.LABELS)
    good = spark.createDataFrame([("B1", "S1", ["S1", "S2"], 1.0, "split", None, 4)], schemas.MATCHES + ", pass_order int")
    bad = spark.createDataFrame([("B1", "S1", None, 1.0, "fuzzy", None, 3)], schemas.MATCHES + ", pass_order int")
    assert scoring.counts(good, labels).first()["tp"] == 1 and scoring.counts(bad, labels).first()["tp"] == 0


def test_exception_precedence(spark):
    rows = spark.createDataFrame([("B1", "bank", "late", None, 5, 0), ("B1", "bank", "early", None, 1, 9), ("B2", "bank", "x", None, 5, 1), ("B1", "settlement", "other", None, 6, 2)], schemas.EXCEPTIONS)
    matches = spark.createDataFrame([("B2", "S1", ["S1", "S3"], 1.0, "split", None)], schemas.MATCHES)
    assert pairs(consolidate.all_exceptions([rows], matches), "source", "record_id", "reason") == [("bank", "B1", "early"), ("settlement", "B1", "other")]
    assert pairs(report.exception_types(rows), "kind") == [("bank",), ("settlement",)]


def test_empty_run(spark):
    run = Reconciliation(payments(spark), settlements(spark), credits(spark), log(spark))
    assert run.matches.count() == 0 and run.exceptions.count() == 0


def test_size_guard(spark):
    with pytest.raises(ValueError):
        check_size(settlements(spark), credits(spark))


def test_sources(spark, tmp_path):
    file = tmp_path / "credits.json"
    file.write_text(json.dumps([{"id": "B2", "utr": "U", "creditedAmount": 12.34, "creditedAt": "2025-01-15", "currency": "INR"}, {"id": "B1", "utr": "U", "creditedAmount": 5, "creditedAt": "2025-01-16", "currency": "INR"}], indent=2))
    rows = tables.read_json(spark, str(file), "bank_credits", "bank_credit_id").orderBy("seq").collect()
    assert [(r.bank_credit_id, r.amount, r.credited_at, r.seq) for r in rows] == [("B1", 500, date(2025, 1, 16), 0), ("B2", 1234, DAY, 1)]
    assert tables.read_corrections(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad.json").write_text("[{")
    assert tables.read_corrections(spark, str(tmp_path / "bad.json")).count() == 0
    decisions = log(spark, ("B1", "bank", "accept", "S1", None, 0.7)).drop("ts", "seq")
    tables.append_corrections(decisions, str(tmp_path / "log"))
    tables.append_corrections(decisions, str(tmp_path / "log"))
    read = tables.read_corrections(spark, str(tmp_path / "bad.json"), str(tmp_path / "log"))
    assert read.count() == 2 and read.first()["ts"] is not None
    many = log(spark, *[(f"B{i}", "bank", "accept", f"S{i}", None, 0.7) for i in range(300)]).coalesce(1)
    tables.append_corrections(many, str(tmp_path / "long"))
    assert tables.read_corrections(spark, str(tmp_path / "long")).count() == 300
    tables.write_report(report.report_document(scoring.headline(spark.createDataFrame([(1, 0, 0, 1, 1)], "tp int, fp int, fn int, n_predicted int, n_true int")), spark.createDataFrame([], schemas.MATCHES), spark.createDataFrame([], schemas.EXCEPTIONS)), spark.createDataFrame([], schemas.MATCHES), spark.createDataFrame([], schemas.EXCEPTIONS), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "document")).count() == 1


def test_positions_over_many_partitions(spark):
    n = 400_000
    rows = spark.range(n, numPartitions=8).select(F.concat(F.lit("r"), F.format_string("%09d", (F.col("id") * 7919) % n)).alias("name"))
    wrong = tables.with_seq(rows, "name").where(F.col("seq") != F.substring("name", 2, 9).cast("long"))
    assert wrong.count() == 0


def test_review_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"record_id": "B1", "source": "bank", "decision": "reject"}\n{"record_id": "B2", "source": "bank", "decision": "maybe"}\n')
    reviews.log_reviews(reviews.review_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "at")).awaitTermination()
    assert pairs(tables.read_corrections(spark, str(tmp_path / "log")), "record_id") == [("B1",)]
