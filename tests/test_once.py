"""What whole runs read and compute once."""

from pathlib import Path

import pytest
from helpers import DAY, credits, pairs, settlements

from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.operators import consolidate, matching, split
from tallyloom.plans import reconcile
from tallyloom.plans.cluster import staged
from tallyloom.plans.queries import Case

DATA = "/root/testdata/sf0.001"


def listing(names):
    def stage(df, name):
        names.append(name)
        return staged(df, name)

    return stage


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")
def test_runs_do_not_derive_their_records_again(spark):
    case = Case(spark, DATA)
    for run in (case.plain, case.general, case.batched.run):
        for df in (run.payments, run.settlements, run.credits):
            assert not any("orders" in f or "lineitem" in f for f in df.inputFiles())
    assert pairs(case.plain.settlements, *case.work.settlements().columns) == pairs(case.work.settlements(), *case.work.settlements().columns)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")
def test_verdicts_do_not_run_the_passes_before_them_again(spark, monkeypatch):
    names, case = [], Case(spark, DATA)
    apart = reconcile.Reconciliation(*case.records)
    apart.replies = case.work.replies(apart.ambiguous)
    want = pairs(apart.matches, "bank_credit_id", "settlement_id", "matched_by"), pairs(apart.exceptions, "source", "record_id", "exception_type")
    monkeypatch.setattr(reconcile, "staged", listing(names))
    assert len(pairs(case.plain.matches)) < len(want[0])
    done = len(names)
    run = case.with_verdicts
    assert pairs(run.matches, "bank_credit_id", "settlement_id", "matched_by") == want[0] and names[done:] == ["verdicts", "matches"]
    assert pairs(run.exceptions, "source", "record_id", "exception_type") == want[1]


def test_scores_are_written_with_the_pairs(spark):
    tables = {}
    matching.fuzzy_candidates(credits(spark, ("B", "UTR1234", 1000, DAY, "INR")), settlements(spark, ("S", "UTR1235", 1001, DAY, "INR")), stage=lambda df, n: tables.setdefault(n, staged(df, n)))
    assert [r.score > 0 for r in tables["met"].collect()] == [True]


def test_sets_that_reach_no_other_credit_are_not_searched_again(spark):
    have = [(f"s{i}{k}", f"K{i}_S{k}", 1_000 + i + k, DAY, "EUR") for i in range(4) for k in range(2)]
    bank, names = [(f"b{i}", f"K{i}", 2_001 + 2 * i, DAY, "EUR") for i in range(4)], []
    solved = split.solve(credits(spark, *bank), settlements(spark, *have), listing(names), linked_only=True)
    assert sorted((r.bank_credit_id, sorted(r.components)) for r in solved.collect()) == [(f"b{i}", [f"s{i}0", f"s{i}1"]) for i in range(4)]
    assert names == ["solved", "taken", "seen"]


def test_settlements_are_not_classified_against_no_credits(spark, monkeypatch):
    bank, have, calls = credits(spark, ("B1", "U", 10, DAY, "INR"), ("B2", "V", 20, DAY, "INR")), settlements(spark, ("S1", "U", 10, DAY, "INR"), ("S2", "W", 9, DAY, "INR")), []
    one = matching.exact_matches(bank, have)
    other = consolidate.leftover_banks(bank.where("bank_credit_id = 'B2'"), have)
    leftover = consolidate.leftover_banks
    monkeypatch.setattr(consolidate, "leftover_banks", lambda *a: calls.append(1) or leftover(*a))
    assert pairs(consolidate.swept(other, one, bank, have, stage=staged), "source", "record_id") == [("bank", "B2"), ("settlement", "S2")]
    assert not calls
    assert pairs(consolidate.swept(other.limit(0), one, bank, have, stage=staged), "source", "record_id") == [("bank", "B2"), ("settlement", "S2")]
    assert len(calls) == 1


def test_may_link_asks_the_same_as_the_keys(spark):
    rows = spark.createDataFrame([(x,) for x in ("A_S1", "A_S", "_S", "A_s1", "AS", "", None, "A_S1_S2", "A__S")], "utr string")
    assert all(bool(r.may) == bool(r.keys) for r in rows.select(C.may_link(F.col("utr")).alias("may"), C.link_keys(F.col("utr")).alias("keys")).collect())
