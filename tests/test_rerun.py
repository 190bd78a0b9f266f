"""Runs over again after corrections against full runs."""

import random

import pytest
from helpers import pairs
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.plans.reconcile import Reconciliation
from tallyloom.plans.rerun import Rerun
from tallyloom.plans.workload import Workload

SMALL = "/root/testdata/sf0.001"


def random_log(spark, rng, run, n):
    """Accepts of right and wrong pairs and rejects, of credits and settlements of all kinds."""
    matched = sorted((r.bank_credit_id, r.settlement_id) for r in run.matches.collect())
    open_ = sorted((r.source, r.record_id) for r in run.exceptions.collect())
    rows = []
    for i in range(n):
        kind = rng.randrange(4)
        if kind == 0:
            b, s = rng.choice(matched)[0], rng.choice(matched)[1]
            rows.append((b, "bank", "accept", s, None, 0.7, None, i))
        elif kind == 1:
            s, other = rng.choice(matched)[1], rng.choice(matched)[1]
            rows.append((s, "settlement", "accept", rng.choice(matched)[0], [s, other], 0.7, None, i))
        else:
            source, record = ("bank", rng.choice(matched)[0]) if kind == 2 else rng.choice(open_)
            rows.append((record, source, "reject", None, None, None, None, i))
    return spark.createDataFrame(rows, schemas.CORRECTIONS)


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("mode", ["linked", "full"])
def test_rerun_equals_a_full_run(spark, mode):
    rng, work = random.Random(11), Workload(spark, SMALL)
    full = lambda log: Reconciliation(work.payments(), work.settlements(), work.credits(), log, mode=mode)
    before = full(None)
    before.replies = work.replies(before.ambiguous)
    for n in (6, 25) if mode == "linked" else (20,):
        log = random_log(spark, rng, before, n)
        again, want = Rerun(before, log), full(log)
        again.replies, want.replies = work.replies(again.ambiguous), work.replies(want.ambiguous)
        assert rows_of(again.matches) == rows_of(want.matches)
        assert rows_of(again.exceptions) == rows_of(want.exceptions)
        before = again  # corrections given back and others made


def test_rerun_touches_little(spark):
    work = Workload(spark, SMALL)
    before = Reconciliation(work.payments(), work.settlements(), work.credits())
    one = before.fuzzy.orderBy("bank_credit_id").first()
    log = spark.createDataFrame([(one.bank_credit_id, "bank", "reject", None, None, None, None, 0)], schemas.CORRECTIONS)
    again = Rerun(before, log)
    assert (one.bank_credit_id,) not in pairs(again.matches, "bank_credit_id")
    touched = {(r.step, r.source): (r.n, r.n_all) for r in again.touched().collect()}
    assert len(touched) == 8 and all(n <= 12 for n, _ in touched.values()) and touched["fuzzy", "settlement"][1] > 100
    assert again.exceptions.where(F.col("record_id") == one.bank_credit_id).count() == 1
