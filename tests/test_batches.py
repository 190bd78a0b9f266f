"""Many batches in one run against a run for each; tables of a run that go with it, and are counted."""

from datetime import timedelta
from pathlib import Path

from helpers import DAY, credits, payments, settlements
from pyspark.sql import functions as F

from tallyloom.plans.batches import Batches
from tallyloom.plans.cluster import metered, staged, workspace
from tallyloom.plans.reconcile import Reconciliation

BANK = [
    ("b1", "UTR1", 1000, DAY, "EUR"), ("b2", "UTR22222222", 2000, DAY + timedelta(1), "EUR"), ("b3", "UTR3", 700, DAY, "USD"), ("b4", "K", 9100, DAY, "EUR"), ("b5", "L", 8800, DAY, "EUR"),
    ("b6", "UTR1", 1000, DAY, "EUR"), ("b7", "none", 31, DAY, "EUR"),
]
HAVE = [
    ("s1", "UTR1", 1000, DAY, "EUR"), ("s2", "UTR22222223", 2010, DAY, "EUR"), ("s3", "UTR3", 700, DAY, "EUR"), ("k1", "K_S9", 3300, DAY, "EUR"), ("k2", "K_S8", 5800, DAY, "EUR"), ("k3", "K_S7", 4600, DAY, "EUR"),
    ("k4", "K_S6", 4500, DAY, "EUR"), ("l1", "L_S1", 1100, DAY, "EUR"), ("l2", "L_S2", 2900, DAY, "EUR"), ("l3", "L_S3", 4800, DAY, "EUR"), ("s9", "UTR9", 5, DAY, "GBP"),
]


def test_batches_equal_separate_runs(spark):
    """The same records in both batches, but that the second lacks some and shares references, amounts and days with the first."""
    make = lambda rows, of, batch: of(spark, *rows).withColumn("batch", F.lit(batch))
    paid = lambda rows, batch: payments(spark, *[(f"p{s[0]}", s[2], s[4]) for s in rows]).withColumn("batch", F.lit(batch))
    parts = {1: (BANK, HAVE), 2: (BANK[:4][::-1] + BANK[5:], HAVE[1:6])}
    union = lambda of: of(1).unionByName(of(2))
    for mode in ("linked", "full"):
        run = Batches(union(lambda i: paid(parts[i][1], i)), union(lambda i: make(parts[i][1], settlements, i)), union(lambda i: make(parts[i][0], credits, i)), mode=mode)
        for i, (bank, have) in parts.items():
            alone = Reconciliation(paid(have, i).drop("batch"), settlements(spark, *have), credits(spark, *bank), mode=mode)
            for got, want in ((run.matches, alone.matches), (run.exceptions, alone.exceptions)):
                rows = sorted(map(repr, want.collect()))
                assert sorted(map(repr, got.where(F.col("batch") == str(i)).select(want.columns).collect())) == rows and len(rows) >= 2


def test_tables_of_a_workspace_go(spark):
    with workspace(spark) as folder, metered() as seen:
        table = staged(spark.range(10), "ten")
        inside = Path(folder.removeprefix("file:"))
        assert table.count() == 10 and len(list(inside.iterdir())) == 1
        staged(spark.range(0), "none")
    assert not inside.exists()
    assert [(name, n) for name, n, _ in seen] == [("ten", 10), ("none", 0)]
    staged(spark.range(1), "one")
    assert len(seen) == 2
