"""Pairs that cannot score are told from few numbers of each record, before any edit distance."""

import random
from dataclasses import replace
from datetime import timedelta

import pytest
from helpers import DAY, credits, pairs, settlements

from pyspark.sql import functions as F

from tallyloom.config import DEFAULT
from tallyloom.functions import columns as C
from tallyloom.operators import matching
from tallyloom.plans.cluster import metered, staged


def records(rng, n, refs):
    return [(f"{k}", rng.choice(refs), rng.choice((100_000, 100_400, 101_000, 101_999, 70)), DAY + timedelta(rng.randint(0, 5)), rng.choice(("INR", "INR", "USD"))) for k in range(n)]


def all_pairs(b, s, config):
    """Every pair of one currency, judged as a whole."""
    c = b.select("bank_credit_id", F.col("utr").alias("b"), "amount", "credited_at", "currency")
    both = c.join(s.select("settlement_id", F.col("utr").alias("s"), "net", "settled_at", "currency"), "currency")
    both = both.withColumn("similarity", C.reference_similarity(F.col("b"), F.col("s"))).withColumn("score", C.pair_score(F.col("amount"), F.col("net"), F.col("credited_at"), F.col("settled_at"), F.col("similarity"), config))
    return pairs(both.where(F.col("similarity") >= config.least_reference_similarity).where(F.col("score") >= min(config.ambiguous_low, config.fuzzy_accept)))


@pytest.mark.parametrize("change", [{}, {"least_reference_similarity": 0.2, "ambiguous_low": 0.3}, {"weight_reference": 0.0, "weight_amount": 0.6, "weight_date": 0.4}])
def test_equal_to_all_pairs(spark, change):
    """With empty references, repeated letters, signs only, and a missing one."""
    rng, config = random.Random(5), replace(DEFAULT, **change)
    refs = ["", "-/.", None, "AAAAAAAA", "AAAAAAAB", "AAAA", "ß9", "Z0z0Z", *["".join(rng.choice("AB01-") for _ in range(rng.randint(1, 9))) for _ in range(40)]]
    b, s = credits(spark, *records(rng, 150, refs)), settlements(spark, *records(rng, 150, refs))
    want = all_pairs(b, s, config)
    assert len(want) > 100
    assert pairs(matching.fuzzy_candidates(b, s, config)) == want
    assert pairs(matching.fuzzy_candidates(b, s, config, staged)) == want


def test_few_pairs_are_judged_whole(spark):
    """Of pairs of one day and amount with references of their own, hardly any gets as far as its score."""
    rng, n = random.Random(6), 300
    refs = [f"UTR{k:07}{rng.randrange(16**6):06X}" for k in range(n)]
    rows = [(str(k), ref, 100_000, DAY, "INR") for k, ref in enumerate(refs)]
    with metered() as seen:
        found = matching.fuzzy_candidates(credits(spark, *rows), settlements(spark, *rows), stage=staged).count()
    met = {name: rows for name, rows, _ in seen}["met"]
    assert n <= found == met < 0.1 * n * n


def test_pairs_of_a_popular_day_and_price_are_judged_in_python_only(spark):
    """No join of Spark meets single pairs: of a product of rows, only the pairs that may score leave the task that judges them."""
    rng, n = random.Random(7), 200
    rows = [(str(k), f"UTR{k:07}{rng.randrange(16**6):06X}", 100_000, DAY, "INR") for k in range(n)]
    plan = matching.fuzzy_candidates(credits(spark, *rows), settlements(spark, *rows))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and not any("levenshtein" in line for line in plan.splitlines() if "Join" in line)


@pytest.mark.parametrize("most", [31, 32, 63, 64, 90])
def test_references_of_all_lengths(spark, most):
    """Around the widths of the numbers that hold a reference's letters, and beyond them; cells cut to blocks too."""
    rng = random.Random(most)
    refs = ["".join(rng.choice("ABC0") for _ in range(rng.randint(most - 3, most))) for _ in range(12)]
    refs += ["".join(c for c in w if rng.random() > 0.15) + rng.choice(["", "ZZ"]) for w in refs]
    b, s = credits(spark, *records(rng, 60, refs)), settlements(spark, *records(rng, 60, refs))
    want = all_pairs(b, s, DEFAULT)
    assert len(want) > 20 and pairs(matching.fuzzy_candidates(b, s)) == want


def test_edits_are_the_edit_distance(spark):
    """Against the library's own distance, empty references included."""
    import numpy as np
    import pandas as pd

    rng = random.Random(9)
    words = [("".join(rng.choice("AB0Z") for _ in range(rng.randint(0, 20))), "".join(rng.choice("AB0Z") for _ in range(rng.randint(0, 20)))) for _ in range(500)]
    want = [r[0] for r in spark.createDataFrame(words, "x string, y string").select(F.levenshtein("x", "y")).collect()]
    (x_size, x, _), (y_size, y, _) = (matching._letters(pd.Series(side)) for side in zip(*words, strict=True))
    masks = np.zeros((len(words), 43), np.uint32)
    for r in range(len(words)):
        for k in range(x_size[r]):
            masks[r, x[r, k]] |= np.uint32(1 << k)
    assert matching._edits(masks, np.arange(len(words)), x_size, y, y_size).tolist() == want
