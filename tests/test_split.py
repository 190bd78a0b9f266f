"""Batched payouts: the rounds of speculation against credits that take turns one after another."""

import random
from datetime import timedelta
from itertools import combinations

import pytest
from helpers import DAY, credits, settlements

from tallyloom.config import DEFAULT
from tallyloom.operators import split
from tallyloom.plans.cluster import staged


def in_turn(bank, have, linked_only):
    """(credit, solutions up to the listed number, first set, listed) of every credit with two candidates at its turn."""
    taken, out = set(), set()
    for name, utr, amount, day, currency in bank:
        near = [x for x in have if x[0] not in taken and x[4] == currency and abs((x[3] - day).days) <= DEFAULT.split_window_days]
        linked = [x for x in near if x[1].startswith(f"{utr}_S")]
        pool = (linked if linked_only or len(linked) >= 2 else near)[: DEFAULT.split_pool]
        if len(pool) < 2:
            continue
        found = split.subset_sums([x[2] for x in pool], amount)
        ids = [[pool[i][0] for i in c] for c in found]
        if len(ids) == 1:
            taken.update(ids[0])
        out.add((name, len(ids), tuple(ids[0]) if ids else None, " | ".join("+".join(sorted(c)) for c in ids)))
    return out


def rows_of(solved):
    return {(r.bank_credit_id, r.n_solutions, tuple(r.components) if r.components else None, r.listed) for r in solved.where("size(nets) > 0").collect()}


def popular(rng, n, days):
    """Batches on few days: credits are sums of settlements, many of which several credits could take."""
    have, bank = [], []
    for g in range(n // 4):
        size, currency = rng.randrange(2, 5), rng.choice(["EUR", "EUR", "USD"])
        for i in range(size):
            utr = f"K{g}_S{i}" if rng.random() < 0.7 else f"U{g}{i}"
            have.append((f"s{g:03d}{i}", utr, int(10 ** rng.uniform(3, 9)), DAY + timedelta(rng.randrange(days)), currency))
        group = have[-size:]
        for i in range(rng.randrange(3)):
            part = group if rng.random() < 0.6 else rng.sample(group, 2)
            bank.append((f"b{g:03d}{i}", f"K{g}" if rng.random() < 0.7 else f"X{g}", sum(x[2] for x in part), group[0][3] + timedelta(rng.randrange(3)), currency))
    rng.shuffle(bank)
    rng.shuffle(have)
    return bank, have


@pytest.mark.parametrize("linked_only", [True, False])
@pytest.mark.parametrize("chunk, seed, days", [(split.CHUNK, 2, 12), (2, 1, 1)])
def test_rounds_equal_turns(spark, monkeypatch, chunk, seed, days, linked_only):
    """On one popular day with small chunks, every list of candidates is cut by turn."""
    monkeypatch.setattr(split, "CHUNK", chunk)
    monkeypatch.setattr(split, "CUTS", 5)
    bank, have = popular(random.Random(seed), 90, days)
    want = in_turn(bank, have, linked_only)
    assert rows_of(split.solve(credits(spark, *bank), settlements(spark, *have), staged, linked_only=linked_only)) == want
    assert sum(n == 1 for _, n, _, _ in want) > 2  # some take what others could


def test_chain_of_credits_that_take_from_each_other(spark):
    """Each credit fits one pair only because the one before took part of another pair."""
    n = 9
    have = [(f"s{i:02d}", "u", 1000 * 3**i, DAY, "EUR") for i in range(n)]
    bank = [(f"b{i:02d}", "x", 1000 * (3**i + 3 ** (i + 1)), DAY, "EUR") for i in range(n - 1)]
    solved = rows_of(split.solve(credits(spark, *bank), settlements(spark, *have), staged))
    assert solved == in_turn(bank, have, False)


def test_one_reference_for_everything(spark):
    """A placeholder reference shared by all rows: pools stay short and turns are kept."""
    rng = random.Random(5)
    have = [(f"s{i:03d}", f"NA_S{i}", rng.randrange(1_000, 9_000_000), DAY, "EUR") for i in range(120)]
    bank = [(f"b{i:03d}", "NA", have[2 * i][2] + have[2 * i + 1][2], DAY, "EUR") for i in range(40)]
    pools = split.candidate_pools(credits(spark, *bank), settlements(spark, *have), linked_only=True)
    assert {len(r.settlement_ids) for r in pools.collect()} == {DEFAULT.split_pool}
    assert rows_of(split.solve(credits(spark, *bank), settlements(spark, *have), staged, linked_only=True)) == in_turn(bank, have, True)


def test_meeting_in_the_middle_equals_all_subsets():
    rng = random.Random(6)
    hits = 0
    for _ in range(600):
        amounts = [rng.randrange(rng.choice([2, 9, 90, 900])) for _ in range(rng.randrange(2, 14))]
        most, limit, tolerance = rng.choice([2, 3, 6]), rng.choice([1, 2, 5, 50]), rng.choice([0, 3])
        target = sum(rng.sample(amounts, min(len(amounts), rng.randrange(2, 7)))) + rng.randrange(-2, 3)
        want = [c for c in sorted(c for k in range(2, most + 1) for c in combinations(range(len(amounts)), k)) if abs(sum(amounts[i] for i in c) - target) <= tolerance]
        assert split._by_halves(amounts, target, tolerance, most, limit) == want[:limit]
        hits += len(want) > limit
    assert hits > 100


def test_a_pool_of_one_amount_lists_the_first_sets():
    assert split.subset_sums([700] * 25, 1400) == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5)]
    assert split.subset_sums([100] * 25, 600, limit=2) == [(0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 4, 6)]


def test_only_linked_credits_are_looked_at_again(spark, monkeypatch):
    """Sets found for a reference do not send the other credits of the days around into another search."""
    have = [(f"s{i:02d}{k}", f"K{i}_S{k}", 1_000 + i + k, DAY, "EUR") for i in range(20) for k in range(2)]
    bank = [(f"b{i:02d}", f"K{i}", 2_001 + 2 * i, DAY, "EUR") for i in range(20)] + [("again", "K3", 2_007, DAY, "EUR")]
    seen, pools = [], split.candidate_pools
    monkeypatch.setattr(split, "candidate_pools", lambda credits, *rest: seen.append(credits.count()) or pools(credits, *rest))
    assert rows_of(split.solve(credits(spark, *bank), settlements(spark, *have), staged, linked_only=True)) == in_turn(bank, have, True)
    assert seen[:2] == [21, 1]


def test_equal_pools_are_searched_once_in_a_task(spark, monkeypatch):
    """Credits of one day and amount ask the same; one that finds a linked pool leaves the others alone."""
    have = [(f"s{i:02d}", f"U{i}", 1_000 + 7 * i * i, DAY, "EUR") for i in range(30)] + [(f"k{i}", f"K_S{i}", 400 + i, DAY, "EUR") for i in range(2)]
    bank = [("linked", "K", 801, DAY, "EUR")] + [(f"b{i:02d}", f"X{i}", 90_000_000, DAY, "EUR") for i in range(40)]
    pools = split.candidate_pools(credits(spark, *bank), settlements(spark, *have))
    assert {r.bank_credit_id for r in pools.where("linked").collect()} == {"linked"} and pools.where("size(nets) = 25").count() == 40
    asked, search = spark.sparkContext.accumulator(0), split.subset_sums

    def counted(*args):
        asked.add(1)
        return search(*args)

    monkeypatch.setattr(split, "subset_sums", counted)
    assert split._searched(pools, DEFAULT).count() == 41
    assert 1 < asked.value <= 1 + split.SPREAD


def test_taken_settlements_behind_a_full_pool_are_not_listed(spark):
    """25 settlements that nobody takes come first on each day, so those taken behind them are in no list."""
    have = [(f"a{i:02d}", "u", 100 + i, DAY, "EUR") for i in range(25)] + [(f"t{i:02d}", "u", 900 + i, DAY, "EUR") for i in range(50)]
    bank = [("b0", "x", 5, DAY, "EUR"), ("b1", "y", 6, DAY + timedelta(2), "EUR")]
    own = settlements(spark, *have).selectExpr("settlement_id", "net", "settled_at", "currency", "seq as s_seq", "case when settlement_id like 't%' then 1000L end as taken_at")
    at = credits(spark, *bank).select("currency", "credited_at")
    lists = [r.have for r in split._lists(own, at, ["currency"], DEFAULT)[1].collect()]
    assert len(lists) == 2 and all([x.settlement_id for x in have_] == [f"a{i:02d}" for i in range(25)] for have_ in lists)
