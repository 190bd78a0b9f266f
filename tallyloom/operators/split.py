"""Batched payouts: one credit for several settlements, by bounded subset sums.

Credits take turns in input order: when one set of settlements is the only one that fits a credit, later
credits do without them. That order is kept without working in it. Every credit searches at once as if
nobody came before it (speculate); then those whose pool is changed by the sets found search again (replay),
until no pool changes. What is right for the first credits can never change later, so this ends with the
result of taking turns, after as many rounds as the longest chain of credits that take from each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ReconConfig
from ..functions import columns as C
from .matching import own

Stage = Callable[[DataFrame, str], DataFrame]

FEW = 10  # up to so many amounts all subsets are summed
CHUNK = 4096  # taken settlements that a list of candidates holds before it is cut
CUTS = 64  # pieces of a longer list, by the turn at which they are taken
SPREAD = 4  # tasks that pools of the same amounts go to


# ---------------------------------------------------------------- subset sums


@lru_cache(maxsize=64)
def _subsets(n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index rows of all subsets of 2..most of n items in lexicographic order (padded by n), and their sizes."""
    rows = sorted(c for k in range(2, min(n, most) + 1) for c in combinations(range(n), k))
    out = np.full((len(rows), most), n, np.int8)
    for i, c in enumerate(rows):
        out[i, : len(c)] = c
    return out, np.fromiter(map(len, rows), np.int64, len(rows))


def _by_prefixes(amounts: list[int], target: int, tolerance: int, most: int, limit: int) -> list[tuple[int, ...]]:
    """Every subset is summed; each prefix has to stay below the upper bound, which matters for negative amounts."""
    rows, sizes = _subsets(len(amounts), most)
    value, found = np.append(np.asarray(amounts, np.int64), 0), []
    for a in range(0, len(rows), 65536):
        sums = value[rows[a : a + 65536]].cumsum(axis=1)
        hit = (np.abs(sums[:, -1] - target) <= tolerance) & (sums <= target + tolerance).all(axis=1)
        found += [tuple(rows[a + i, : sizes[a + i]].tolist()) for i in np.flatnonzero(hit)[: limit - len(found)].tolist()]
        if len(found) == limit:
            break
    return found


@lru_cache(maxsize=128)
def _walk(first: int, end: int, most: int) -> tuple[list[tuple[int, ...]], np.ndarray, list[np.ndarray], list[int], list[int]]:
    """Subsets of up to ``most`` of the items from first to end, depth first.

    As tuples, as rows padded by -1, their numbers by size, and the times of a walk at which each is
    entered (before all that extend it) and left (after them).
    """
    sets = sorted(c for k in range(min(end - first, most) + 1) for c in combinations(range(first, end), k))
    rows, entered, left, open_, clock = np.full((len(sets), most), -1, np.int64), [0] * len(sets), [0] * len(sets), [], 0
    for i, c in enumerate(sets):
        rows[i, : len(c)] = c
        while open_ and sets[open_[-1]] != c[: len(sets[open_[-1]])]:
            left[open_.pop()] = clock
            clock += 1
        entered[i] = clock
        clock += 1
        open_.append(i)
    while open_:
        left[open_.pop()] = clock
        clock += 1
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return sets, rows, [np.flatnonzero(sizes == k) for k in range(most + 1)], entered, left


def _by_halves(amounts: list[int], target: int, tolerance: int, most: int, limit: int) -> list[tuple[int, ...]]:
    """Meet in the middle: each sum of the first half is completed by a range of the sorted sums of the second.

    For the depth-first order, a set of the first half alone counts at the time it is entered, and one with items
    of the second half at the time it is left, since all sets that extend it within the first half come before.
    """
    half = len(amounts) // 2
    a_sets, a_rows, a_sized, entered, left = _walk(0, half, most)
    b_sets, b_rows, b_sized, _, _ = _walk(half, len(amounts), most)
    value = np.append(np.asarray(amounts, np.int64), 0)
    a_sums, b_sums = value[a_rows].sum(axis=1), value[b_rows].sum(axis=1)
    found = [(entered[i], -1, a_sets[i]) for k in range(2, min(half, most) + 1) for i in a_sized[k][np.abs(a_sums[a_sized[k]] - target) <= tolerance].tolist()]
    ranges = []  # (time left, set of the first half, its completions from-to in an order of the second half by sum)
    for k in range(1, most + 1):
        order = b_sized[k][np.argsort(b_sums[b_sized[k]], kind="stable")]
        own = np.concatenate([a_sized[j] for j in range(max(0, 2 - k), most - k + 1)])
        low = np.searchsorted(b_sums[order], target - tolerance - a_sums[own], side="left")
        high = np.searchsorted(b_sums[order], target + tolerance - a_sums[own], side="right")
        some = np.flatnonzero(low < high)
        ranges += [(left[i], i, order[a:b]) for i, a, b in zip(own[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True)]
    ranges.sort(key=lambda r: r[0])
    n, last = 0, None
    for time, i, ends in ranges:
        if n >= limit and i != last:
            break  # all others come later
        last = i
        first = np.partition(ends, limit - 1)[:limit] if len(ends) > limit else ends
        found += [(time, b, a_sets[i] + b_sets[b]) for b in first.tolist()]
        n += len(first)
    return [c for _, _, c in sorted(found)[:limit]]


def subset_sums(amounts: list[int], target: int, config: ReconConfig = DEFAULT, limit: int | None = None) -> list[tuple[int, ...]]:
    """The first ``limit`` subsets (default: as many as are listed) whose sum is within tolerance of the target.

    Order is depth first. A partial sum above the upper bound ends its branch, which only matters for
    negative amounts: there every prefix is tested.
    """
    limit = limit or config.split_listed
    tolerance = int(max(abs(target) * config.amount_tolerance_pct, config.amount_tolerance_abs) + 1e-9)
    if len(amounts) < 2:
        return []
    up = sorted(amounts)
    if up[0] >= 0 and (sum(up[-config.split_combo :]) < target - tolerance or up[0] + up[1] > target + tolerance):
        return []
    search = _by_prefixes if up[0] < 0 or len(amounts) <= FEW else _by_halves
    return search(amounts, target, tolerance, config.split_combo, limit)


# ---------------------------------------------------------------- candidates


def linked(credits: DataFrame, settlements: DataFrame, config: ReconConfig = DEFAULT) -> DataFrame:
    """Pairs whose settlement reference is ``<credit reference>_S...``, same currency, within the window."""
    right = settlements.where(C.may_link(F.col("utr"))).select("settlement_id", "net", "settled_at", "currency", F.col("seq").alias("s_seq"), F.explode(F.array_distinct(C.link_keys(F.col("utr")))).alias("utr"))
    pairs = credits.select("bank_credit_id", "utr", "amount", "credited_at", "currency", F.col("seq").alias("b_seq")).join(right, ["utr", "currency"])
    pairs = pairs.where(F.abs(F.datediff("credited_at", "settled_at")) <= config.split_window_days)
    many = pairs.groupBy("bank_credit_id").agg(F.count("*").alias("n_linked")).where("n_linked >= 2")
    return pairs.join(many, "bank_credit_id")


def window_candidates(credits: DataFrame, settlements: DataFrame, config: ReconConfig = DEFAULT) -> DataFrame:
    """Interval join: same currency, at most ``split_window_days`` apart; one row per credit with its number of candidates."""
    width = config.split_window_days + 1
    left = credits.select("bank_credit_id", "currency", "credited_at", C.date_bucket(F.col("credited_at"), width).alias("bucket"))
    left = left.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    right = settlements.groupBy("currency", "settled_at").agg(F.count("*").alias("n")).withColumn("bucket", C.date_bucket(F.col("settled_at"), width))
    near = left.join(right, ["currency", "bucket"]).where(F.abs(F.datediff("credited_at", "settled_at")) <= config.split_window_days)
    return near.groupBy("bank_credit_id").agg(F.sum("n").alias("n_candidates"))


def pools(pairs: DataFrame, config: ReconConfig = DEFAULT) -> DataFrame:
    """The first ``split_pool`` candidates of each credit, in input order."""
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("bank_credit_id").orderBy("s_seq"))).where(F.col("place") <= config.split_pool)


def _lists(settlements: DataFrame, centres: DataFrame, key: list[str], config: ReconConfig) -> tuple[DataFrame, DataFrame]:
    """(cuts, lists): for each key and day of a credit, what its pool is drawn from, whatever its turn.

    settlements: s_seq, settlement_id, net, the key, settled_at, and taken_at, the turn (place of the credit) at
    which a settlement is taken, or null. A pool is the first ``split_pool`` by s_seq of those not taken before the
    credit's turn. Among the settlements never taken the first ``split_pool`` suffice for every credit (Spark limits
    such groups before the shuffle), and a taken one behind that many of them is in no pool. Without a reference in the
    key both hold for each day of settlement already, before it is spread over the days around. Taken ones are cut by
    turn where they are many: a list holds those of its own turns, and of all later ones the first ``split_pool``; so
    no list grows with a popular day.
    """
    width, at = config.split_window_days, [*key, "credited_at"]
    bucket = lambda day: C.date_bucket(day, 2 * width + 1 if "utr" in key else 1)  # noqa: E731  a window touches two wide ones; a currency alone has too many rows for them
    around = F.sequence(bucket(F.date_sub("settled_at", width)), bucket(F.date_add("settled_at", width)))

    def near(some: DataFrame) -> DataFrame:
        spread = some.withColumn("bucket", F.explode(around)).join(centres.withColumn("bucket", bucket(F.col("credited_at"))), [*key, "bucket"])
        return spread.where(F.abs(F.datediff("credited_at", "settled_at")) <= width).drop("bucket")

    def first_of(some: DataFrame, by: list[str]) -> DataFrame:
        return some.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("s_seq"))).where(F.col("n") <= config.split_pool).drop("n")

    def before_last(some: DataFrame, free: DataFrame, by: list[str]) -> DataFrame:
        last = free.groupBy(*by).agg(F.when(F.count("*") >= config.split_pool, F.max("s_seq")).alias("last"))
        return some.join(last, by, "left").where("last is null or s_seq < last").drop("last")

    never, taken = settlements.where("taken_at is null"), settlements.where("taken_at is not null")
    if "utr" in key:
        never, taken = near(never), near(taken)
    else:
        day = [*key, "settled_at"]
        never = first_of(never, day)
        taken = near(before_last(taken, never, day))
        never = first_of(near(never), at)
        taken = before_last(taken, never, at)
    cut = F.when(F.count("taken_at") > CHUNK, F.percentile_approx("taken_at", [k / CUTS for k in range(1, CUTS)], 10_000)).otherwise(F.array().cast("array<long>"))
    cuts = taken.groupBy(*at).agg(cut.alias("cuts"))
    never = never.withColumn("part", F.lit(CUTS))
    taken = taken.join(cuts, at).withColumn("part", _turn(F.col("taken_at"))).drop("cuts")
    columns = [*at, "part", "s_seq", "settlement_id", "net", "taken_at"]
    heads = first_of(never.select(*columns).unionByName(taken.select(*columns)), [*at, "part"])
    # the first of all later parts, for the parts that some credit may ask for
    parts = centres.join(cuts, at, "left").withColumn("own", F.explode(F.sequence(F.lit(0), F.coalesce(F.size("cuts"), F.lit(0))))).drop("cuts")
    after = heads.join(parts, at).where("part > own").drop("part").withColumnRenamed("own", "part")
    both = taken.select(*columns).unionByName(first_of(after, [*at, "part"]).select(*columns))
    one = F.struct("s_seq", "settlement_id", "net", "taken_at")
    return cuts, both.groupBy(*at, "part").agg(F.array_sort(F.collect_list(one)).alias("have"))


def _turn(seq: Column) -> Column:
    """The part of a list that a turn belongs to: the number of cuts before it."""
    return F.size(F.filter("cuts", lambda x: x < seq))


def _pools(credits: DataFrame, settlements: DataFrame, key: list[str], config: ReconConfig, name: str, done: Column | None = None) -> DataFrame:
    """The credits with the first settlements that each finds at its turn, as column ``name``; null where there are not two, or ``done`` holds."""
    at = [*key, "credited_at"]
    cuts, lists = _lists(settlements, credits.select(*at).distinct(), key, config)
    part = F.coalesce(_turn(F.col("b_seq")), F.lit(0))
    if done is not None:  # parts that no list has, many, so that these rows are not dealt to one task
        part = F.when(done, -1 - F.abs(F.hash("bank_credit_id") % 1024)).otherwise(part)
    turn = credits.join(cuts, at, "left").withColumn("part", part).drop("cuts")
    free = F.slice(F.filter("list", lambda x: x["taken_at"].isNull() | (x["taken_at"] >= F.col("b_seq"))), 1, config.split_pool)
    found = turn.join(lists.withColumnRenamed("have", "list"), [*at, "part"], "left").withColumn(name, F.when(F.size(free) >= 2, free))
    return found.select(*credits.columns, name)


def candidate_pools(credits: DataFrame, settlements: DataFrame, taken: DataFrame | None = None, config: ReconConfig = DEFAULT, linked_only: bool = False) -> DataFrame:
    """(bank_credit_id, b_seq, amount, linked, settlement_ids, nets): the pool of each credit; without two candidates it is empty.

    taken: (settlement_id, taken_at), or nothing taken; settlements may have the column already. Settlements that carry the credit's reference come before all
    others if there are two; then the pool is ``linked``.
    """
    more = own(credits, settlements)
    bank = credits.select(*more, "bank_credit_id", "utr", "amount", "credited_at", "currency", F.col("seq").alias("b_seq"))
    if "taken_at" in settlements.columns:
        have = settlements
    else:
        have = settlements.withColumn("taken_at", F.lit(None).cast("long")) if taken is None else settlements.join(taken, "settlement_id", "left")
    have = have.select(*more, "settlement_id", "net", "settled_at", "currency", "utr", F.col("seq").alias("s_seq"), "taken_at")
    by_link = have.where(C.may_link(F.col("utr"))).withColumn("utr", F.explode(F.array_distinct(C.link_keys(F.col("utr")))))
    found = _pools(bank, by_link, [*more, "currency", "utr"], config, "have").withColumn("linked", F.col("have").isNotNull())
    if not linked_only:
        found = _pools(found, have.drop("utr"), [*more, "currency"], config, "any", F.col("linked")).withColumn("have", F.coalesce("have", "any"))
    empty = lambda name, kind: F.coalesce(F.col(f"have.{name}"), F.array().cast(f"array<{kind}>"))
    return found.select("bank_credit_id", "b_seq", "amount", "linked", empty("settlement_id", "string").alias("settlement_ids"), empty("net", "bigint").alias("nets"))


# ---------------------------------------------------------------- speculate and replay


def _searched(pools: DataFrame, config: ReconConfig) -> DataFrame:
    """The pools with what the subset search finds in them.

    Pools are dealt by what is asked (the amounts), whatever day they are of, and each question is searched once in a
    task. One that is asked very often goes to ``SPREAD`` tasks.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, found = None, []
        for pdf in batches:
            out = []
            for target, names, nets in zip(pdf["amount"], pdf["settlement_ids"], pdf["nets"], strict=True):
                question = int(target), list(map(int, nets))
                if question != asked:
                    asked, found = question, subset_sums(question[1], question[0], config)
                text = " | ".join("+".join(sorted(names[i] for i in c)) for c in found)
                out.append((len(found), [names[i] for i in found[0]] if found else None, text, len(found) == 1))
            yield pd.concat([pdf, pd.DataFrame(out, columns=["n_solutions", "components", "listed", "consumed"], index=pdf.index)], axis=1)

    spark = pools.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # else few bytes become one task
    schema = "bank_credit_id string, b_seq long, amount long, linked boolean, settlement_ids array<string>, nets array<long>, n_solutions int, components array<string>, listed string, consumed boolean"
    dealt = pools.withColumn("question", F.xxhash64("amount", "nets")).repartition(parts, "question", F.pmod(F.hash("bank_credit_id"), F.lit(SPREAD)))
    return dealt.sortWithinPartitions("question").drop("question").mapInPandas(search, schema)


def taken_by(solved: DataFrame) -> DataFrame:
    """(settlement_id, taken_at): the turn of the first credit that takes a settlement."""
    return solved.where("consumed").select(F.explode("components").alias("settlement_id"), "b_seq").groupBy("settlement_id").agg(F.min("b_seq").alias("taken_at"))


def solve(
    credits: DataFrame, settlements: DataFrame, stage: Stage, config: ReconConfig = DEFAULT, linked_only: bool = False,
    before: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Subset search of all credits, taking turns.

    linked_only: only settlements that carry a credit's reference are tried; else any settlement of the window.
    before: (an earlier result, credits that came or went since, settlements that did); only what these change is searched again.
    Columns: bank_credit_id, b_seq, amount, linked, settlement_ids and nets (the pool at the credit's turn; empty without
    two candidates), n_solutions (up to the number listed), components of the first, listed, consumed.
    """
    width, more = config.split_window_days, own(credits, settlements)
    day = ["settlement_id", *more, "currency", "settled_at"]
    by_link = lambda df: df.where(C.may_link(F.col("utr"))).select(*day, F.explode(F.array_distinct(C.link_keys(F.col("utr")))).alias("utr"))
    kinds = [by_link] if linked_only else [by_link, lambda df: df.select(*day)]
    places = [of(settlements) for of in kinds]

    def reached(changed: DataFrame, place: DataFrame) -> DataFrame:
        """Credits of the days around a changed settlement (of its reference, if the place has one); those with earlier turns see no change."""
        spot = [c for c in place.columns if c != "settlement_id"]
        spots = changed.join(place, "settlement_id").groupBy(*spot).agg(F.min("least").alias("least"))
        days = F.explode(F.sequence(F.date_sub("settled_at", width), F.date_add("settled_at", width))).alias("credited_at")
        at = ["credited_at" if c == "settled_at" else c for c in spot]
        spots = spots.withColumn("credited_at", days).groupBy(*at).agg(F.min("least").alias("least"))
        return credits.join(spots, at).where("seq > least").select(credits.columns)

    if before is None:
        solved, taken = stage(_searched(candidate_pools(credits, settlements, None, config, linked_only).where("size(nets) > 0"), config), "solved"), None
        moved = came = None
    else:
        old, came, moved = before
        taken = taken_by(old)
        solved = old.join(came.select("bank_credit_id"), "bank_credit_id", "left_anti")
        places = [place.unionByName(of(moved)).distinct() for place, of in zip(places, kinds, strict=True)]
        came = credits.join(came.select("bank_credit_id"), "bank_credit_id", "left_semi")
    while True:
        now = stage(taken_by(solved), "taken")
        if taken is None:
            changed = now.withColumnRenamed("taken_at", "least")
        else:
            both = now.join(taken.withColumnRenamed("taken_at", "before"), "settlement_id", "full").where(~F.col("taken_at").eqNullSafe(F.col("before")))
            changed = both.select("settlement_id", F.least("taken_at", "before").alias("least"))
        if moved is not None:
            changed = changed.unionByName(moved.select("settlement_id", F.lit(-(1 << 62)).alias("least")))
        taken = now
        seen = reached(changed, places[0])
        if not linked_only:  # a pool of linked settlements stays one as long as none that carries the reference changes
            others = reached(changed, places[1]).join(solved.where("linked").select("bank_credit_id"), "bank_credit_id", "left_anti")
            seen = seen.unionByName(others.select(seen.columns)).dropDuplicates(["bank_credit_id"])
        if came is not None:
            seen = seen.unionByName(came).dropDuplicates(["bank_credit_id"])
        came = moved = None
        seen = stage(seen, "seen")  # often none, and then nothing else is read
        if seen.isEmpty():
            return solved
        old = solved.select("bank_credit_id", F.col("settlement_ids").alias("old"))
        marked = stage(settlements.join(taken, "settlement_id", "left"), "marked")  # read for each kind of list
        pools = candidate_pools(seen, marked, None, config, linked_only).join(old, "bank_credit_id", "left")
        other = pools.where("settlement_ids <> coalesce(old, cast(array() as array<string>))").drop("old")
        stale = stage(_searched(other, config), "stale")
        if stale.isEmpty():
            return solved
        solved = stage(solved.join(stale, "bank_credit_id", "left_anti").unionByName(stale), "solved")


def split_matches(solved: DataFrame) -> DataFrame:
    reason = F.concat(F.size("components").cast("string"), F.lit(" settlements make up "), C.money_text(F.col("amount")))
    return solved.where("n_solutions = 1").select(
        "bank_credit_id", F.col("components")[0].alias("settlement_id"), "components", F.lit(1.0).alias("confidence"), F.lit("split").alias("matched_by"), reason.alias("reasoning")
    )


def split_exceptions(solved: DataFrame) -> DataFrame:
    return solved.where("n_solutions > 1").select(
        F.col("bank_credit_id").alias("record_id"), F.lit("bank").alias("source"), F.concat(F.lit("several sets of settlements fit: "), F.col("listed")).alias("reason"),
        F.lit("batched_payout").alias("exception_type"), F.lit(3).alias("precedence"), F.col("b_seq").alias("seq"),
    )


def part_ids(matches: DataFrame) -> DataFrame:
    """Settlement ids of matches, components included."""
    return matches.select(F.explode(F.array_distinct(F.concat(F.array("settlement_id"), F.coalesce("components", F.array().cast("array<string>"))))).alias("settlement_id")).distinct()
