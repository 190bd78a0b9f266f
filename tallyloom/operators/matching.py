"""Exact and fuzzy one-to-one matching of bank credits and settlements."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ReconConfig
from ..functions import columns as C
from . import graph

Stage = Callable[[DataFrame, str], DataFrame]
KEY = ["utr", "amount", "currency", "day"]


def own(*tables: DataFrame) -> list[str]:
    """``batch``, if the records carry it: then records of different batches never meet."""
    return ["batch"] if all("batch" in t.columns for t in tables) else []


def exact_matches(credits: DataFrame, settlements: DataFrame) -> DataFrame:
    """Equal reference, amount, currency and day; the n-th credit of a key takes its n-th settlement."""
    key = [*KEY, *own(credits, settlements)]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("seq"))
    left = credits.select(*key[4:], "bank_credit_id", "utr", "amount", "currency", F.col("credited_at").alias("day"), "seq").withColumn("rn", rank).drop("seq")
    right = settlements.select(*key[4:], "settlement_id", "utr", F.col("net").alias("amount"), "currency", F.col("settled_at").alias("day"), "seq").withColumn("rn", rank).drop("seq")
    return left.join(right, [*key, "rn"]).select(
        "bank_credit_id", "settlement_id", F.lit(None).cast("array<string>").alias("components"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("matched_by"), F.lit(None).cast("string").alias("reasoning")
    )


def without_credits(credits: DataFrame, used: DataFrame) -> DataFrame:
    return credits.join(used.select("bank_credit_id"), "bank_credit_id", "left_anti")


def without_settlements(settlements: DataFrame, used: DataFrame) -> DataFrame:
    return settlements.join(used.select("settlement_id"), "settlement_id", "left_anti")


SIDES = ["currency", "bucket", "band"]
BAND = 32  # places of an amount that make a cell
HOT = 16_384  # records of one side of a cell from which on it is dealt to blocks
BUNDLE = 50_000  # records of cells that are judged in one call
AT_ONCE = 1 << 17  # pairs
LONG = 63  # letters; pairs with a longer reference are left to the last check
PAIR = "bank_credit_id string, settlement_id string, b_seq long, s_seq long, x string, y string, b_amount long, net long, b_day int, s_day int"


def _sides(credits: DataFrame, settlements: DataFrame, config: ReconConfig) -> tuple[DataFrame, DataFrame]:
    """Both sides under their cells: a settlement lies in one, a credit looks into all that it reaches. x and y are the normalised references."""
    width, more = config.date_window_days + 1, own(credits, settlements)
    day = lambda name: F.datediff(F.col(name), F.lit("1970-01-01").cast("date"))
    band = lambda place: F.floor(place / BAND).cast("long")
    left = credits.dropna(subset=[*more, "currency", "utr", "amount", "credited_at"]).select(
        *more, "currency", "bank_credit_id", C.normalised_reference(F.col("utr")).alias("x"), F.col("amount").alias("b_amount"), C.amount_tolerance(F.col("amount"), config).alias("tolerance"),
        day("credited_at").alias("b_day"), F.col("seq").alias("b_seq"), "credited_at",
    )
    # exploded as expressions: of array columns Spark would first ask whether they are empty, by computing them once more
    left = left.withColumn("band", F.explode(F.sequence(*map(band, C.place_bounds(F.col("b_amount"), config)))))
    left = left.withColumn("bucket", F.explode(C.date_buckets_around(F.col("credited_at"), config.date_window_days, width))).drop("credited_at")
    right = settlements.dropna(subset=[*more, "currency", "utr", "net", "settled_at"]).select(
        *more, "currency", "settlement_id", C.normalised_reference(F.col("utr")).alias("y"), "net", day("settled_at").alias("s_day"), F.col("seq").alias("s_seq"),
        C.date_bucket(F.col("settled_at"), width).alias("bucket"), band(F.floor(C.amount_place(F.col("net"), config))).alias("band"),
    )
    return left, right


def _cells(left: DataFrame, right: DataFrame, sides: list[str]) -> DataFrame:
    """Cells in which both sides have records: blocks of each side, and the number of bundles that all cells are dealt to."""
    one = lambda df, name: df.groupBy(*sides).agg(F.count("*").alias(name))
    both = one(left, "n_left").join(one(right, "n_right"), sides)
    blocks = lambda name: F.ceil(F.col(name) / HOT).cast("int")
    rows = F.col("n_left") * blocks("n_right") + F.col("n_right") * blocks("n_left")
    least = 3 * left.sparkSession.sparkContext.defaultParallelism
    bundles = both.agg(F.greatest(F.lit(least), F.coalesce(F.ceil(F.sum(rows) / BUNDLE), F.lit(0))).cast("int").alias("bundles"))
    return both.select(*sides, blocks("n_left").alias("lefts"), blocks("n_right").alias("rights")).crossJoin(F.broadcast(bundles))  # one row


def _letters(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, letters (a row of LONG numbers a reference), and three numbers whose bits tell the letters held once, twice and three times."""
    size = texts.str.len().to_numpy(np.int64)
    wide = int(min(max(size.max(), 1), LONG))
    rows = np.array(texts.str.slice(0, wide).tolist(), dtype=f"S{wide}").view(np.uint8).reshape(len(texts), wide)
    held = np.zeros((3, len(texts)), np.uint64)
    for k in range(wide):
        bit = np.where(k < size, np.uint64(1) << (np.maximum(rows[:, k], 48) - 48).astype(np.uint64), np.uint64(0))
        held[2] |= held[1] & bit
        held[1] |= held[0] & bit
        held[0] |= bit
    return size, np.maximum(rows, 48) - 48, held


def _places(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The first place in [low, high) at which the values, rising there, are not below the wanted one; for many at once."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        below = open_ & (values[np.minimum(middle, len(values) - 1)] < wanted)
        low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
    return low


def _edits(masks: np.ndarray, i: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """Edit distances of pairs by bits, all letters of x in one step (Myers 1999, Hyyro 2001). masks: where x holds each letter."""
    kind = masks.dtype.type
    one, last = kind(1), np.maximum(x_size - 1, 0).astype(kind)
    up, down, edits = np.full(len(i), ~kind(0)), np.zeros(len(i), kind), x_size.astype(kind)
    for k in range(int(y_size.max(initial=0))):
        same = masks[i, y[:, k]]
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up), up & across
        edits = np.where(k < y_size, edits + ((more >> last) & one) - ((less >> last) & one), edits)
        more, less, same = (more << one) | one, less << one, same | down
        up, down = less | ~(same | more), more & same
    return np.where(x_size == 0, y_size, edits.astype(np.int64))


def _judge(sides: list[str], config: ReconConfig) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Pairs of a bundle of cells that may score: near in day and amount by order, then by letters held, then by edit distance.

    The score that amount and day leave open bounds the similarity from below, and so the edits. Every bound is loose by
    rounding; what is returned is checked again.
    """
    days, width = config.date_window_days, config.date_window_days + 1
    columns = [c.split()[0] for c in PAIR.split(", ")]

    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        cell = pd.concat([left[sides], right[sides]]).groupby(sides, sort=False).ngroup().to_numpy()
        spot = cell[len(left) :] * width + right["s_day"].to_numpy() % width
        order = np.lexsort((right["net"].to_numpy(), spot))
        right, spot = right.iloc[order], spot[order]
        starts = np.searchsorted(spot, np.arange((cell.max() + 1) * width + 1))
        net, amount, tolerance, bucket = right["net"].to_numpy(), left["b_amount"].to_numpy(), left["tolerance"].to_numpy(), left["bucket"].to_numpy()
        (x_size, x, xs), (y_size, y, ys) = _letters(left["x"]), _letters(right["y"])
        masks = np.zeros((len(left), 43), np.uint32 if x.shape[1] < 32 else np.uint64)
        for k in range(x.shape[1]):
            some = np.flatnonzero(k < x_size)
            masks[some, x[some, k]] |= masks.dtype.type(1 << k)

        found = []
        for delta in range(-days, days + 1):
            day = left["b_day"].to_numpy() + delta
            who = np.flatnonzero(day // width == bucket)
            at = cell[who] * width + day[who] % width
            low = _places(net, starts[at], starts[at + 1], np.floor(amount[who] - tolerance[who]).astype(np.int64))
            n = _places(net, low, starts[at + 1], np.floor(amount[who] + tolerance[who]).astype(np.int64) + 1) - low
            who, low, n = who[n > 0], low[n > 0], n[n > 0]
            ends = np.cumsum(n)
            date_score = 1.0 if delta == 0 else 1.0 - abs(delta) / (days + 1)
            first = 0
            while first < len(who):
                until = max(first + 1, int(np.searchsorted(ends, ends[first] - n[first] + AT_ONCE, "right")))
                part = slice(first, until)
                i = np.repeat(who[part], n[part])
                j = np.arange(len(i)) + np.repeat(low[part] - (ends[part] - n[part] - (ends[first] - n[first])), n[part])
                first = until
                longer = np.maximum(x_size[i], y_size[j])
                free = longer > LONG
                most = np.floor(longer * (1 - config.least_reference_similarity) + 1e-6)
                missing = lambda a, b, i, j: (np.bitwise_count(a[i] & ~b[j]).astype(np.int64), np.bitwise_count(b[j] & ~a[i]).astype(np.int64))
                one, two = missing(xs[0], ys[0], i, j)
                keep = np.flatnonzero((np.maximum(one, two) <= most) | free)
                i, j, one, two, longer, free, most = i[keep], j[keep], one[keep], two[keep], longer[keep], free[keep], most[keep]
                if config.weight_reference > 0:
                    off = np.abs(amount[i] - net[j]) / np.maximum(tolerance[i], 1e-300)
                    open_ = min(config.ambiguous_low, config.fuzzy_accept) - np.where(off > 1, 0.0, 1.0 - off) * config.weight_amount - date_score * config.weight_date
                    most = np.minimum(most, np.maximum(np.floor(longer * (1 - open_ / config.weight_reference) + 1e-6), 0))
                for a, b in zip(xs[1:], ys[1:], strict=True):
                    more = missing(a, b, i, j)
                    one, two = one + more[0], two + more[1]
                keep = np.flatnonzero((np.maximum(one, two) <= most) | free)
                i, j, free, most = i[keep], j[keep], free[keep], most[keep]
                keep = free | (_edits(masks, i, x_size[i], y[j], np.minimum(y_size[j], LONG)) <= most)
                found.append((i[keep], j[keep]))
        i, j = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        both = pd.concat([left.iloc[i].reset_index(drop=True), right.drop(columns=sides).iloc[j].reset_index(drop=True)], axis=1)
        return both[columns]

    return judge


def similar_references(left: DataFrame, right: DataFrame, keys: list[str], config: ReconConfig = DEFAULT) -> DataFrame:
    """(*keys, x, y): of the references x and y (columns of left and right) under the same keys, a superset of the similar pairs.

    An inverted index instead of all pairs. Similarity bounds the edit distance of a pair by d, a share of the
    longer length m; so lengths differ by d at most, and a letter pair (two neighbouring letters) that no edit touches
    stands in both, moved by d places at most. An edit touches two neighbouring letter pairs; of the d edits of the shorter
    reference as many as its length lacks only insert, and touch one. Each reference is listed, for every m
    it can be part of, under its rarest letter pairs until these edits cannot touch all of them. Both sides choose in
    the same order, so the rarest one that two similar references share is in both lists. References that have too few
    letter pairs for some m meet all others of fitting length there.
    """
    allowed = lambda m: F.floor(m * (1 - config.least_reference_similarity) + 1e-9).cast("int")
    one = lambda df, name: df.where(F.col(name).isNotNull()).select(*keys, F.col(name).alias("text")).distinct().withColumn("size", F.length("text"))
    sides = one(left, "x"), one(right, "y")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.col("size") - 1, F.lit(1))), lambda i: F.struct(F.substring("text", i, F.lit(2)).alias("gram"), i.alias("at")))
    grams = F.when(F.col("size") >= 2, grams).otherwise(F.array().cast("array<struct<gram: string, at: int>>"))
    everything = sides[0].unionByName(sides[1])
    # of the 36 x 36 letter pairs of normal references, how often each occurs: one row for every task
    often = everything.select(F.explode(grams).alias("p")).groupBy("p.gram").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("gram", "n"))).alias("often"))
    often = F.broadcast(often.withColumn("every", F.lit(1)))
    lengths = everything.select(F.col("size").alias("m")).distinct()

    def listed(df: DataFrame, name: str) -> DataFrame:
        most = F.floor(F.col("size") / config.least_reference_similarity + 1e-9).cast("int")
        each = df.withColumn("m", F.explode(F.sequence("size", F.greatest("size", most)))).withColumn("d", allowed(F.col("m"))).withColumn("lack", F.col("m") - F.col("size"))
        each = each.where("lack <= d").join(lengths, "m", "left_semi").withColumn("every", F.lit(1)).join(often, "every")
        each = each.withColumn("rare", F.array_sort(F.transform(grams, lambda p: F.struct(F.col("often")[p["gram"]].alias("n"), p["gram"].alias("gram"), p["at"].alias("at")))))
        # among the first k letter pairs, how many times two neighbours can be touched together
        start = F.struct(F.lit(0).alias("pairs"), F.lit(-1).alias("last"))
        step = lambda s, at: F.when(at == s["last"] + 1, F.struct((s["pairs"] + 1).alias("pairs"), F.lit(-1).alias("last"))).otherwise(F.struct(s["pairs"].alias("pairs"), at.alias("last")))
        together = lambda k: F.aggregate(F.array_sort(F.slice(F.col("rare.at"), 1, k)), start, step, lambda s: s["pairs"])
        counts = F.when(F.size("rare") > F.col("d"), F.sequence(F.col("d") + 1, F.size("rare"))).otherwise(F.array().cast("array<int>"))
        enough = F.get(F.filter(counts, lambda k: k > F.col("d") + F.least(together(k), F.col("d") - F.col("lack"))), 0)
        entries = F.when(enough.isNotNull(), F.transform(F.slice("rare", 1, enough), lambda p: F.struct(p["gram"].alias("gram"), p["at"].alias("at"))))
        return each.select(*keys, "m", "d", F.col("text").alias(name), F.col("size").alias(f"{name}_size"), entries.alias("entries"))

    x, y = listed(sides[0], "x"), listed(sides[1], "y").drop("d")
    fits = (F.greatest("x_size", "y_size") == F.col("m")) & (F.abs(F.col("x_size") - F.col("y_size")) <= F.col("d"))
    few = x.where("entries is null").select(*keys, "m").union(y.where("entries is null").select(*keys, "m")).distinct()
    open_ = lambda df: df.join(few, [*keys, "m"], "left_semi").drop("entries")
    under = lambda df, at: df.withColumn("e", F.explode("entries")).select("*", F.col("e.gram").alias("gram"), F.col("e.at").alias(at)).drop("e", "entries")
    met = open_(x).join(open_(y), [*keys, "m"]).where(fits)
    shared = under(x, "x_at").join(under(y, "y_at"), [*keys, "m", "gram"]).where(fits & (F.abs(F.col("x_at") - F.col("y_at")) <= F.col("d")))
    return met.select(*keys, "x", "y").union(shared.select(*keys, "x", "y")).distinct()


def fuzzy_candidates(credits: DataFrame, settlements: DataFrame, config: ReconConfig = DEFAULT, stage: Stage | None = None) -> DataFrame:
    """Scored pairs with enough similarity and score.

    The range condition on day and amount becomes equal cells, so no pair is met twice and none is lost. Cells are dealt to
    bundles of bounded size, in which :func:`_judge` leaves few pairs; cells with more than ``HOT`` records of a side are cut, and
    each block of one side meets each of the other.

    stage: writes the short table of cells, and the pairs that may score, once; without it, they are computed where they are needed.
    """
    left, right = _sides(credits, settlements, config)
    sides = [*SIDES, *own(left)]
    cells = _cells(left, right, sides)
    if stage is not None:
        cells = stage(cells, "hot")
    block = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(cells, sides).withColumn("lb", block("bank_credit_id", "lefts")).withColumn("rb", every("rights"))
    right = right.join(cells, sides).withColumn("rb", block("settlement_id", "rights")).withColumn("lb", every("lefts"))
    keys = [*sides, "lb", "rb"]
    spark = left.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes are much work
    dealt = lambda df: df.withColumn("bundle", F.pmod(F.xxhash64(*keys), F.col("bundles"))).drop("lefts", "rights", "bundles").repartition(parts, "bundle").groupBy("bundle")
    met = dealt(left).cogroup(dealt(right)).applyInPandas(_judge(keys, config), PAIR)
    day = lambda name: F.date_add(F.lit("1970-01-01").cast("date"), F.col(name))
    met = met.withColumn("credited_at", day("b_day")).withColumn("settled_at", day("s_day")).drop("b_day", "s_day")
    met = met.withColumn("similarity", C.normal_similarity(F.col("x"), F.col("y"))).drop("x", "y")
    met = met.withColumn("score", C.pair_score(F.col("b_amount"), F.col("net"), F.col("credited_at"), F.col("settled_at"), F.col("similarity"), config))
    if stage is not None:
        met = stage(met, "met")  # so no distance or score is computed again in each condition on it
    scored = (
        met.where(F.abs(F.datediff("credited_at", "settled_at")) <= config.date_window_days)
        .where(F.abs(F.col("b_amount") - F.col("net")) < C.amount_tolerance(F.col("b_amount"), config))
        .where(F.col("similarity") >= config.least_reference_similarity)
        .where(F.col("score") >= min(config.ambiguous_low, config.fuzzy_accept))
    )
    reason = C.pair_reason(F.col("b_amount"), F.col("net"), F.col("credited_at"), F.col("settled_at"), F.col("similarity"))
    return scored.select("bank_credit_id", "settlement_id", "b_seq", "s_seq", "similarity", "score", reason.alias("reasoning"))


def currency_pairs(credits: DataFrame, settlements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Credits and settlements that meet on reference, amount and day in another currency only by that.

    Each side is held against the other's set of currencies per key, so shared placeholder references
    do not multiply.
    """
    key = [*own(credits, settlements), "utr", "amount", "day"]
    left = credits.select(*key[:-3], "bank_credit_id", "utr", "amount", F.col("credited_at").alias("day"), "currency", "seq")
    right = settlements.select(*key[:-3], "settlement_id", "utr", F.col("net").alias("amount"), F.col("settled_at").alias("day"), "currency", "seq")
    other = lambda df: df.groupBy(*key).agg(F.collect_set("currency").alias("seen"))
    differs = F.exists("seen", lambda c: c != F.col("currency"))
    return left.join(other(right), key).where(differs).select("bank_credit_id", "currency", "seq"), right.join(other(left), key).where(differs).select("settlement_id", "currency", "seq")


ROUNDS = 4  # of mutual best, before what is left is finished by components


def assigned(pairs: DataFrame, stage: Stage) -> DataFrame:
    """One-to-one by falling score, ties by credit and then settlement order.

    Rounds of mutual best: pairs that rank first for both of their ends are kept, whatever touches
    them goes. This gives the same pairs as one pass over all of them in order of score. Chains of falling scores would
    take a round a link; after ``ROUNDS`` what is left is cut into components, which do not touch each other, and each is
    finished by one pass in order. The number of jobs is bounded whatever the scores.

    pairs: a table that is cheap to read again; stage writes what each round leaves.
    """
    order = [F.desc("score"), "b_seq", "s_seq"]
    left, kept = pairs, None
    for _ in range(ROUNDS):
        if left.isEmpty():
            break
        ranked = left.withColumn("rb", F.row_number().over(Window.partitionBy("bank_credit_id").orderBy(*order))).withColumn(
            "rs", F.row_number().over(Window.partitionBy("settlement_id").orderBy(*order))
        )
        won = stage(ranked.where("rb = 1 and rs = 1").drop("rb", "rs"), "won")
        kept = won if kept is None else kept.unionByName(won)
        left = stage(without_settlements(without_credits(left, won), won), "unassigned")
    else:
        if not left.isEmpty():
            kept = kept.unionByName(stage(_by_components(left, stage), "won"))
    return left if kept is None else kept


def _by_components(edges: DataFrame, stage: Stage) -> DataFrame:
    """The greedy pass in each component; a task streams sorted edges and holds only the ids used in the component at hand."""
    bank, settlement = F.concat(F.lit("b"), "bank_credit_id"), F.concat(F.lit("s"), "settlement_id")
    found = graph.components(edges.select(bank.alias("a"), settlement.alias("b")), stage)
    whole = edges.withColumn("node", bank).join(found, "node").drop("node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = None, set()
        for pdf in batches:
            keep = []
            for c, b, s in zip(pdf["component"], pdf["bank_credit_id"], pdf["settlement_id"], strict=True):
                if c != now:
                    now, used = c, set()
                free = ("b", b) not in used and ("s", s) not in used
                if free:
                    used |= {("b", b), ("s", s)}
                keep.append(free)
            yield pdf.loc[keep].drop(columns="component")

    sorted_ = whole.repartition("component").sortWithinPartitions("component", F.desc("score"), "b_seq", "s_seq")
    return sorted_.mapInPandas(run, edges.schema)


def usable_bands(pairs: DataFrame, config: ReconConfig = DEFAULT) -> DataFrame:
    """Drops pairs between the ambiguous band and acceptance; they claim nothing."""
    return pairs.where((F.col("score") >= config.fuzzy_accept) | F.col("score").between(config.ambiguous_low, config.ambiguous_high) & (F.col("score") < config.ambiguous_high))


def fuzzy_matches(pairs: DataFrame, config: ReconConfig = DEFAULT) -> DataFrame:
    return pairs.where(F.col("score") >= config.fuzzy_accept).select(
        "bank_credit_id", "settlement_id", F.lit(None).cast("array<string>").alias("components"), F.round("score", 4).alias("confidence"), F.lit("fuzzy").alias("matched_by"), "reasoning"
    )


def ambiguous(pairs: DataFrame, config: ReconConfig = DEFAULT) -> DataFrame:
    return pairs.where((F.col("score") < config.fuzzy_accept) & (F.col("score") >= config.ambiguous_low) & (F.col("score") < config.ambiguous_high)).select(
        "bank_credit_id", "settlement_id", F.round("score", 4).alias("score"), "reasoning", "b_seq", "s_seq"
    )


def currency_exceptions(bank: DataFrame, settlement: DataFrame, claimed: DataFrame) -> DataFrame:
    """An exception for either side that no assigned pair claims."""
    shape = lambda df, name, source: df.dropDuplicates([name]).select(
        F.col(name).alias("record_id"), F.lit(source).alias("source"), F.lit("same reference, amount and day in another currency").alias("reason"),
        F.lit("currency_mismatch").alias("exception_type"), F.lit(2).alias("precedence"), "seq",
    )
    return shape(without_credits(bank, claimed), "bank_credit_id", "bank").unionByName(shape(without_settlements(settlement, claimed), "settlement_id", "settlement"))
