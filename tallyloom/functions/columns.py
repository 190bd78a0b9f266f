"""Money text, references, scores and blocking keys as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, ReconConfig


def money_text(cents: Column) -> Column:
    """Cents as a plain decimal without trailing zeros: 1250 -> 12.5."""
    whole, rest = F.abs(cents).cast("long"), F.abs(cents) % 100
    digits = F.when(rest == 0, "").when(rest % 10 == 0, F.concat(F.lit("."), (rest / 10).cast("int").cast("string"))).otherwise(
        F.concat(F.lit("."), F.lpad(rest.cast("string"), 2, "0"))
    )
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(whole / 100).cast("string"), digits)


def normalised_reference(ref: Column) -> Column:
    """Upper case, only A-Z and 0-9."""
    return F.regexp_replace(F.upper(ref), "[^A-Z0-9]", "")


def reference_similarity(a: Column, b: Column) -> Column:
    """1 if equal after normalisation, 0 if one is empty, else 1 - edit distance / longer length."""
    return normal_similarity(normalised_reference(a), normalised_reference(b))


def normal_similarity(x: Column, y: Column) -> Column:
    """:func:`reference_similarity` of references that are normalised already."""
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def amount_tolerance(amount: Column, config: ReconConfig = DEFAULT) -> Column:
    return F.greatest(F.abs(amount) * config.amount_tolerance_pct, F.lit(float(config.amount_tolerance_abs)))


def amount_score(credit: Column, net: Column, config: ReconConfig = DEFAULT) -> Column:
    diff, tolerance = F.abs(credit - net), amount_tolerance(credit, config)
    return F.when(diff == 0, 1.0).when(diff > tolerance, 0.0).otherwise(1.0 - diff / tolerance)


def date_score(a: Column, b: Column, config: ReconConfig = DEFAULT) -> Column:
    days = F.abs(F.datediff(a, b))
    return F.when(days == 0, 1.0).when(days > config.date_window_days, 0.0).otherwise(1.0 - days / (config.date_window_days + 1))


def pair_score(credit: Column, net: Column, credited_at: Column, settled_at: Column, similarity: Column, config: ReconConfig = DEFAULT) -> Column:
    """Weighted score; 0 if the amount or the date score is 0. Currency is the join's business."""
    amount, date = amount_score(credit, net, config), date_score(credited_at, settled_at, config)
    total = amount * config.weight_amount + date * config.weight_date + similarity * config.weight_reference
    return F.when((amount == 0) | (date == 0), 0.0).otherwise(total)


def pair_reason(credit: Column, net: Column, credited_at: Column, settled_at: Column, similarity: Column) -> Column:
    """What is not perfect about a pair, joined by '; '."""
    days = F.datediff(credited_at, settled_at)
    return F.concat_ws(
        "; ",
        F.when(credit != net, F.concat(F.lit("amount off by "), money_text(F.abs(credit - net)))),
        F.when(days != 0, F.concat(F.lit("dates "), F.abs(days).cast("string"), F.lit(" day(s) apart"))),
        F.when(similarity < 1, F.concat(F.lit("reference similarity "), F.round(similarity, 2).cast("string"))),
    )


def date_bucket(day: Column, width: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / width).cast("long")


def date_buckets_around(day: Column, days: int, width: int) -> Column:
    """Buckets that hold a day at most ``days`` away."""
    return F.sequence(date_bucket(F.date_sub(day, days), width), date_bucket(F.date_add(day, days), width))


def amount_place(amount: Column, config: ReconConfig = DEFAULT) -> Column:
    """A monotone map under which amounts within tolerance of a credit lie at most 1 apart.

    Logarithmic in steps of the relative tolerance beyond the amount where it overtakes the absolute
    one, linear below; odd for negative amounts.
    """
    step = -math.log(1 - config.amount_tolerance_pct)
    knee = config.amount_tolerance_abs / config.amount_tolerance_pct
    x = F.abs(amount).cast("double")
    place = F.when(x < knee, x / (knee * step)).otherwise((F.log(F.greatest(x, F.lit(1.0)) / knee) + 1.0) / step)
    return F.when(amount < 0, -place).otherwise(place)


def place_bounds(amount: Column, config: ReconConfig = DEFAULT) -> tuple[Column, Column]:
    """The first and the last bucket that can hold an amount within tolerance (inclusive)."""
    at, slack = amount_place(amount, config), 1 + 1e-9
    return F.floor(at - slack).cast("long"), F.floor(at + slack).cast("long")


def places_around(amount: Column, config: ReconConfig = DEFAULT) -> Column:
    """Buckets that can hold an amount within tolerance (inclusive)."""
    return F.sequence(*place_bounds(amount, config))


def may_link(utr: Column) -> Column:
    """Whether :func:`link_keys` gives any; far cheaper, so it is asked first."""
    return utr.contains("_S")


def link_keys(utr: Column) -> Column:
    """Every text before an ``_S`` of a settlement reference: the credit references it may be a part of."""
    cut = F.split(utr, "_S")
    return F.transform(F.slice(F.transform(cut, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), 1, F.size(cut) - 1), lambda p: F.array_join(F.slice(cut, 1, p["i"] + 1), "_S"))
