"""A whole reconciliation: the passes in order, each on what the one before left."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ReconConfig
from ..operators import consolidate, corrections, integrity, matching, split, verdicts
from .cluster import staged


class Reconciliation:
    """Passes as tables; each is computed when asked for, and written once if later ones read it again.

    mode: ``linked`` (only settlements that carry a credit's reference may be parts of it) or ``full`` (any
    settlement of the window may be a part).
    """

    def __init__(
        self, payments: DataFrame, settlements: DataFrame, credits: DataFrame, log: DataFrame | None = None, replies: DataFrame | None = None,
        config: ReconConfig = DEFAULT, mode: str = "linked",
    ):
        self.payments, self.settlements, self.credits = payments, settlements, credits
        self.log, self.replies, self.config, self.mode = log, replies, config, mode

    @cached_property
    def flagged(self) -> DataFrame:
        return staged(integrity.integrity_exceptions(self.payments, self.settlements, self.config), "integrity")

    @cached_property
    def clean(self) -> DataFrame:
        return staged(integrity.clean(self.settlements, self.flagged), "clean")

    @cached_property
    def pools(self) -> tuple[DataFrame, DataFrame]:
        return (self.credits, self.clean) if self.log is None else corrections.pools_after(self.credits, self.clean, self.log)

    @cached_property
    def exact(self) -> DataFrame:
        return staged(matching.exact_matches(*self.pools), "exact")

    @cached_property
    def after_exact(self) -> tuple[DataFrame, DataFrame]:
        bank, settlement = self.pools
        return staged(matching.without_credits(bank, self.exact), "bank"), staged(matching.without_settlements(settlement, self.exact), "settlement")

    @cached_property
    def candidates(self) -> DataFrame:
        return matching.fuzzy_candidates(*self.after_exact, self.config, staged)

    @cached_property
    def edges(self) -> DataFrame:
        return staged(matching.usable_bands(self.candidates, self.config), "edges")

    @cached_property
    def assigned(self) -> DataFrame:
        return matching.assigned(self.edges, staged)

    @cached_property
    def fuzzy(self) -> DataFrame:
        return matching.fuzzy_matches(self.assigned, self.config)

    @cached_property
    def ambiguous(self) -> DataFrame:
        return matching.ambiguous(self.assigned, self.config)

    @cached_property
    def other_currency(self) -> DataFrame:
        return staged(matching.currency_exceptions(*matching.currency_pairs(*self.after_exact), self.assigned), "currency")

    @cached_property
    def after_fuzzy(self) -> tuple[DataFrame, DataFrame]:
        of = lambda source, name: self.other_currency.where(F.col("source") == source).select(F.col("record_id").alias(name))
        bank, settlement = self.after_exact
        bank = matching.without_credits(matching.without_credits(bank, self.assigned), of("bank", "bank_credit_id"))
        settlement = matching.without_settlements(matching.without_settlements(settlement, self.assigned), of("settlement", "settlement_id"))
        return staged(bank, "bank"), staged(settlement, "settlement")

    @cached_property
    def solved(self) -> DataFrame:
        return split.solve(*self.after_fuzzy, staged, self.config, linked_only=self.mode == "linked")

    @cached_property
    def split(self) -> DataFrame:
        return split.split_matches(self.solved)

    @cached_property
    def after_split(self) -> tuple[DataFrame, DataFrame]:
        bank, settlement = self.after_fuzzy
        return matching.without_credits(bank, self.split), matching.without_settlements(settlement, split.part_ids(self.split))

    @cached_property
    def left(self) -> DataFrame:
        return staged(consolidate.leftover_banks(self.after_split[0], self.settlements), "left")

    @cached_property
    def verdicts(self) -> tuple[DataFrame, DataFrame]:
        replies = self.replies
        if replies is None:
            said = self.ambiguous.where("false").select("bank_credit_id", "settlement_id", *[F.lit(None).cast("string").alias(c) for c in ("verdict", "reasoning", "error")])
        else:
            said = staged(verdicts.parsed(replies), "verdicts")  # read by both routes; parsed in them it would outgrow generated code
        return verdicts.routed(self.ambiguous, said)

    @cached_property
    def matches(self) -> DataFrame:
        human = [] if self.log is None else [corrections.human_matches(self.log)]
        return staged(consolidate.all_matches([*human, self.exact, self.fuzzy, self.split, self.verdicts[0]]), "matches")

    @cached_property
    def exceptions(self) -> DataFrame:
        rejects = [] if self.log is None else [corrections.reject_exceptions(self.log)]
        found = consolidate.all_exceptions(
            [self.flagged, self.other_currency, split.split_exceptions(self.solved), self.verdicts[1], self.left, consolidate.leftover_settlements(self.after_split[1]), *rejects], self.matches
        )
        return staged(consolidate.swept(staged(found, "exceptions"), self.matches, self.credits, self.settlements, self.config, staged), "swept")


class Answered(Reconciliation):
    """A run with verdicts on top of ``run`` without them: all passes before the verdicts are those of ``run``, not computed again."""

    def __init__(self, run: Reconciliation, replies: DataFrame):
        super().__init__(run.payments, run.settlements, run.credits, run.log, replies, run.config, run.mode)
        self.run = run


for _name in ("flagged", "clean", "pools", "exact", "after_exact", "candidates", "edges", "assigned", "fuzzy", "ambiguous", "other_currency", "after_fuzzy", "solved", "split", "after_split", "left"):
    setattr(Answered, _name, property(lambda self, name=_name: getattr(self.run, name)))
