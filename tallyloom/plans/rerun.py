"""A run over again after corrections: only what they reach is matched again."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import consolidate, corrections, matching, split
from .cluster import staged
from .reconcile import Reconciliation

BANK, SETTLEMENT = "bank_credit_id", "settlement_id"
Both = tuple[DataFrame, DataFrame]


def _of(rows: DataFrame, some: DataFrame, name: str) -> DataFrame:
    return rows.join(some.select(name), name, "left_semi")


def _without(rows: DataFrame, some: DataFrame, name: str) -> DataFrame:
    return rows.join(some.select(name), name, "left_anti")


def _ids(name: str, *tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [t.select(name) for t in tables]).distinct()


class Rerun(Reconciliation):
    """The result of a full run with another correction log, from the tables of a run before.

    Corrections take records out of the pools or give them back. Exact matching is done again for the keys of such
    records; the candidate pairs of records that came are looked up, and assignment is done again in the parts of the candidate
    graph that a changed record or pair touches; batched payouts are replayed from the settlements and credits that came or
    went. Everything else is taken over. Each step hands on (came, went) for either side, which is what the next has to look at.
    """

    def __init__(self, before: Reconciliation, log: DataFrame | None, replies: DataFrame | None = None):
        super().__init__(before.payments, before.settlements, before.credits, log, replies if replies is not None else before.replies, before.config, before.mode)
        self.before = before

    @cached_property
    def flagged(self) -> DataFrame:
        return self.before.flagged

    @cached_property
    def clean(self) -> DataFrame:
        return self.before.clean

    def _moved(self, was: Both, is_: Both, name: str) -> tuple[Both, Both]:
        """((came, went) of credits, (came, went) of settlements), written; was and is_ hold the records that may have moved."""
        out = []
        for a, b, n in ((was[0], is_[0], BANK), (was[1], is_[1], SETTLEMENT)):
            out.append((staged(_without(b, a, n), f"{name}-came"), staged(_without(a, b, n), f"{name}-went")))
        return out[0], out[1]

    @staticmethod
    def _applied(tables: Both, moved: tuple[Both, Both]) -> Both:
        return tuple(_without(t, went, n).unionByName(came.select(t.columns)) for t, (came, went), n in zip(tables, moved, (BANK, SETTLEMENT), strict=True))

    # ------------------------------------------------------------ exact

    @cached_property
    def _keys(self) -> DataFrame:
        """Exact keys of the records that either log takes out and the other does not."""
        sets = [corrections.removed(x) if x is not None else (self.credits.select(BANK).limit(0), self.clean.select(SETTLEMENT).limit(0)) for x in (self.before.log, self.log)]
        changed = [_without(a, b, n).union(_without(b, a, n)) for a, b, n in zip(*sets, (BANK, SETTLEMENT), strict=True)]
        bank = _of(self.credits, changed[0], BANK).select("utr", "amount", "currency", F.col("credited_at").alias("day"))
        settlement = _of(self.clean, changed[1], SETTLEMENT).select("utr", F.col("net").alias("amount"), "currency", F.col("settled_at").alias("day"))
        return staged(bank.union(settlement).distinct(), "keys")

    def _keyed(self, pools: Both, keys: DataFrame, columns: list[str]) -> Both:
        """The records of pools under some keys, given as columns of (utr, amount, currency, day)."""
        bank = pools[0].withColumn("day", F.col("credited_at")).join(keys, columns, "left_semi").select(pools[0].columns)
        settlement = pools[1].withColumn("day", F.col("settled_at")).withColumn("amount", F.col("net")).join(keys, columns, "left_semi").select(pools[1].columns)
        return bank, settlement

    @cached_property
    def _exact_parts(self) -> tuple[Both, DataFrame, Both]:
        old, new = (self._keyed(x, self._keys, matching.KEY) for x in (self.before.pools, self.pools))
        new = staged(new[0], "bank"), staged(new[1], "settlement")
        return old, staged(matching.exact_matches(*new), "exact"), new

    @cached_property
    def exact(self) -> DataFrame:
        old, redone, _ = self._exact_parts
        return _without(self.before.exact, old[0], BANK).unionByName(redone)

    @cached_property
    def _after_exact_moved(self) -> tuple[Both, Both]:
        old, redone, new = self._exact_parts
        was = matching.without_credits(old[0], self.before.exact), matching.without_settlements(old[1], self.before.exact)
        return self._moved(was, (matching.without_credits(new[0], redone), matching.without_settlements(new[1], redone)), "exact")

    @cached_property
    def after_exact(self) -> Both:
        return self._applied(self.before.after_exact, self._after_exact_moved)

    # ------------------------------------------------------------ fuzzy

    @cached_property
    def _graph(self) -> tuple[DataFrame, Both]:
        """(candidate pairs now, credits and settlements in parts of the graph that have changed)."""
        (b_came, b_went), (s_came, s_went) = self._after_exact_moved
        bank, settlement = self.after_exact
        found = matching.fuzzy_candidates(b_came, settlement, self.config).unionByName(matching.fuzzy_candidates(bank, s_came, self.config)).dropDuplicates([BANK, SETTLEMENT])
        added = staged(matching.usable_bands(found, self.config), "added")
        old = self.before.edges
        lost = _of(old, b_went, BANK).unionByName(_of(old, s_went, SETTLEMENT))
        edges = _without(_without(old, b_went, BANK), s_went, SETTLEMENT).unionByName(added)
        reach = staged(_ids(BANK, b_came, added, lost), "reach"), staged(_ids(SETTLEMENT, s_came, added, lost), "reach")
        while True:
            wider = staged(_ids(BANK, reach[0], _of(edges, reach[1], SETTLEMENT)), "reach")
            further = staged(_ids(SETTLEMENT, reach[1], _of(edges, wider, BANK)), "reach")
            grown = wider.count() > reach[0].count() or further.count() > reach[1].count()
            reach = wider, further
            if not grown:
                return edges, reach

    @cached_property
    def edges(self) -> DataFrame:
        return self._graph[0]

    @cached_property
    def _redone(self) -> DataFrame:
        edges, (bank, _) = self._graph
        return matching.assigned(staged(_of(edges, bank, BANK), "edges"), staged)

    @cached_property
    def assigned(self) -> DataFrame:
        (_, b_went), _ = self._after_exact_moved
        return _without(_without(self.before.assigned, self._graph[1][0], BANK), b_went, BANK).unionByName(self._redone)

    @cached_property
    def _currency_parts(self) -> tuple[Both, Both, DataFrame]:
        """Records, before and now, under the references, amounts and days of those that may have changed, and their exceptions now."""
        (b_came, b_went), (s_came, s_went) = self._after_exact_moved
        bank, settlement = self._graph[1]
        key = ["utr", "amount", "day"]
        some = _of(self.credits, _ids(BANK, b_came, b_went, bank), BANK).select("utr", "amount", F.col("credited_at").alias("day"))
        some = some.union(_of(self.clean, _ids(SETTLEMENT, s_came, s_went, settlement), SETTLEMENT).select("utr", "net", "settled_at")).distinct()
        keys = staged(some, "keys")
        old, new = self._keyed(self.before.after_exact, keys, key), self._keyed(self.after_exact, keys, key)
        new = staged(new[0], "bank"), staged(new[1], "settlement")
        return old, new, staged(matching.currency_exceptions(*matching.currency_pairs(*new), self.assigned), "currency")

    @cached_property
    def other_currency(self) -> DataFrame:
        old, _, redone = self._currency_parts
        gone = old[0].select(F.lit("bank").alias("source"), F.col(BANK).alias("record_id")).union(old[1].select(F.lit("settlement"), SETTLEMENT))
        return self.before.other_currency.join(gone, ["source", "record_id"], "left_anti").unionByName(redone)

    @cached_property
    def _after_fuzzy_moved(self) -> tuple[Both, Both]:
        """The records looked at here have the keys of all that changed, so they hold every record that may have moved."""
        old, new, redone = self._currency_parts
        was = _of(self.before.after_fuzzy[0], old[0], BANK), _of(self.before.after_fuzzy[1], old[1], SETTLEMENT)
        of = lambda source, name: redone.where(F.col("source") == source).select(F.col("record_id").alias(name))
        bank = _without(_without(new[0], self.assigned, BANK), of("bank", BANK), BANK)
        settlement = _without(_without(new[1], self.assigned, SETTLEMENT), of("settlement", SETTLEMENT), SETTLEMENT)
        return self._moved(was, (bank, settlement), "fuzzy")

    @cached_property
    def after_fuzzy(self) -> Both:
        bank, settlement = self._applied(self.before.after_fuzzy, self._after_fuzzy_moved)
        return staged(bank, "bank"), staged(settlement, "settlement")

    # ------------------------------------------------------------ split, leftovers

    @cached_property
    def solved(self) -> DataFrame:
        (b_came, b_went), (s_came, s_went) = self._after_fuzzy_moved
        before = self.before.solved, b_came.unionByName(b_went), s_came.unionByName(s_went)
        return split.solve(*self.after_fuzzy, staged, self.config, linked_only=self.mode == "linked", before=before)

    @cached_property
    def left(self) -> DataFrame:
        bank = self.after_split[0]
        known = self.before.left.join(bank.select(F.col(BANK).alias("record_id")), "record_id", "left_semi")
        new = _without(bank, self.before.left.select(F.col("record_id").alias(BANK)), BANK)
        return staged(known.unionByName(consolidate.leftover_banks(new, self.settlements)), "left")

    def touched(self) -> DataFrame:
        """(step, source, n, n_all): how many records each step looked at, of how many."""
        looked = [
            ("exact", self._exact_parts[2], self.pools), ("fuzzy", self._graph[1], self.after_exact), ("currency", self._currency_parts[1], self.after_exact),
            ("split", tuple(c.unionByName(w) for c, w in self._after_fuzzy_moved), self.after_fuzzy),
        ]
        rows = [
            df.agg(F.lit(step).alias("step"), F.lit(source).alias("source"), F.count("*").alias("n")).withColumn("all", F.lit(kind))
            for step, part, every in looked for kind, tables in ((False, part), (True, every)) for source, df in zip(("bank", "settlement"), tables, strict=True)
        ]
        n = lambda kind: F.max(F.when(F.col("all") == kind, F.col("n")))
        return reduce(DataFrame.unionByName, rows).groupBy("step", "source").agg(n(False).alias("n"), n(True).alias("n_all"))
