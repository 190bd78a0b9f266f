"""A labelled reconciliation workload derived from order tables (orders, lineitem).

Each order gets a discrepancy class from its key; everything is a column expression on the key, so
the work is a scan except for the batches, which group line items by order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: first and last residue of the order key modulo 100 -> (class, level); fixed values of the plan
CLASSES = (
    (0, 43, "clean", "clear"), (44, 55, "date_shifted", "clear"), (56, 65, "amount_shifted", "clear"), (66, 71, "reference_mangled", "clear"),
    (72, 77, "reference_mangled_boundary", "boundary"), (78, 81, "reference_mangled_boundary", "boundary"), (82, 84, "near_duplicate_decoy", "decoy"),
    (85, 88, "batched_payout", "clear"), (89, 90, "batched_payout_ambiguous", "decoy"), (91, 93, "fee_tax_mismatch", "unresolvable"),
    (94, 95, "settlement_pending_bank", "unresolvable"), (96, 96, "unclaimed_bank_credit", "unresolvable"), (97, 97, "currency_mismatch", "unresolvable"),
    (98, 98, "unresolvable_noise", "unresolvable"), (99, 99, "duplicate_bank", "clear"),
)
AMBIGUOUS_PARTS = (41300, 68900, 52700, 57500)  # two pairs with one sum
AMBIGUOUS_CREDIT = 110200


def class_of(m: Column, field: int) -> Column:
    """Field 2: the class, 3: the level."""
    out = F.lit(None).cast("string")
    for row in reversed(CLASSES):
        out = F.when(m.between(row[0], row[1]), row[field]).otherwise(out)
    return out


def degrade_reference(ref: Column, target: float) -> Column:
    """Cut a reference so that its similarity to the whole falls to about ``target``."""
    return F.substring(ref, F.lit(1), F.length(ref) - F.round((1 - target) * F.length(ref)).cast("int"))


def named(prefix: str, suffix: Column | str = "") -> Column:
    return F.concat(F.lit(prefix), F.format_string("%09d", F.col("k")), F.lit(suffix) if isinstance(suffix, str) else suffix)


@dataclass
class Workload:
    """payments, settlements, credits, labels, corrections."""

    spark: SparkSession
    sf_dir: str

    def base(self) -> DataFrame:
        orders = self.spark.read.parquet(f"{self.sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate")
        k = F.col("o_orderkey").cast("long")
        rows = orders.select(
            k.alias("k"), (k % 100).alias("m"), F.floor(k / 100).alias("h"), F.col("o_orderdate").cast("date").alias("d"), F.round(F.col("o_totalprice") * 100).cast("long").alias("gross")
        )
        rows = rows.withColumn("fee", F.floor((F.col("gross") * 2 + 50) / 100)).withColumn("tax", F.floor((F.col("fee") * 18 + 50) / 100))
        utr = F.concat(F.lit("UTR"), F.format_string("%06d", F.col("k") + 1), F.upper(F.substring(F.md5(F.col("k").cast("string")), 1, 6)))
        sign = F.when(F.col("h") % 2 == 0, 1).otherwise(-1)
        return rows.withColumn("net", F.col("gross") - F.col("fee") - F.col("tax")).withColumn("utr", utr).withColumn("sign", sign)

    def classes(self) -> DataFrame:
        return self.base().select("k", "m", class_of(F.col("m"), 2).alias("class"), class_of(F.col("m"), 3).alias("level"))

    def parts(self) -> DataFrame:
        """Parts of batched payouts: (k, d, utr, n, price)."""
        lines = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        lines = lines.where((F.col("l_orderkey") % 100).between(85, 88)).withColumn("n", F.row_number().over(order))
        real = self.base().where("m between 85 and 88").join(lines, F.col("k") == F.col("l_orderkey")).select("k", "d", "utr", "n", F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"))
        fixed = self.base().where("m between 89 and 90").select("k", "d", "utr", F.posexplode(F.array(*map(F.lit, AMBIGUOUS_PARTS))).alias("n", "price"))
        return real.unionByName(fixed.select("k", "d", "utr", (F.col("n") + 1).alias("n"), F.col("price").cast("long").alias("price")))

    def settlements(self) -> DataFrame:
        b, m = self.base(), F.col("m")
        day = F.when(m.between(44, 55), F.expr("date_add(d, cast(sign * (h % 3 + 1) as int))")).when(m.between(78, 84), F.date_add("d", 3)).otherwise(F.col("d"))
        utr = (
            F.when(m.between(66, 71), F.concat(F.substring("utr", 1, 6), F.lit("-"), F.expr("substring(utr, 7)")))
            .when(m.between(72, 77), F.substring("utr", 1, 12)).when(m.between(78, 84), F.substring("utr", 1, 10)).otherwise(F.col("utr"))
        )
        net = F.when(m.between(91, 93), F.col("net") + 1500).otherwise(F.col("net"))
        inr = F.lit("INR").alias("currency")
        single = b.where("m < 85 or m between 91 and 95 or m in (97, 99)").select(
            named("setl_").alias("settlement_id"), named("pay_").alias("payment_id"), "gross", "fee", "tax", net.alias("net"), day.alias("settled_at"), utr.alias("utr"), inr, (F.col("k") * 100).alias("seq")
        )
        decoy_net = F.floor(F.col("net") * 1012 / 1000)
        decoy = b.where("m between 82 and 84").select(
            named("setl_", "_d").alias("settlement_id"), named("pay_", "_d").alias("payment_id"), (decoy_net + F.col("fee") + F.col("tax")).alias("gross"), "fee", "tax", decoy_net.alias("net"),
            F.date_add("d", 2).alias("settled_at"), F.substring("utr", 1, 10).alias("utr"), inr, (F.col("k") * 100 + 1).alias("seq"),
        )
        nn = F.format_string("_%02d", "n")
        zero = F.lit(0).cast("long")
        parts = self.parts().select(
            named("setl_", nn).alias("settlement_id"), named("pay_", nn).alias("payment_id"), F.col("price").alias("gross"), zero.alias("fee"), zero.alias("tax"), F.col("price").alias("net"),
            F.expr("date_add(d, (n - 1) % 2)").alias("settled_at"), F.concat("utr", F.lit("_S"), F.col("n").cast("string")).alias("utr"), inr, (F.col("k") * 100 + F.col("n")).alias("seq"),
        )
        return single.unionByName(decoy).unionByName(parts)

    def payments(self, settlements: DataFrame | None = None) -> DataFrame:
        """One captured payment per settlement, of its gross amount on the order's day. settlements: those of this workload, if they are written already."""
        return (self.settlements() if settlements is None else settlements).select(
            F.expr("concat('ord_', substring(payment_id, 5))").alias("order_id"), "payment_id", F.col("gross").alias("amount"), "currency", F.lit("captured").alias("status"), F.col("settled_at").alias("created_at"), "seq"
        )

    def credits(self) -> DataFrame:
        b, m = self.base(), F.col("m")
        amount = F.when(m.between(56, 65), F.col("net") + F.col("sign") * F.floor(F.col("net") * 8 / 1000)).when(m == 98, F.col("net") * 1000).when(m.between(89, 90), F.lit(AMBIGUOUS_CREDIT)).otherwise(F.col("net")).cast("long")
        day = F.when(m == 98, F.lit("1990-06-15").cast("date")).when(m.between(89, 90), F.date_add("d", 1)).otherwise(F.col("d"))
        shape = lambda df, suffix, n: df.select(
            named("bank_", suffix).alias("bank_credit_id"), "utr", amount.alias("amount"), day.alias("credited_at"), F.when(m == 97, "USD").otherwise("INR").alias("currency"), (F.col("k") * 100 + n).alias("seq")
        )
        sums = self.parts().where("k % 100 between 85 and 88").groupBy("k", "d", "utr").agg(F.sum("price").alias("amount"))
        batch = sums.select(named("bank_").alias("bank_credit_id"), "utr", "amount", F.date_add("d", 1).alias("credited_at"), F.lit("INR").alias("currency"), (F.col("k") * 100).alias("seq"))
        return shape(b.where("m < 85 or m in (89, 90) or m >= 96"), "", 0).unionByName(shape(b.where("m = 99"), "_x", 1)).unionByName(batch)

    def labels(self) -> DataFrame:
        b = self.base().withColumn("class", class_of(F.col("m"), 2)).withColumn("level", class_of(F.col("m"), 3))
        none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

        def rows(df: DataFrame, n: Column | int, label: str, bank: Column = none, settlement: Column = none, ids: Column = no_list, decoy: Column = none, kind: Column | None = None) -> DataFrame:
            return df.select(
                bank.alias("bank_credit_id"), settlement.alias("settlement_id"), ids.alias("settlement_ids"), decoy.alias("decoy_settlement_id"), F.lit(label).alias("label"),
                (F.col("class") if label == "exception" else none).alias("exception_type"), (kind if kind is not None else F.col("class")).alias("class"), "level", (F.col("k") * 100 + n).alias("seq"),
            )

        bank, settlement = named("bank_"), named("setl_")
        parts = self.parts().withColumn("m", F.col("k") % 100).withColumn("class", class_of(F.col("m"), 2)).withColumn("level", class_of(F.col("m"), 3))
        part = named("setl_", F.format_string("_%02d", "n"))
        batch = parts.where("m <= 88").groupBy("k", "class", "level").agg(F.array_sort(F.collect_list(part)).alias("ids"))
        out = rows(b.where("m < 82"), 0, "match", bank, settlement)
        out = out.unionByName(rows(b.where("m = 99"), 0, "match", bank, settlement, kind=F.lit("clean")))
        out = out.unionByName(rows(b.where("m between 82 and 84"), 0, "match", bank, settlement, decoy=named("setl_", "_d")))
        out = out.unionByName(rows(b.where("m between 82 and 84"), 1, "exception", settlement=named("setl_", "_d")))
        out = out.unionByName(rows(batch, 0, "match", bank, F.col("ids")[0], F.col("ids"), kind=F.when(F.size("ids") > 1, F.col("class")).otherwise("clean")))
        out = out.unionByName(rows(b.where("m in (89, 90, 96, 97, 98)"), 0, "exception", bank))
        out = out.unionByName(rows(parts.where("m >= 89"), F.col("n"), "exception", settlement=part))
        out = out.unionByName(rows(b.where("m between 91 and 95 or m = 97"), 1, "exception", settlement=settlement))
        return out.unionByName(rows(b.where("m = 99"), 1, "exception", named("bank_", "_x")))

    def corrections(self) -> DataFrame:
        """Accepts for credits with m = 82, rejects for credits with m = 98 and even h."""
        b = self.base()
        shape = lambda df, decision, match, score: df.select(
            named("bank_").alias("record_id"), F.lit("bank").alias("source"), F.lit(decision).alias("decision"), match.cast("string").alias("corrected_match_id"),
            F.lit(None).cast("array<string>").alias("components"), F.lit(score).cast("double").alias("score"), F.lit(None).cast("timestamp").alias("ts"), F.col("k").alias("seq"),
        )
        return shape(b.where("m = 82"), "accept", named("setl_"), 0.7).unionByName(shape(b.where("m = 98 and h % 2 = 0"), "reject", F.lit(None), None))

    def demo_corrections(self) -> DataFrame:
        """Accepts for the first two decoy credits."""
        first = Window.orderBy("seq")
        few = self.corrections().where("decision = 'accept'").orderBy("seq").limit(2)
        return few.withColumn("rank", F.row_number().over(first)).where("rank <= 2").drop("rank")

    def replies(self, pairs: DataFrame) -> DataFrame:
        """A reply text for each ambiguous pair, by the order's key."""
        h = F.floor(F.regexp_extract("bank_credit_id", r"_(\d+)", 1).cast("long") / 100) % 4
        reply = (
            F.when(h == 0, 'Sure: {"verdict": "match", "reasoning": " same payer "}').when(h == 1, '{"verdict": "no_match", "reasoning": "other payer"}')
            .when(h == 2, '{"verdict": "unsure"}').otherwise("no idea")
        )
        return pairs.select("bank_credit_id", "settlement_id", reply.alias("reply"), F.lit(None).cast("string").alias("error"))


def check_size(settlements: DataFrame, credits: DataFrame, least: int = 50) -> None:
    """A labelled batch that is too small says nothing; both sides need ``least`` rows."""
    for name, df in (("settlements", settlements), ("credits", credits)):
        n = df.limit(least).count()
        if n < least:
            raise ValueError(f"{name}: {n} rows, at least {least} are needed")
