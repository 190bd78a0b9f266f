from datetime import date

from tallyloom import schemas

DAY = date(2025, 1, 15)


def credits(spark, *rows):
    """(id, utr, cents, day, currency) in input order."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schemas.CREDITS)


def settlements(spark, *rows):
    """(id, utr, net cents, day, currency) in input order; payment p<id>, no fee or tax."""
    return spark.createDataFrame([(i, f"p{i}", net, 0, 0, net, day, utr, cur, k) for k, (i, utr, net, day, cur) in enumerate(rows)], schemas.SETTLEMENTS)


def payments(spark, *rows):
    """(payment id, cents, currency)."""
    return spark.createDataFrame([(f"o{p}", p, a, cur, "captured", DAY, i) for i, (p, a, cur) in enumerate(rows)], schemas.PAYMENTS)


def pairs(df, *names):
    return sorted(tuple(r) for r in df.select(*(names or ("bank_credit_id", "settlement_id"))).collect())
