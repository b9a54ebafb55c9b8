"""duplicate_payment_pairs vs a brute-force transcription of the check's semantics on random data
with one hot reference key holding over a third of the rows, repeated and sub-dollar amounts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from finlake.operators.joins import duplicate_payment_pairs


def brute(rows, p=9, q=10):
    out = {}
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        rid, key, d, cents = r
        prior = by_key.setdefault(key, [])
        if cents > 0:
            for e in prior:
                if min(cents, e[3]) * q >= max(cents, e[3], 100) * p:
                    out[rid] = (key, e[0], e[3])
                    break
        prior.append(r)
    return out


def test_matches_brute_force_with_hot_key(spark):
    random.seed(11)
    rows = []
    for i in range(1500):
        key = "hot7" if i % 3 == 0 or i % 7 == 0 else f"k{random.randint(1, 40)}"
        cents = random.choice([0, 50, 95, 99, 100, 101, 1000, 1111, 90000, 99999, 100000]) if i % 5 == 0 \
            else random.randint(1, 3_000_000)
        rows.append((f"t{i:05d}", key, dt.date(2024, 1, 1) + dt.timedelta(days=random.randint(0, 30)), cents))
    df = spark.createDataFrame(rows, "id string, k string, transaction_date date, c bigint").select(
        F.lit("default").alias("company_id"), "id", "transaction_date",
        F.concat(F.lit("Payment INV-"), F.col("k")).alias("description"),
        (F.col("c").cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("amount"))
    want = brute(rows)
    got = {r.current_id: (r.reference_key, r.earlier_id, round(r.earlier_amount * 100))
           for r in duplicate_payment_pairs(df).collect()}
    assert got == want
    assert sum(1 for r in rows if r[1] == "hot7") > len(rows) / 3


def test_small_references_need_no_blocks(spark, monkeypatch):
    """References with few payments are answered from one array, with the rows that the blocks give; payments
    given twice, without a date, below the least amount and of references around the limit included."""
    from finlake.operators import joins as J

    random.seed(5)
    rows = [(f"t{i:04d}", f"s{i % 20}", None if i % 37 == 0 else dt.date(2024, 1, 1 + i % 9), random.choice([50, 95, 100, 101, random.randint(900, 1100)])) for i in range(400)]
    rows += [(f"u{i:03d}", key, dt.date(2024, 2, 1), 1000 + i % 7) for key, n in (("at9", J.SMALL_GROUP), ("over9", J.SMALL_GROUP + 1)) for i in range(n)]
    df = spark.createDataFrame(rows + rows[:30], "id string, k string, transaction_date date, c bigint").select(
        F.lit("default").alias("company_id"), "id", "transaction_date", F.concat(F.lit("Payment INV-"), F.col("k")).alias("description"),
        (F.col("c").cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("amount"))
    got = sorted(tuple(r) for r in duplicate_payment_pairs(df).collect())
    monkeypatch.setattr(J, "SMALL_GROUP", 0)
    assert got == sorted(tuple(r) for r in duplicate_payment_pairs(df).collect())
    blocks, seen = J._dyadic_blocks, []
    monkeypatch.setattr(J, "SMALL_GROUP", 63)
    monkeypatch.setattr(J, "_dyadic_blocks", lambda df, lo, hi: seen.append(df) or blocks(df, lo, hi))
    duplicate_payment_pairs(df)
    assert {r[0] for r in seen[0].select("k").distinct().collect()} == {"at9", "over9"}
