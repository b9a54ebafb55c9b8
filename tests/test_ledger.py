"""Ledger invariants and the seed golden of FIXTURES section 4 (classification part)."""

from pyspark.sql import functions as F

from finlake.context import Ctx
from finlake.plans import ledger as L
from paths import SF_SMALL


def test_seed_invoice_classification(spark):
    rows = [
        ("i1", "supplier", "Metro Freight", "Freight charges June", 24850.00),
        ("i2", "supplier", "City Utilities", "Utilities bill", 1200.00),
        ("i3", "supplier", "Acme Pty Ltd", "Sundry goods", 300.00),
        ("i4", "supplier", "Tech Store", "New laptop", 2500.00),
    ]
    df = spark.createDataFrame(rows, "id string, invoice_kind string, supplier string, description string, amount double") \
        .withColumn("amount", F.col("amount").cast("decimal(18,2)")) \
        .withColumn("validation_status", F.lit("imported")).withColumn("account_code", F.lit(None).cast("string")) \
        .withColumn("tax_code", F.lit(None).cast("string"))
    got = {r.id: r for r in L.classify_invoices(df).collect()}
    assert (got["i1"].c_account_code, float(got["i1"].c_confidence), got["i1"].c_status) == ("6130", 0.96, "auto_approved")
    assert (got["i2"].c_account_code, float(got["i2"].c_confidence), got["i2"].c_status) == ("6120", 0.88, "suggested")
    assert (got["i3"].c_account_code, float(got["i3"].c_confidence), got["i3"].c_status) == ("6999", 0.35, "needs_review")
    # capital purchase >= 1000 stays reviewable
    assert (got["i4"].c_account_code, got["i4"].c_status) == ("1500", "suggested")


def test_every_journal_balances_and_trial_balance_is_even(spark):
    c = Ctx(spark, SF_SMALL)
    unbalanced = (c.lines.groupBy("journal_id").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"))
                  .filter(F.col("d") != F.col("c")).count())
    assert unbalanced == 0
    tb = c.trial_balance.agg(F.sum("debits").alias("d"), F.sum("credits").alias("c")).first()
    assert round(tb.d, 2) == round(tb.c, 2) and tb.d > 0


def test_trial_balance_independent_of_partitioning(spark):
    import __spark_entry__ as E

    q = E.queries()["trial_balance"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(tuple(r) for r in Ctx(spark, SF_SMALL).trial_balance.collect())
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = sorted(tuple(r) for r in L.trial_balance(L.chart_of_accounts(spark), Ctx(spark, SF_SMALL).lines).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b and len(a) == 47
    assert q(spark, SF_SMALL).count() == 47
