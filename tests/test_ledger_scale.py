"""The ledger reads its lines once, and customers and parts are not broadcast to classify invoices."""

import datetime as dt

from pyspark.sql import functions as F

from finlake.plans import ledger as L
from finlake.sources import adapters as A

LINES = "company_id string, id string, journal_id string, account_code string, debit string, credit string, entry_status string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark):
    rows = [("A", "l1", "j1", "1100", "10.00", "0.00", "posted"), ("A", "l1", "j1", "1100", "10.00", "0.00", "posted"), ("B", "l3", "j3", "1100", "7.00", "0.00", "draft"),
            ("C", "l4", "j4", None, "3.00", "0.00", "posted"), (None, "l5", "j5", "4000", "0.00", "2.00", "posted"), ("D", None, "j6", "9999", None, "1.00", "posted")]
    return spark.createDataFrame(rows, LINES).withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("debit", "credit")})


def test_trial_balance_reads_the_lines_once(spark, tmp_path):
    lines(spark).write.parquet(f"{tmp_path}/lines")
    tb = L.trial_balance(L.chart_of_accounts(spark), spark.read.parquet(f"{tmp_path}/lines"))
    assert plan(tb).count("FileScan parquet") == 1
    got = {(r.company_id, r.code): (r.debits, r.credits, r.balance, r.posted_lines) for r in tb.collect()}
    assert {c for c, _ in got} == {"A", "B", "C", "D", None}
    assert got["A", "1100"] == (20.0, 0.0, 20.0, 2) and got["B", "1100"] == (0.0, 0.0, 0.0, 0) == got["C", "1100"] == got["D", "4000"] == got[None, "4000"]


def test_trial_balance_takes_the_status_of_entries(spark):
    entries = spark.createDataFrame([("j1", "posted"), ("j1", "posted"), ("j3", "posted"), ("j5", "draft")], "id string, status string")
    got = {(r.company_id, r.code): r.debits for r in L.trial_balance(L.chart_of_accounts(spark), lines(spark), entries).collect()}
    assert (got["A", "1100"], got["B", "1100"]) == (20.0, 7.0)


class Given:
    def __init__(self, **tables):
        self.__dict__.update(tables)


def test_customers_and_parts_are_not_broadcast(spark):
    day = dt.date(1996, 1, 2)
    t = Given(
        customer=spark.createDataFrame([(1, "Shell Ltd"), (2, "Two")], "c_custkey long, c_name string"),
        orders=spark.createDataFrame([(7, 1, "O", 10.0, day, "1-URGENT"), (8, None, "F", 1.0, day, "2-HIGH")],
                                     "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"),
        part=spark.createDataFrame([(3, "red part"), (3, "red part")], "p_partkey long, p_name string"),
        supplier=spark.createDataFrame([(5, "Microsoft")], "s_suppkey long, s_name string"),
        lineitem=spark.createDataFrame([(7, 1, 3, 5, 2.0, 11.0, 0.1, "F", day)],
                                       "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_linestatus string, l_shipdate date"))
    for df, rows, broadcasts in ((A.sales_invoices(t), 1, 0), (A.supplier_invoices(t), 2, 1), (A.bank_transactions(t), 1, 0)):
        assert "SortMergeJoin" in plan(df) and plan(df).count("BroadcastHashJoin") <= broadcasts and df.count() == rows
    sales = L.classify_invoices(A.sales_invoices(t)).first()  # the name holds a keyword of a rule for suppliers
    assert (sales.c_account_code, sales.rule_id, sales.c_reason) == ("4000", None, "Sales invoice routed to sales revenue.")
    assert {r.c_account_code for r in L.classify_invoices(A.supplier_invoices(t)).collect()} - {"4000", "6999"}
