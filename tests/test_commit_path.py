"""Detection, stored mappings, streams, learned rules and budget packing against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from finlake.operators import budget as B
from finlake.operators import detection as D
from finlake.operators import learning as LR
from finlake.operators import targets as T
from finlake.operators.store import Store
from finlake.streaming import streams as S

AS_OF = "1998-07-01"


def manifest(spark, rows):
    return spark.createDataFrame([("a", *r) for r in rows], "company_id string, file_id long, filename string, sheet string, columns array<string>")


def test_types_in_order(spark):
    rows = [
        (1, "bank_statement_May.csv", "x", ["topic", "relevance_score", "estimated_impact"]),  # the name wins
        (2, "a.csv", "x", ["date", "debit", "credit", "balance"]),
        (3, "a.csv", "x", ["topic", "relevance_score", "estimated_impact"]),
        (4, "a.csv", "x", ["employee", "gross_pay", "net_pay"]),
        (5, "a.csv", "x", ["invoice_no", "customer", "total"]),
        (6, "a.csv", "x", ["invoice_no", "vendor", "total", "due_date"]),
        (7, "a.csv", "x", ["invoice_no", "total"]),
        (8, "a.csv", "x", ["customer_id", "customer_name", "segment"]),
        (9, "a.csv", "x", ["zzz"]),
    ]
    got = {r["file_id"]: r for r in D.detect(manifest(spark, rows)).collect()}
    assert [got[i]["document_type"] for i in range(1, 10)] == [
        "bank_statements", "bank_statements", "market_context", "payroll", "sales_invoices", "supplier_invoices", "invoices", "customers", "generic"]
    assert got[5]["mapping"] == {"invoice_number": "invoice_no", "supplier": "customer", "amount": "total"} and got[5]["confidence"] == 0.94
    assert got[9]["mapping"] == {} and got[9]["confidence"] == 0.2


def test_mappings_are_reused_and_counted_once(spark, tmp_path):
    store = Store(spark, str(tmp_path), parts=4)
    rows = [(1, "a.csv", "x", ["invoice_no", "customer", "total"]), (2, "b.csv", "x", ["zzz"])]
    found = D.detect(manifest(spark, rows))
    assert D.use_profiles(store, "u1", found) and not D.use_profiles(store, "u1", found)
    assert [r["use_count"] for r in D.profiles(store).collect()] == [1]
    # the same header in another order, twice in one upload
    again = D.detect(manifest(spark, [(3, "c.csv", "x", ["total", "invoice_no", "customer"]), (4, "d.csv", "x", ["customer", "total", "invoice_no"])]))
    assert [r["from_profile"] for r in D.with_profiles(again, store).collect()] == [True, True]
    D.use_profiles(store, "u2", again)
    assert [r["use_count"] for r in D.profiles(store).collect()] == [3]


def test_late_rows_are_reconciled(spark, tmp_path):
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double"
    files = [[(1, "2024-01-05 10:00:00", 1, "purchase", 1.5)], [(2, "2024-03-05 10:00:00", 1, "click", 2.25), (3, "2024-03-01 10:00:00", 1, "purchase", 4.0)],
             [(6, "2024-03-06 10:00:00", 1, "click", 1.0)], [(4, "2024-01-05 11:00:00", 1, "purchase", 8.0), (5, "2024-02-20 10:00:00", 6, "purchase", 16.0)]]
    source = str(tmp_path / "in")
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(f"{source}/{i}")
    store = Store(spark, str(tmp_path / "store"), parts=4)
    for run in (1, 2):  # a stream started anew changes nothing
        S.daily_flow_stream(spark, f"{source}/*", spark.read.schema(kind).parquet(f"{source}/*").schema, store, str(tmp_path / f"c{run}")).awaitTermination()
        live = {(r["company_id"], str(r["day"])): (r["inflow"], r["outflow"]) for r in store.read(S.FLOW_DAYS).collect()}
        assert live == {("co-1", "2024-01-05"): (150, 0), ("co-1", "2024-03-05"): (0, 225), ("co-1", "2024-03-01"): (400, 0), ("co-1", "2024-02-20"): (1600, 0), ("co-1", "2024-03-06"): (0, 100)}
    rows = spark.read.schema(kind).parquet(f"{source}/*")
    S.reconcile_flow(store, rows, "reconcile")
    assert sorted(map(tuple, store.read(S.FLOW_DAYS).select("company_id", "day", "inflow", "outflow").collect())) == sorted(map(tuple, S.daily_flow(rows).collect()))
    assert sorted(map(tuple, S.monthly(store.read(S.FLOW_DAYS)).collect()))[0] == ("co-1", "2024-01", 9.5, 0.0)


def test_stream_equals_batch(spark, tmp_path):
    uploads = [[("a", 1, "1", "one", "x"), ("b", 1, "1", "uno", "x")], [("a", 1, "1", "one", "y"), ("a", 2, "2", "two", "y")]]
    kind = "company_id string, row_number long, customer_id string, customer_name string, segment string"
    streamed, loaded = Store(spark, str(tmp_path / "s"), parts=4), Store(spark, str(tmp_path / "b"), parts=4)
    for i, rows in enumerate(uploads, 1):
        df = spark.createDataFrame(rows, kind)
        T.import_batch(loaded, f"customers-{i}", [T.Sheet("customers", df, f"customers_{i}.csv")], AS_OF)
        df.withColumn("upload", F.lit(i)).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    for run in (1, 2):
        S.upsert_stream(spark, str(tmp_path / "in"), kind + ", upload int", streamed, "customers", "customers", str(tmp_path / f"c{run}"), AS_OF).awaitTermination()
        for table in ("customers", T.HISTORY):
            assert sorted(map(tuple, streamed.read(table).collect())) == sorted(map(tuple, loaded.read(table).collect()))


def test_one_approval_changes_one_supplier(spark):
    inv = spark.createDataFrame([("a", "1", "Acme  Ltd", 10.0), ("a", "2", "ACME LTD", 2000.0), ("a", "3", "Other", 5.0), ("b", "4", "Acme Ltd", 5.0)],
                                "company_id string, id string, supplier string, amount double")
    inv = inv.withColumns({c: F.lit(None).cast("string") for c in ("c_account_code", "c_tax_code", "c_status", "rule_id")} | {"c_confidence": F.lit(0.35), "invoice_kind": F.lit("supplier")})
    done = spark.createDataFrame([("a", "1", "Acme Ltd", "6100", "GST", 1), ("a", "1", "Acme Ltd", "1500", "GST", 2), ("a", "3", " ", "6100", "GST", 1)],
                                 "company_id string, invoice_id string, supplier string, account_code string, tax_code string, approved_at int")
    rules = LR.learned_rules(done)
    assert [(r["company_id"], r["account_code"], r["priority"]) for r in rules.collect()] == [("a", "1500", 200)]
    again = LR.affected(inv, rules, done)
    got = {r["id"]: (r["c_account_code"], r["c_status"], r["c_confidence"]) for r in again.collect()}
    assert got["1"] == ("1500", "approved", 1.0) and got["2"][:2] == ("1500", "suggested") and set(got) == {"1", "2"}
    lines = spark.createDataFrame([("a", "1", "old"), ("a", "3", "old"), ("b", "1", "old")], "company_id string, source_id string, account string")
    new = again.select("company_id", F.col("id").alias("source_id"), F.lit("new").alias("account"))
    kept = sorted(map(tuple, LR.journal_rebuild(lines, again, new).collect()))
    assert kept == [("a", "1", "new"), ("a", "2", "new"), ("a", "3", "old"), ("b", "1", "old")]


def plain_pack(rows, budget):
    used, kept = 2, []
    for order, name, value in sorted(rows, key=lambda r: (r[0], r[1])):
        after = used + len(f'"{name}":') + len("null" if value is None else value) + (1 if kept else 0)
        if after <= budget:
            used = after
            kept.append((order, name, used))
    return kept


@pytest.mark.parametrize("budget", [2, 20, 137, 900])
def test_budget_equals_plain(spark, budget):
    rng = random.Random(budget)
    rows = [(g, rng.randint(0, 9), f"s{i}", rng.choice([None, "x" * rng.randint(0, 60), "x" * 7])) for i, g in enumerate(rng.choice(["hot", "hot", "a", "b"]) for _ in range(900))]
    got = B.budget_pack(spark.createDataFrame(rows, "g string, o int, n string, v string").repartition(5), ["g"], "o", "n", "v", budget).collect()
    want = [(g, *k) for g in ("hot", "a", "b") for k in plain_pack([r[1:] for r in rows if r[0] == g], budget)]
    assert sorted(map(tuple, got)) == sorted(want)
