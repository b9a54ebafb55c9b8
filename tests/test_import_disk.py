"""An import leaves nothing behind but its tables, and a first load moves each row once."""

import glob
import os

from finlake.operators import targets as T
from finlake.operators.store import Store

AS_OF = "1998-07-01"
KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def customers(spark, rows):
    df = spark.createDataFrame(rows, "company_id string, row_number long, customer_id string, customer_name string, segment string")
    return T.Sheet("customers", df, "customers.csv")


def shown(store):
    return sorted((r.company_id, r.code, r.name, r.segment) for r in store.read("customers").collect())


def test_import_empties_its_scratch_and_keeps_the_newest_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path), parts=2)
    before = spark.conf.get(KEY, None)
    rows = [("a", 1, "1", "one", "x"), ("a", 2, "1", "one", "y"), ("a", 3, "2", "two", "x"), (None, 4, "1", "none", "x"), (None, 5, "1", "none", "y"), ("a", 6, "3", " ", "x")]
    assert T.import_batch(store, "1", [customers(spark, rows)], AS_OF)
    got = sorted((str(r.company_id), r.code, r.segment) for r in store.read("customers").collect())
    assert got == [("None", "1", "y"), ("a", "1", "y"), ("a", "2", "x")]
    assert T.import_batch(store, "2", [customers(spark, [("a", 1, "2", "two", "z"), ("a", 2, "1", "one", "y")])], AS_OF)
    assert [r for r in store.read("customers").filter("company_id = 'a'").orderBy("code").select("code", "segment").collect()] == [("1", "y"), ("2", "z")]
    assert sorted((r.business_key, r.record_version) for r in store.read(T.HISTORY).filter("company_id = 'a'").collect()) == [("1", 1), ("1", 2), ("2", 1), ("2", 2)]
    assert not glob.glob(f"{tmp_path}/scratch/*/*.parquet") or all(
        spark.read.parquet(os.path.dirname(f)).isEmpty() for f in glob.glob(f"{tmp_path}/scratch/*/*.parquet"))
    assert spark.conf.get(KEY, None) == before


def test_first_load_of_a_table_needs_no_shuffle(spark, tmp_path, monkeypatch):
    from finlake.operators import store as S

    met = []
    latest = S._latest
    monkeypatch.setattr(S, "_latest", lambda *a: met.append(1) or latest(*a))
    store = Store(spark, str(tmp_path), parts=2)
    T.import_batch(store, "1", [customers(spark, [("a", 1, "1", "one", "x")])], AS_OF)
    assert not met
    T.import_batch(store, "2", [customers(spark, [("a", 1, "1", "one", "y")])], AS_OF)
    assert met and shown(store) == [("a", "1", "one", "y")]


def test_sheets_of_one_type_may_map_different_fields(spark, tmp_path):
    store = Store(spark, str(tmp_path), parts=2)
    one = spark.createDataFrame([("a", 1, "1", "one", "x")], "company_id string, row_number long, customer_id string, customer_name string, segment string")
    two = spark.createDataFrame([("a", 1, "two", "AU", "2")], "company_id string, row_number long, customer_name string, country string, customer_id string")
    T.import_batch(store, "1", [T.Sheet("customers", one, "one.csv"), T.Sheet("customers", two, "two.csv")], AS_OF)
    got = sorted((r.code, r.name, r.country, r.segment) for r in store.read("customers").collect())
    assert got == [("1", "one", "", "x"), ("2", "two", "AU", "")]


def suppliers(spark, rows):
    df = spark.createDataFrame(rows, "company_id string, row_number long, vendor_id string, vendor_name string")
    return T.Sheet("suppliers", df, "suppliers.csv")


def test_types_are_loaded_one_after_the_other_and_published_together(spark, tmp_path, monkeypatch):
    store, met = Store(spark, str(tmp_path), parts=2), []

    def held():
        return [f.split("scratch/")[1].split("-")[0] for f in glob.glob(f"{tmp_path}/scratch/*") if not spark.read.parquet(f).isEmpty()]

    write = Store._write
    monkeypatch.setattr(Store, "_write", lambda self, rows, name, version: met.append((name, held(), self.version())) or write(self, rows, name, version))
    assert T.import_batch(store, "1", [customers(spark, [("a", 1, "1", "one", "x")]), suppliers(spark, [("a", 1, "9", "nine"), ("a", 2, "8", " ")])], AS_OF)
    assert [m[:2] for m in met if m[0] in ("customers", "suppliers")] == [("customers", ["customers"]), ("suppliers", ["suppliers"])]
    assert {m[2] for m in met} == {0} and store.version() == 1
    assert sorted((r.document_type, r.business_key) for r in store.read(T.HISTORY).collect()) == [("customers", "1"), ("suppliers", "9")]
    assert [(r.document_type, r.row_number) for r in store.read(T.REJECTS).collect()] == [("suppliers", 2)]


def test_a_failed_type_leaves_the_old_state_and_no_scratch(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), parts=2)
    T.import_batch(store, "1", [customers(spark, [("a", 1, "1", "one", "x")])], AS_OF)
    write = Store._write

    def failing(self, rows, name, version):
        if name == "suppliers":
            raise RuntimeError("no room")
        return write(self, rows, name, version)

    second = [customers(spark, [("a", 1, "1", "one", "y")]), suppliers(spark, [("a", 1, "9", "nine")])]
    with monkeypatch.context() as m:
        m.setattr(Store, "_write", failing)
        try:
            T.import_batch(store, "2", second, AS_OF)
        except RuntimeError as exc:
            assert "no room" in str(exc)
    assert shown(store) == [("a", "1", "one", "x")] and store.version() == 1 and store.read(T.HISTORY).count() == 1
    assert all(spark.read.parquet(f).isEmpty() for f in glob.glob(f"{tmp_path}/scratch/*"))
    assert T.import_batch(store, "2", second, AS_OF) and shown(store) == [("a", "1", "one", "y")]


def test_types_that_share_a_table_are_together():
    groups = T._sharing_tables(["customers", "sales_invoices", "payments", "supplier_invoices", "bank_statements", "transactions"], AS_OF)
    assert groups == [["customers"], ["sales_invoices", "supplier_invoices"], ["payments", "bank_statements", "transactions"]]


def test_stored_versions_move_once(spark, tmp_path):
    """The rows of the batch and the stored versions meet by the keys that the versions are grouped by."""
    store = Store(spark, str(tmp_path), parts=2)
    sheet = customers(spark, [("a", 1, "1", "one", "x")])
    T.import_batch(store, "1", [sheet], AS_OF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = T._versioned(store, "customers", [sheet], ["code", "name", "segment"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_large_types_are_merged_some_parts_at_a_time(spark, tmp_path, monkeypatch):
    """Slices move a part's rows each and bring what one pass brings: repeated keys, null companies and rejected rows as well."""
    from finlake.operators import store as S

    one = [(co, i, str(i % 30), " " if i % 7 == 0 else f"n{i}", f"s{i % 4}") for i, co in enumerate(["a", "b", None] * 40, 1)]
    two = [(co, i, key, name, "new" if i % 3 == 0 else segment) for co, i, key, name, segment in one] + [("a", 900, "900", "late", "x")]
    got, slices = [], []
    versioned = T._versioned
    monkeypatch.setattr(T, "_versioned", lambda *a, **k: slices.append(a[4]) or versioned(*a, **k))
    for rows, path in ((10**9, "whole"), (25, "sliced")):
        monkeypatch.setattr(S, "SLICE_ROWS", rows)
        store = Store(spark, f"{tmp_path}/{path}", parts=4)
        for number, upload in enumerate((one, two)):
            sheet = customers(spark, upload)
            sheet.most = len(upload)
            assert T.import_batch(store, str(number), [sheet], AS_OF)
        tables = [store.read(t) for t in ("customers", T.HISTORY, T.REJECTS)]
        got.append([sorted(map(str, t.select(*sorted(t.columns)).collect())) for t in tables])
        got[-1].append(sorted((str(r.company_id), r.code, r.part) for r in store._read("customers", store._state()[1]["customers"]).collect()))
    assert slices == [None, None, *[[p] for p in range(4)] * 2] and all(got[0]) and got[0] == got[1]
    assert S.in_slices({0: 10, 2: 20, 1: 9, 3: 40}) == [[0, 1], [2], [3]] and S.in_slices({}) == []


def test_a_slice_aggregates_its_rows_alone(spark, tmp_path):
    """The parts are told from the keys before a sheet's rows are added up, so that slices do not add up all rows each."""
    from finlake.sources.sheets import SHEETS

    spark.createDataFrame([(1, 7, 1.5, "1996-01-02"), (2, 8, 2.5, "1996-01-03")], "l_orderkey long, l_suppkey long, l_extendedprice double, l_shipdate string").write.parquet(f"{tmp_path}/l")
    text = SHEETS["supplier_invoices"][1].replace("{b}", "1").replace("{t:lineitem}", "{lineitem}")
    sheet = T.Sheet("supplier_invoices", spark.sql(text, lineitem=spark.read.parquet(f"{tmp_path}/l")), "bills.csv")
    rows = T._versioned(Store(spark, str(tmp_path), parts=2), "supplier_invoices", [sheet], list(T._mapping(sheet)), [1])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    sums = next(k for k, line in enumerate(plan.splitlines()) if "Aggregate [l_orderkey" in line)
    assert any("xxhash64" in line for line in plan.splitlines()[sums:]), plan
