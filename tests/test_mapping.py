"""Column mapping, the required-field gate and records of uploaded tables."""

import hashlib

import pytest

from finlake.operators import mapping as M
from finlake.operators.windows import ordinal


def test_exact_alias_before_a_column_that_contains_one():
    got = M.mapping_of(["posted_date_old", "date", "memo", "amount_due"], "bank_statements")
    assert got == {"transaction_date": "date", "description": "memo", "amount": "amount_due"}
    assert M.mapping_of(["x"], "customers") == {} and M.mapping_of(["a"], "unknown") == {}


def test_gate_holds_a_table_back(spark):
    rows = spark.createDataFrame([("1",), ("2",)], "o_total string")
    assert M.missing_fields(M.mapping_of(rows.columns, "sales_invoices"), "sales_invoices") == ["invoice_number"]
    got = M.gate(rows, "f.csv", "sales_invoices").first().asDict()
    assert got == {"source": "f.csv", "document_type": "sales_invoices", "missing": "invoice_number", "accepted": 0, "rejected": 2}
    assert M.apply_mapping(rows, "sales_invoices").count() == 0
    assert M.apply_mapping(rows, "sales_invoices", {"invoice_number": "o_total", "amount": "o_total"}).count() == 2


def test_records_have_stable_ids(spark):
    rows = spark.createDataFrame([(" Acme ", None, "retail"), (None, None, None)], "customer_name string, code string, segment string")
    got = {r["name"]: r for r in M.apply_mapping(rows, "customers").collect()}
    acme = got[" Acme "]
    assert acme["business_key"] == "acme" and acme["group_name"] == "retail" and acme["status"] == "active"
    assert acme["record_id"] == "lf-customers-" + hashlib.sha1(b"acme").hexdigest()[:16]
    assert got[""]["business_key"] == got[""]["row_hash"]  # a row without a key is known by its content


def test_inventory_value(spark):
    rows = spark.createDataFrame([("s1", "n", "3", "2.5"), ("s2", "n", "x", None)], "sku string, name string, qty string, cost string")
    assert [r["value"] for r in M.apply_mapping(rows, "inventory").orderBy("business_key").collect()] == [7.5, 0.0]


@pytest.mark.parametrize("prefix", [1, 5, 20])
def test_ordinal_equals_one_window(spark, prefix):
    keys = [("A" if i % 3 else "B", f"k{i * 37 % 211:04}") for i in range(211)]
    got = {(r["g"], r["k"]): r["n"] for r in ordinal(spark.createDataFrame(keys, "g string, k string"), ["g"], "k", "n", prefix).collect()}
    want = {}
    for g in "AB":
        want |= {(g, k): i for i, k in enumerate(sorted(k for h, k in keys if h == g), 1)}
    assert got == want
