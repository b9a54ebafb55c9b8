"""Ingestion queries: the given tables, each taken as an uploaded file of a declared type, mapped whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import Ctx
from ..operators import mapping as M
from ..registry import query

#: Table -> declared document type.
SOURCES = {"customer": "customers", "supplier": "suppliers", "part": "inventory", "orders": "sales_invoices",
           "lineitem": "supplier_invoices", "events": "bank_statements"}


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _filled(source: str, document_type: str, pairs: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{source}' AS source, '{document_type}' AS document_type, '{f}' AS field, "
                              f"'{c}' AS column_name, count({c}) AS filled FROM {source}" for f, c in pairs.items())


@query("alias_mapping", " UNION ALL ".join([
    _filled("customer", "customers", {"name": "c_name", "segment": "c_mktsegment"}),
    _filled("supplier", "suppliers", {"name": "s_name"}),
    _filled("part", "inventory", {"name": "p_name"}),
    _filled("orders", "sales_invoices", {"invoice_date": "o_orderdate", "amount": "o_totalprice", "status": "o_orderstatus"}),
    _filled("lineitem", "supplier_invoices", {"invoice_date": "l_shipdate", "gst_amount": "l_tax", "status": "l_linestatus",
                                              "quantity": "l_quantity"}),
]))
def q_alias_mapping(c: Ctx):
    """Field mapping of every table by column aliases, with the filled rows of each mapped column."""
    return _all([M.mapped_counts(getattr(c.t, t), t, d) for t, d in SOURCES.items()])


@query("required_field_gate", """
SELECT 'customer' AS source, 'customers' AS document_type, '' AS missing, count(*) AS accepted, 0::BIGINT AS rejected FROM customer
UNION ALL SELECT 'supplier', 'suppliers', '', count(*), 0 FROM supplier
UNION ALL SELECT 'part', 'inventory', '', count(*), 0 FROM part
UNION ALL SELECT 'orders', 'sales_invoices', 'invoice_number', 0, count(*) FROM orders
UNION ALL SELECT 'lineitem', 'supplier_invoices', 'invoice_number,amount', 0, count(*) FROM lineitem
UNION ALL SELECT 'events', 'bank_statements', 'description', 0, count(*) FROM events""")
def q_required_field_gate(c: Ctx):
    """Rows accepted, or held back because a required field has no column."""
    return _all([M.gate(getattr(c.t, t), t, d) for t, d in SOURCES.items()])


@query("row_reject_capture", """
SELECT 'orders' AS source, 'sales_invoices' AS document_type, 'Missing required mappings: invoice_number' AS issue, count(*) AS rows_rejected FROM orders
UNION ALL SELECT 'lineitem', 'supplier_invoices', 'Missing required mappings: invoice_number, amount', count(*) FROM lineitem
UNION ALL SELECT 'events', 'bank_statements', 'Missing required mappings: description', count(*) FROM events""")
def q_row_reject_capture(c: Ctx):
    """Rejected rows with the issue that held them back."""
    g = _all([M.gate(getattr(c.t, t), t, d) for t, d in SOURCES.items()]).filter("missing <> ''")
    issue = F.concat(F.lit("Missing required mappings: "), F.regexp_replace("missing", ",", ", "))
    return g.select("source", "document_type", issue.alias("issue"), F.col("rejected").alias("rows_rejected"))


def _record_sql(table: str, document_type: str, name: str, group: str) -> str:
    return (f"SELECT '{document_type}' AS document_type, 'lf-{document_type}-' || substr(sha1(lower(trim({name}))), 1, 16) AS record_id, "
            f"lower(trim({name})) AS business_key, {name} AS name, {group} AS group_name, '{M.DEFAULT_STATUS}' AS status, "
            f"0.0::DOUBLE AS quantity, 0.0::DOUBLE AS value FROM {table}")


@query("apply_mapping", " UNION ALL ".join([
    _record_sql("customer", "customers", "c_name", "c_mktsegment"), _record_sql("supplier", "suppliers", "s_name", "''"),
    _record_sql("part", "inventory", "p_name", "''")]))
def q_apply_mapping(c: Ctx):
    """Every row of the accepted tables as a record with its business key and stable id."""
    records = _all([M.apply_mapping(getattr(c.t, t), d) for t, d in SOURCES.items()])
    return records.select("document_type", "record_id", "business_key", "name", "group_name", "status", "quantity", "value")


@query("manual_mapping_apply", " UNION ALL ".join([
    "SELECT 'sales_invoices' AS document_type, o_orderkey || '|' || o_custkey AS business_key, "
    "'lf-sales_invoices-' || substr(sha1(o_orderkey || '|' || o_custkey), 1, 16) AS record_id, o_orderstatus AS status FROM orders"]))
def q_manual_mapping_apply(c: Ctx):
    """Orders as sales invoices once a person has mapped the invoice number and the party."""
    manual = M.mapping_of(c.t.orders.columns, "sales_invoices") | {"invoice_number": "o_orderkey", "supplier": "o_custkey"}
    return M.apply_mapping(c.t.orders, "sales_invoices", manual).select("document_type", "business_key", "record_id", "status")
