"""Sink queries: products written to shared storage and read back (mart metric table, Silver)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..context import Ctx
from ..functions.expr import out_money
from ..oracle.views import with_views as W
from ..registry import query
from ..session import checkpoint_dir
from ..sources import sinks as SK
from . import domains as D
from .queries_domains import REGISTER_SQL


def _area(c: Ctx, name: str) -> str:
    return f"{checkpoint_dir(c.spark).rstrip('/')}/finlake-sinks/{name}/{uuid.uuid4().hex}"


@query("mart_metrics", W("o_snapshot", "v_payroll", "v_profiles") + REGISTER_SQL + """
, hr AS (SELECT company_id, CAST(count(*) AS DOUBLE) AS headcount, round(CAST(sum(gross_pay) AS DOUBLE), 2) AS gross_pay
         FROM reg GROUP BY 1)
SELECT 'finance' AS department, 'Available cash' AS metric, cash AS value_numeric FROM o_snapshot
UNION ALL SELECT 'finance', 'Current ratio', current_ratio FROM o_snapshot
UNION ALL SELECT 'finance', 'Monthly revenue', revenue_month FROM o_snapshot
UNION ALL SELECT 'finance', 'Open invoices', open_invoice_total FROM o_snapshot
UNION ALL SELECT 'people', 'Headcount', headcount FROM hr
UNION ALL SELECT 'people', 'Gross pay', gross_pay FROM hr""")
def q_mart_metrics(c: Ctx):
    """Long department metric table (department, metric, value) published as a mart and read back."""
    s = c.snapshot.select(F.stack(
        F.lit(4), F.lit("Available cash"), F.col("cash"), F.lit("Current ratio"), F.col("current_ratio"),
        F.lit("Monthly revenue"), F.col("revenue_month"), F.lit("Open invoices"), F.col("open_invoice_total"),
    ).alias("metric", "value_numeric")).withColumn("department", F.lit("finance"))
    h = D.hr_summary(D.payroll_register(c.payroll, c.profiles)).select(F.stack(
        F.lit(2), F.lit("Headcount"), F.col("headcount").cast("double"), F.lit("Gross pay"), F.col("gross_pay"),
    ).alias("metric", "value_numeric")).withColumn("department", F.lit("people"))
    root = _area(c, "mart")
    paths = SK.mart_publish({"department_metrics": s.unionByName(h).select("department", "metric", "value_numeric")}, root)
    return c.spark.read.parquet(paths["department_metrics"])


@query("silver_roundtrip", W("v_supplier_invoices") + """
SELECT id, invoice_number, supplier, invoice_date, round(CAST(amount AS DOUBLE), 2) AS amount FROM v_supplier_invoices""")
def q_silver_roundtrip(c: Ctx):
    """Invoices written to Silver (zstd parquet partitioned by document type) and read back for one
    document type; the filter prunes the other partition at planning time."""
    path = _area(c, "silver")
    inv = c.invoices.withColumn("document_type", F.concat(F.col("invoice_kind"), F.lit("_invoices")))
    SK.silver_write(inv.select("id", "invoice_number", "supplier", "invoice_date", "amount", "document_type"), path)
    back = SK.silver_read(c.spark, path, ["supplier_invoices"])
    return back.select("id", "invoice_number", "supplier", "invoice_date", out_money("amount").alias("amount"))
