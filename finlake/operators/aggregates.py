"""Aggregations. Each is a single pass of conditional aggregates (map-side partial
aggregation, one shuffle on the grouping key at most); money sums stay decimal until the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import contains_any, first_keyword_class, out_money
from .filters import CLOSED_STATUSES


def sum_when(cond: F.Column, value: F.Column) -> F.Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0)))


def monthly_flow(txn: DataFrame) -> DataFrame:
    """month -> revenue (sum of inflows), expenses (sum of outflows, positive)."""
    a = F.col("amount")
    return (txn.groupBy("company_id", F.date_format("transaction_date", "yyyy-MM").alias("month"))
            .agg(sum_when(a > 0, a).alias("revenue"), sum_when(a < 0, -a).alias("expenses")))


def position_totals(al: DataFrame) -> DataFrame:
    """Statement-basis position in one pass (the reference runs six scans)."""
    cat, cls, n, a = F.col("category"), F.col("classification"), F.lower(F.col("name")), F.col("amount")
    asset = cat == "asset"
    return al.groupBy("company_id").agg(
        sum_when(asset & (cls == "current"), a).alias("current_assets"),
        sum_when((cat == "liability") & (cls == "current"), a).alias("current_liabilities"),
        sum_when(asset & n.contains("inventory"), a).alias("inventory"),
        sum_when(asset & ((F.col("id") == "asset-cash") | n.contains("cash")), a).alias("cash"),
        sum_when(asset, a).alias("total_assets"),
        sum_when(cat == "liability", a).alias("total_liabilities"),
    )


def ledger_values(tb: DataFrame) -> DataFrame:
    """Posted-ledger position from the trial balance (same rules as the Accounts page)."""
    t, s, n = F.col("account_type"), F.lower(F.col("subtype")), F.lower(F.col("name"))
    b = F.col("balance").cast("decimal(18,2)")
    return tb.groupBy("company_id").agg(
        F.sum("posted_lines").alias("posted_lines"),
        sum_when((t == "asset") & s.contains("current") & ~s.contains("non-current"), b).alias("current_assets"),
        sum_when((t == "liability") & s.contains("current") & ~s.contains("non-current"), b).alias("current_liabilities"),
        sum_when((t == "asset") & n.contains("inventory"), b).alias("inventory"),
        sum_when((t == "asset") & (n.contains("cash") | n.contains("bank")), b).alias("cash"),
        sum_when(t == "asset", b).alias("total_assets"),
        sum_when(t == "liability", b).alias("total_liabilities"),
        sum_when(t == "revenue", b).alias("revenue"),
        sum_when(t == "expense", b).alias("expenses"),
    )


def invoice_exposure(inv: DataFrame, as_of: str) -> DataFrame:
    """Receivables vs payables: open and overdue totals (absolute)."""
    open_ = ~F.col("status").isin(*CLOSED_STATUSES)
    overdue = open_ & (F.col("due_date") < F.lit(as_of).cast("date"))
    label = F.when(F.col("invoice_kind") == "sales", "Receivables").otherwise("Payables")
    return (inv.groupBy("company_id", label.alias("label"))
            .agg(out_money(F.abs(sum_when(open_, F.col("amount")))).alias("open"),
                 out_money(F.abs(sum_when(overdue, F.col("amount")))).alias("overdue")))


def latest_period(df: DataFrame, period_col: str, keys=("company_id",)) -> DataFrame:
    """Rows at the maximum period per key (semi-join against a per-key max; no global window)."""
    mx = df.groupBy(*keys).agg(F.max(period_col).alias(period_col))
    return df.join(mx, [*keys, period_col], "left_semi")


def profit_structure(stm: DataFrame) -> DataFrame:
    """Latest P&L period -> Revenue, Cost of goods, Operating costs, Finance & tax, Net profit."""
    pl = latest_period(stm.filter(F.col("statement_type") == "profit_loss"), "period_end")
    a, li = F.col("amount"), F.lower(F.col("line_item"))
    cogs_c = contains_any(li, R.COGS_TOKENS)
    fin_c = contains_any(li, R.FINANCE_TAX_TOKENS) & (a < 0)
    agg = pl.groupBy("company_id", "period_end").agg(
        sum_when(a > 0, a).alias("revenue"), F.abs(sum_when(a < 0, a)).alias("costs"),
        F.abs(sum_when(cogs_c, a)).alias("cogs"), F.abs(sum_when(fin_c, a)).alias("fin"))
    operating = F.greatest(F.lit(0), F.col("costs") - F.col("cogs") - F.col("fin"))
    return agg.select("company_id", "period_end", F.stack(
        F.lit(5),
        F.lit("Revenue"), out_money("revenue"),
        F.lit("Cost of goods"), out_money("cogs"),
        F.lit("Operating costs"), out_money(operating),
        F.lit("Finance & tax"), out_money("fin"),
        F.lit("Net profit"), out_money(F.col("revenue") - F.col("costs")),
    ).alias("label", "value"))


def duplicate_invoice_numbers(inv: DataFrame) -> DataFrame:
    """Invoice numbers used more than once: count, total, last record id (max id)."""
    return (inv.groupBy("company_id", "invoice_number")
            .agg(F.count("*").alias("count"), F.sum("amount").alias("total"), F.max("id").alias("target_id"))
            .filter(F.col("count") > 1)
            .select("company_id", "invoice_number", F.col("count").cast("bigint").alias("count"), out_money("total").alias("total"),
                    "target_id"))


def channel_of(text: F.Column) -> F.Column:
    return first_keyword_class(F.lower(text), R.CHANNEL_RULES, R.CHANNEL_DEFAULT)


def receipt_source_of(text: F.Column) -> F.Column:
    return first_keyword_class(F.lower(text), R.RECEIPT_SOURCE_RULES, R.RECEIPT_SOURCE_DEFAULT)


def department_of(text: F.Column) -> F.Column:
    return first_keyword_class(F.lower(text), R.DEPARTMENT_RULES, R.DEPARTMENT_DEFAULT)
