"""Domain data products: HR, inventory, tax/BAS, marketing, money map, market.

Each product is a DataFrame function over the canonical tables. Large inputs are aggregated to
their output grain (employee, SKU, channel, department, entity) before any join, so joins only see
pre-aggregated, key-unique sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import params as P
from ..context import Ctx
from ..functions import rules as R
from ..functions.expr import MONEY, contains_any, first_number, out_money
from ..operators import aggregates as AG
from ..operators import windows as WN


def _d(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# ----------------------------------------------------------------------------- HR

def latest_payroll(pay: DataFrame) -> DataFrame:
    """Pay lines of the latest pay month per company."""
    p = pay.withColumn("month", F.substring("pay_period", 1, 7))
    return AG.latest_period(p, "month")


def payroll_register(pay: DataFrame, profiles: DataFrame, super_rate: float = R.SUPER_RATE) -> DataFrame:
    """Latest-month payroll per employee (aggregated first) LEFT JOIN profiles; super check."""
    lp = latest_payroll(pay).groupBy("company_id", "employee").agg(
        F.sum("gross_pay").alias("gross_pay"), F.sum("payg_withholding").alias("payg_withholding"),
        F.sum("superannuation").alias("superannuation"), F.sum("net_pay").alias("net_pay"),
        F.max("currency").alias("currency"), F.max("source_file").alias("source_file"))
    j = lp.join(profiles.drop("status").withColumnRenamed("employment_type", "employment_type"),
                ["company_id", "employee"], "left")
    expected = F.round(F.col("gross_pay") * F.lit(super_rate), 2).cast(MONEY)
    return j.select(
        "company_id", "employee", F.coalesce("employee_code", F.lit("")).alias("employee_code"),
        F.coalesce("department", F.lit("Unassigned")).alias("department"), F.coalesce("role", F.lit("")).alias("role_title"),
        F.coalesce("employment_type", F.lit("")).alias("employment_type"),
        "gross_pay", "payg_withholding", "superannuation", "net_pay", expected.alias("expected_super"),
        (F.col("superannuation") - expected).alias("super_gap"), "currency", "source_file")


def hr_department_costs(reg: DataFrame) -> DataFrame:
    return reg.groupBy("company_id", "department").agg(
        out_money(F.sum("gross_pay")).alias("gross_pay"), F.count("*").cast("bigint").alias("headcount"))


def hr_summary(reg: DataFrame) -> DataFrame:
    return reg.groupBy("company_id").agg(
        F.count("*").cast("bigint").alias("headcount"), out_money(F.sum("gross_pay")).alias("gross_pay"),
        out_money(F.sum("net_pay")).alias("net_pay"), out_money(F.sum("payg_withholding")).alias("payg_withholding"),
        out_money(F.sum("superannuation")).alias("superannuation"),
        F.count(F.when(F.abs("super_gap") > 0.02, 1)).cast("bigint").alias("open_actions"))


def employee_profile_fill(pay: DataFrame, profiles: DataFrame) -> DataFrame:
    """Payroll names without a profile get an ``EMP-nnn`` code (numbered after existing profiles in
    name order) and evidence mode ``payroll_only``; invented roles/leave are not generated."""
    missing = pay.select("company_id", "employee").distinct().join(profiles.select("company_id", "employee"),
                                                                   ["company_id", "employee"], "left_anti")
    base = profiles.groupBy("company_id").agg(F.count("*").alias("n_existing"))
    return (WN.ordinal(missing, ["company_id"], "employee", "_i").join(base, "company_id", "left")
            .withColumn("seq", F.coalesce("n_existing", F.lit(0)) + F.col("_i"))
            .select("company_id", "employee", F.concat(F.lit("EMP-"), F.lpad(F.col("seq").cast("string"), 3, "0")).alias("employee_code"),
                    F.lit("Unassigned").alias("department"), F.lit("payroll_only").alias("evidence_mode")))


# ----------------------------------------------------------------------------- inventory

def filename_snapshot_date(source_file: F.Column) -> F.Column:
    """``<d><Mon><yyyy>`` inside a file name, e.g. stock_31Dec1997.xlsx -> 1997-12-31."""
    m = F.regexp_extract(source_file, r"(?i)(\d{1,2}(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\d{4})", 1)
    return F.try_to_date(F.nullif(m, F.lit("")), "dMMMyyyy")


def reorder_defaults(inventory: DataFrame) -> DataFrame:
    """Default reorder settings by position in SKU order within the company: reorder point =
    qty x (1.12 every 7th item, else 0.28), target = max(1.35 qty, 1.8 reorder), lead 14/21/30."""
    q = F.col("quantity")
    inv = WN.ordinal(inventory.filter(F.coalesce(F.col("sku"), F.lit("")) != ""), ["company_id"], "sku", "_p")
    inv = inv.withColumn("_i", F.col("_p") - 1)
    rp = F.round(q * F.when(F.pmod("_i", F.lit(7)) == 0, 1.12).otherwise(0.28), 2)
    return inv.select(
        "company_id", "sku", rp.alias("reorder_point"),
        F.round(F.greatest(q * 1.35, rp * 1.8), 2).alias("target_stock"),
        F.element_at(F.array(F.lit(14), F.lit(21), F.lit(30)), (F.pmod("_i", F.lit(3)) + 1).cast("int")).alias("lead_time_days"),
        F.lit("Use supplier master").alias("preferred_supplier"))


def stock_cutoffs(inventory: DataFrame) -> DataFrame:
    """Latest stock-count date per company, parsed from the inventory source file names."""
    return inventory.groupBy("company_id").agg(F.max(filename_snapshot_date(F.col("source_file"))).alias("cutoff"))


def inventory_movements_build(invoices: DataFrame, inventory: DataFrame) -> DataFrame:
    """Invoice lines with SKU and quantity become stock movements; only lines dated after the
    stock-count cutoff are applied (earlier ones are already in the count). Item name comes from
    the inventory register (left join on SKU), else the invoice description."""
    lines = invoices.filter((F.coalesce(F.col("sku"), F.lit("")) != "") & (F.coalesce(F.col("quantity"), F.lit(0.0)) != 0))
    names = inventory.groupBy("company_id", "sku").agg(F.min("name").alias("inv_name"))
    signed = F.abs("quantity") * F.when(F.col("invoice_kind") == "sales", -1.0).otherwise(1.0)
    applied = F.col("cutoff").isNull() | (F.col("invoice_date") > F.col("cutoff"))
    lines = lines.join(stock_cutoffs(inventory), "company_id", "left")
    return lines.join(names, ["company_id", "sku"], "left").select(
        "company_id", F.concat(F.lit("invoice-movement-"), F.col("id")).alias("id"),
        F.col("invoice_date").alias("movement_date"), "sku",
        F.coalesce("inv_name", F.nullif(F.col("description"), F.lit("")), F.col("sku")).alias("item_name"),
        F.when(signed < 0, "sale").otherwise("purchase").alias("movement_type"),
        signed.alias("signed_quantity"), F.col("invoice_number").alias("source_invoice"), "source_file",
        F.lit("invoice_line").alias("evidence_mode"), applied.alias("applied_to_stock"))


def inventory_apply(inventory: DataFrame, movements: DataFrame) -> DataFrame:
    """Stock after applying movements: quantity + sum of applied signed quantities per SKU
    (aggregated per SKU first); unknown SKUs with net purchases are added."""
    mv = (movements.filter("applied_to_stock").groupBy("company_id", "sku")
          .agg(F.sum("signed_quantity").alias("delta"), F.max("item_name").alias("mv_name")))
    j = inventory.join(mv, ["company_id", "sku"], "full")
    qty = F.coalesce("quantity", F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))
    cost = F.coalesce("unit_cost", F.lit(0).cast(MONEY))
    out = j.filter(F.col("quantity").isNotNull() | (F.col("delta") > 0)).select(
        "company_id", "sku", F.coalesce("name", "mv_name").alias("name"), qty.alias("quantity"), cost.alias("unit_cost"),
        F.coalesce("location", F.lit("Unassigned")).alias("location"), F.coalesce("status", F.lit("active")).alias("status"),
        "source_file")
    return out.withColumn("total_value", F.round(F.col("quantity") * _d("unit_cost"), 2))


def inventory_register(c: Ctx) -> DataFrame:
    inv = c.inventory
    settings = reorder_defaults(inv)
    moved = inventory_apply(inv, inventory_movements_build(c.invoices, inv))
    j = moved.join(settings, ["company_id", "sku"], "left")
    rp = F.coalesce("reorder_point", F.lit(0.0))
    state = F.when(F.col("quantity") <= rp, "reorder").when(F.col("quantity") <= rp * R.REORDER_WATCH_FACTOR, "watch").otherwise("healthy")
    return j.select(
        "company_id", "sku", "name", F.round("quantity", 2).alias("quantity"), out_money("unit_cost").alias("unit_cost"),
        F.round("total_value", 2).alias("total_value"), "location", "status", rp.alias("reorder_point"),
        F.coalesce("target_stock", F.lit(0.0)).alias("target_stock"),
        F.coalesce("lead_time_days", F.lit(0)).alias("lead_time_days"), state.alias("stock_state"),
        F.round(F.greatest(F.lit(0.0), F.coalesce("target_stock", F.lit(0.0)) - F.col("quantity")), 2).alias("suggested_order"))


def inventory_summary(reg: DataFrame, movements: DataFrame) -> DataFrame:
    mv = movements.groupBy("company_id").agg(
        F.count(F.when(F.coalesce(F.col("source_invoice"), F.lit("")) != "", 1)).cast("bigint").alias("invoice_linked_movements"),
        F.count(F.when(F.col("applied_to_stock"), 1)).cast("bigint").alias("auto_applied_movements"))
    s = reg.groupBy("company_id").agg(
        F.count("*").cast("bigint").alias("sku_count"), F.round(F.sum("quantity"), 2).alias("units_on_hand"),
        F.round(F.sum("total_value"), 2).alias("inventory_value"),
        F.count(F.when(F.col("stock_state") == "reorder", 1)).cast("bigint").alias("reorder_count"))
    return s.join(mv, "company_id", "left")


# ----------------------------------------------------------------------------- tax / BAS

def bas_labels(c: Ctx, gst_registered: bool = P.GST_REGISTERED) -> DataFrame:
    cl = c.classified.filter(F.col("c_validation") == "approved")
    sales = F.col("invoice_kind") == "sales"
    inv = cl.groupBy("company_id").agg(
        AG.sum_when(sales, F.col("amount")).alias("sales_total"), AG.sum_when(sales, F.col("gst")).alias("sales_gst"),
        AG.sum_when(~sales, F.col("amount")).alias("purchase_total"), AG.sum_when(~sales, F.col("gst")).alias("purchase_gst"))
    pay = latest_payroll(c.payroll).groupBy("company_id").agg(
        F.sum("gross_pay").alias("w1"), F.sum("payg_withholding").alias("w2"))
    j = inv.join(pay, "company_id", "left")
    reg = F.lit(gst_registered)
    g1 = F.when(reg, F.col("sales_total")).otherwise(F.lit(0))
    one_a = F.when(reg, F.col("sales_gst")).otherwise(F.lit(0))
    one_b = F.when(reg, F.col("purchase_gst")).otherwise(F.lit(0))
    return j.select(
        "company_id", out_money(g1).alias("G1"), out_money(one_a).alias("1A"), out_money(one_b).alias("1B"),
        out_money(F.coalesce("w1", F.lit(0))).alias("W1"), out_money(F.coalesce("w2", F.lit(0))).alias("W2"),
        out_money(one_a - one_b).alias("net_gst"), out_money("purchase_total").alias("purchase_total"),
        out_money("sales_total").alias("sales_total"))


def payroll_period_totals(pay: DataFrame) -> DataFrame:
    lp = latest_payroll(pay)
    return lp.groupBy("company_id", F.col("month").alias("period")).agg(
        out_money(F.sum("gross_pay")).alias("gross_pay"), out_money(F.sum("payg_withholding")).alias("payg_withholding"))


def tax_review_counts(c: Ctx) -> DataFrame:
    """Five review counters in one pass over the classified invoices."""
    cl = c.classified
    kind, code = F.col("invoice_kind"), F.col("c_account_code")
    return cl.groupBy("company_id").agg(
        F.count(F.when(F.col("c_validation") != "approved", 1)).cast("bigint").alias("unresolved"),
        F.count(F.when((kind != "sales") & (F.col("c_tax_code") == "REVIEW"), 1)).cast("bigint").alias("missing_gst"),
        F.count(F.when(code == "1500", 1)).cast("bigint").alias("capital_review"),
        F.count(F.when(code == "6190", 1)).cast("bigint").alias("entertainment_review"),
        F.count(F.when(F.coalesce(F.col("source_file"), F.lit("")) == "", 1)).cast("bigint").alias("evidence_missing"))


def tax_review_items(c: Ctx) -> DataFrame:
    """Conditional review items (stack of the counters), or a single 'none' row."""
    t = tax_review_counts(c)
    items = t.select("company_id", F.stack(
        F.lit(5),
        F.lit("Review missing GST treatment"), F.col("missing_gst"), F.lit("review"),
        F.lit("Review capital purchases"), F.col("capital_review"), F.lit("review"),
        F.lit("Review entertainment and FBT"), F.col("entertainment_review"), F.lit("review"),
        F.lit("Resolve uncategorised invoices"), F.col("unresolved"), F.lit("high"),
        F.lit("Attach missing source evidence"), F.col("evidence_missing"), F.lit("review"),
    ).alias("title", "count", "status")).filter(F.col("count") > 0)
    any_item = items.groupBy("company_id").agg(F.count("*").alias("n"))
    none = t.select("company_id").join(any_item, "company_id", "left_anti").select(
        "company_id", F.lit("No obvious exceptions detected").alias("title"), F.lit(0).cast("bigint").alias("count"),
        F.lit("ready").alias("status"))
    return items.unionByName(none)


def business_signals(c: Ctx) -> DataFrame:
    cl = c.classified.groupBy("company_id").agg(
        F.count(F.when(F.col("c_account_code") == "1500", 1)).cast("bigint").alias("capital_invoice_count"),
        F.count(F.when(F.col("c_tax_code") == "REVIEW", 1)).cast("bigint").alias("gst_review_rows"),
        out_money(AG.sum_when(F.lower(F.col("c_account_name")).contains("software"), F.col("amount"))).alias("software_spend"))
    inv = c.inventory.groupBy("company_id").agg(out_money(F.sum("total_value")).alias("inventory_value"))
    pay = c.payroll.groupBy("company_id").agg(F.count("*").cast("bigint").alias("payroll_rows"))
    return cl.join(inv, "company_id", "left").join(pay, "company_id", "left")


def tax_position(c: Ctx, rate: float = P.INCOME_TAX_RATE) -> DataFrame:
    """Profit basis (posted ledger vs latest P&L when posted revenue < 75 % of it), taxable income,
    estimated tax, confidence and the GST control reconciliation difference."""
    from .queries_core import account_type_summary

    acc = account_type_summary(c).select("company_id", 
        F.col("profit").alias("acct_profit"), F.abs("revenue").alias("posted_revenue"),
        (F.col("gst_payable") - F.col("gst_receivable")).alias("gst_control"))
    pl = AG.latest_period(c.statements.filter(F.col("statement_type") == "profit_loss"), "period_end").groupBy("company_id").agg(
        F.round(_d(F.sum("amount")), 2).alias("statement_profit"),
        F.abs(F.round(_d(AG.sum_when(F.col("amount") > 0, F.col("amount"))), 2)).alias("statement_revenue"),
        F.max("period_end").alias("period_end"))
    bas = bas_labels(c).select("company_id", "net_gst")
    rc = tax_review_counts(c).select("company_id", "unresolved")
    j = (pl.join(bas, "company_id").join(rc, "company_id")
         .join(acc, "company_id"))
    partial = (F.col("statement_revenue") > 0.005) & (F.col("posted_revenue") < F.col("statement_revenue") * 0.75)
    use_stmt = (F.abs("statement_profit") > 0.005) & ((F.abs("acct_profit") < 0.005) | partial)
    profit = F.when(use_stmt, F.col("statement_profit")).otherwise(F.col("acct_profit"))
    taxable = F.greatest(F.lit(0.0), profit)
    return j.select(
        "company_id", F.round(profit, 2).alias("accounting_profit"),
        F.when(use_stmt, "latest_profit_loss").otherwise("posted_journals").alias("profit_basis"),
        F.round(taxable, 2).alias("estimated_taxable_income"),
        F.round(taxable * rate / 100, 2).alias("estimated_income_tax"),
        F.when(F.col("unresolved") > 0, "low").otherwise("medium").alias("confidence"),
        F.round(F.col("gst_control") - F.col("net_gst"), 2).alias("gst_reconciliation_difference"))


# ----------------------------------------------------------------------------- marketing

def channel_spend(c: Ctx) -> DataFrame:
    """Approved 6150 invoice spend by channel; share of total spend (ledger 6150 balance when
    posted, else invoice evidence)."""
    from ..operators.filters import marketing_invoices

    mk = marketing_invoices(c.classified)
    ch = mk.groupBy("company_id", AG.channel_of(F.concat_ws(" ", F.coalesce("supplier", F.lit("")),
                                                             F.coalesce("description", F.lit("")))).alias("channel")) \
        .agg(F.sum(F.abs("amount")).alias("amt"))
    inv_spend = mk.groupBy("company_id").agg(F.sum(F.abs("amount")).alias("inv_spend"))
    ledger = c.trial_balance.filter(F.col("code") == "6150").select("company_id", F.col("balance").alias("ledger_spend"))
    tot = inv_spend.join(ledger, "company_id", "left").select(
        "company_id", F.when(F.coalesce("ledger_spend", F.lit(0.0)) > 0.01, _d("ledger_spend")).otherwise(_d("inv_spend")).alias("spend"))
    return ch.join(tot, "company_id").select(
        "company_id", "channel", out_money("amt").alias("spend"),
        F.when(F.col("spend") != 0, F.round(_d("amt") / F.col("spend") * 100, 1)).otherwise(F.lit(0.0)).alias("share"),
        F.lit("review").alias("status"))


def month_spend_allocation(c: Ctx, months: int = 6, min_months: int = 4) -> DataFrame:
    """Marketing spend apportioned to the last months by revenue share (only with >= 4 observed
    months; otherwise no trend rows)."""
    spend = channel_spend(c).groupBy("company_id").agg(F.sum("spend").alias("spend"))
    lm = WN.last_n_months(AG.monthly_flow(c.transactions), months).filter(
        (F.abs("revenue") > 0.01) | (F.abs("expenses") > 0.01))
    w = Window.partitionBy("company_id")
    lm = lm.withColumn("n_obs", F.count("*").over(w)).withColumn(
        "tot", F.sum(F.greatest(F.lit(0.0), F.col("revenue"))).over(w)).filter(F.col("n_obs") >= min_months)
    j = lm.join(spend, "company_id", "left")
    tot = F.when(F.col("tot") != 0, F.col("tot")).otherwise(F.lit(1.0))
    return j.select("company_id", "month", "revenue",
                    F.round(F.coalesce("spend", F.lit(0.0)) * F.greatest(F.lit(0.0), F.col("revenue")) / tot, 2).alias("marketing_spend"))


# ----------------------------------------------------------------------------- money map

def receipt_sources(bank: DataFrame) -> DataFrame:
    month = F.date_format("transaction_date", "yyyy-MM")
    b = bank.withColumn("m", month)
    latest = AG.latest_period(b, "m").filter(F.col("amount") > 0)
    return latest.groupBy("company_id", AG.receipt_source_of(F.col("description")).alias("name")).agg(
        out_money(F.sum("amount")).alias("value"))


def department_costs_flow(stm: DataFrame) -> DataFrame:
    pl = AG.latest_period(stm.filter(F.col("statement_type") == "profit_loss"), "period_end").filter(F.col("amount") < 0)
    return pl.groupBy("company_id", AG.department_of(F.col("line_item")).alias("name")).agg(
        out_money(F.abs(F.sum("amount"))).alias("value"))


def money_map(c: Ctx) -> tuple[DataFrame, DataFrame]:
    """Money flow summary (one row) and links (source -> hub -> department / profit -> tax / retained)."""
    src = receipt_sources(c.bank)
    dep = department_costs_flow(c.statements)
    pl = AG.latest_period(c.statements.filter(F.col("statement_type") == "profit_loss"), "period_end").groupBy("company_id").agg(
        _d(AG.sum_when(F.col("amount") > 0, F.col("amount"))).alias("stmt_rev"))
    src_tot = src.groupBy("company_id").agg(F.sum("value").alias("src_tot"))
    dep_tot = dep.groupBy("company_id").agg(F.sum("value").alias("costs"))
    tax = tax_position(c).select("company_id", "estimated_income_tax")
    s = (pl.join(src_tot, "company_id", "full").join(dep_tot, "company_id", "left").join(tax, "company_id", "left"))
    revenue = F.when(F.coalesce("stmt_rev", F.lit(0.0)) != 0, F.col("stmt_rev")).otherwise(F.coalesce("src_tot", F.lit(0.0)))
    s = s.select("company_id", revenue.alias("revenue"), F.coalesce("costs", F.lit(0.0)).alias("costs"),
                 F.coalesce("estimated_income_tax", F.lit(0.0)).alias("itax"))
    pre = F.greatest(F.lit(0.0), F.col("revenue") - F.col("costs"))
    s = s.withColumn("pre_tax", pre).withColumn("tax_est", F.least(F.col("pre_tax"), F.col("itax")))
    summary = s.select(
        "company_id", F.round("revenue", 2).alias("revenue"), F.round("costs", 2).alias("operating_costs"),
        F.round("pre_tax", 2).alias("profit_before_tax"), F.round("tax_est", 2).alias("estimated_tax"),
        F.round(F.greatest(F.lit(0.0), F.col("pre_tax") - F.col("tax_est")), 2).alias("retained_profit"),
        F.when(F.col("revenue") != 0, F.round(F.col("pre_tax") / F.col("revenue") * 100, 1)).otherwise(F.lit(0.0))
        .alias("profit_margin_pct"))
    hub = F.lit("Revenue hub")
    links = (src.select("company_id", F.col("name").alias("source"), hub.alias("target"), "value")
             .unionByName(dep.select("company_id", hub.alias("source"), F.col("name").alias("target"), "value"))
             .unionByName(summary.select("company_id", hub.alias("source"), F.lit("Profit before tax").alias("target"),
                                         F.col("profit_before_tax").alias("value")))
             .unionByName(summary.filter((F.col("profit_before_tax") > 0) & (F.col("estimated_tax") > 0)).select(
                 "company_id", F.lit("Profit before tax").alias("source"), F.lit("Estimated income tax").alias("target"),
                 F.col("estimated_tax").alias("value")))
             .unionByName(summary.filter((F.col("profit_before_tax") > 0) & (F.col("retained_profit") > 0)).select(
                 "company_id", F.lit("Profit before tax").alias("source"), F.lit("Retained profit").alias("target"),
                 F.col("retained_profit").alias("value"))))
    return summary, links


# ----------------------------------------------------------------------------- market / competitors

DIMENSION_RULES = [
    ("Liquidity", ("current ratio", "liquidity", "working capital")),
    ("Margin strength", ("margin", "profitability", "gross profit")),
    ("Revenue momentum", ("growth", "revenue", "sales")),
    ("Cash resilience", ("cash", "runway", "resilience", "debt")),
]


def _clamp(x: F.Column) -> F.Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(140.0), x)), 1)


def _avg_tenths(total: F.Column, n: F.Column) -> F.Column:
    """round(total / n) half-up for non-negative integer totals, exact integer arithmetic."""
    from ..functions.expr import idiv

    return idiv(total * 2 + n, n * 2)


def competitor_dimensions(sig: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(company_id, entity, dimension, value) averages and the score of each company's entities (needs >= 2 dimensions)."""
    s = sig.filter(F.trim(F.coalesce("entity", F.lit(""))) != "").select(
        "company_id", F.trim("entity").alias("entity"),
        F.lower(F.concat_ws(" ", F.coalesce("signal_type", F.lit("")), F.coalesce("topic", F.lit("")))).alias("t"),
        first_number(F.col("value")).alias("v"))
    s = s.filter(F.col("v").isNotNull())
    from ..functions.expr import first_keyword_class

    dim = first_keyword_class(F.col("t"), DIMENSION_RULES, None)
    v = F.col("v")
    score = (F.when(F.col("dimension") == "Liquidity", _clamp(v / 1.2 * 100))
             .when(F.col("dimension") == "Margin strength", _clamp(v / 30.0 * 100))
             .when(F.col("dimension") == "Revenue momentum", _clamp(50 + v * 3.0))
             .otherwise(_clamp(v)))
    per = s.withColumn("dimension", dim).filter(F.col("dimension").isNotNull()).withColumn("score", score)
    # Averages of 1-dp scores are computed exactly in integer tenths (half-up), so the result does
    # not depend on the order in which partitions add doubles.
    tenths = F.round(F.col("score") * 10).cast("bigint")
    dims = per.groupBy("company_id", "entity", "dimension").agg(
        (_avg_tenths(F.sum(tenths), F.count("*")) / 10.0).alias("value"))
    entities = s.select("company_id", "entity").distinct()
    ent = dims.groupBy("company_id", "entity").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10).cast("bigint")).alias("t"))
    ranked = entities.join(ent, ["company_id", "entity"], "left").select(
        "company_id", "entity", F.coalesce("n", F.lit(0)).cast("bigint").alias("verified_dimensions"),
        F.when(F.coalesce("n", F.lit(0)) >= 2, _avg_tenths(F.col("t"), F.col("n")) / 10.0).alias("score"),
        F.when(F.coalesce("n", F.lit(0)) >= 2, "comparable").otherwise("more verified metrics required").alias("status"))
    return dims, ranked


def company_dimensions(snapshot: DataFrame) -> DataFrame:
    ratio = F.coalesce("current_ratio", F.lit(0.0))
    runway = F.coalesce(_d("cash_runway_days"), F.lit(0.0))
    return snapshot.select("company_id", F.stack(
        F.lit(4),
        F.lit("Liquidity"), _clamp(ratio / R.CURRENT_RATIO_TARGET * 100),
        F.lit("Cash resilience"), _clamp(runway / R.CASH_RUNWAY_TARGET_DAYS * 100),
        F.lit("Margin strength"), _clamp(F.coalesce("gross_margin", F.lit(0.0)) / 30.0 * 100),
        F.lit("Revenue momentum"), _clamp(50 + F.coalesce("revenue_change", F.lit(0.0)) * 3.0),
    ).alias("dimension", "value"))


def distinct_market_exposure(c: Ctx) -> DataFrame:
    """Sorted distinct supplier countries and customer countries (from the nation tables)."""
    t = c.t
    sup = t.supplier.join(t.nation, t.supplier.s_nationkey == t.nation.n_nationkey).select(F.col("n_name").alias("country"))
    cus = t.customer.join(t.nation, t.customer.c_nationkey == t.nation.n_nationkey).select(F.col("n_name").alias("country"))
    s = sup.distinct().select(F.lit("supplier").alias("side"), "country")
    c2 = cus.distinct().select(F.lit("customer").alias("side"), "country")
    return s.unionByName(c2)
