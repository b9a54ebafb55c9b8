"""Filters, aggregates, windows, top-k and the snapshot / forecast composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..context import Ctx
from ..functions.expr import out_money
from ..operators import aggregates as AG
from ..operators import filters as FL
from ..operators import windows as WN
from ..oracle.views import with_views as W
from ..registry import query
from . import snapshot as SN

AS_OF = P.AS_OF
INV_COLS = "id, invoice_number, supplier, invoice_date, due_date, round(CAST(amount AS DOUBLE), 2) AS amount, status"


def _inv_cols(df, *more):
    return df.select(*more, "id", "invoice_number", "supplier", "invoice_date", "due_date", out_money("amount").alias("amount"), "status")


# ----------------------------------------------------------------------------- filters

@query("open_invoices", W("v_invoices") + f"SELECT {INV_COLS} FROM v_invoices WHERE status NOT IN ('paid', 'cancelled')")
def q_open_invoices(c: Ctx):
    """Invoices not paid or cancelled (NULL status dropped)."""
    return _inv_cols(FL.open_invoices(c.invoices))


@query("overdue_invoices", W("v_invoices") + f"""SELECT {INV_COLS} FROM v_invoices
WHERE status NOT IN ('paid', 'cancelled') AND due_date < DATE '{AS_OF}'""")
def q_overdue_invoices(c: Ctx):
    """Open invoices past their due date at as_of."""
    return _inv_cols(FL.overdue_invoices(c.invoices, AS_OF))


@query("due_within", W("v_invoices") + f"""SELECT id, due_date, round(CAST(amount AS DOUBLE), 2) AS amount FROM v_invoices
WHERE status NOT IN ('paid', 'cancelled') AND due_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 90""")
def q_due_within(c: Ctx):
    """Open invoices due in the next 90 days."""
    return FL.due_within(c.invoices, AS_OF, 90).select("id", "due_date", out_money("amount").alias("amount"))


@query("recent_transactions", W("v_transactions") + f"""SELECT id, transaction_date, round(CAST(amount AS DOUBLE), 2) AS amount
FROM v_transactions WHERE transaction_date >= DATE '{AS_OF}' - 90""")
def q_recent_transactions(c: Ctx):
    """Transactions dated on or after as_of - 90 days."""
    return FL.recent_transactions(c.transactions, AS_OF, 90).select("id", "transaction_date", out_money("amount").alias("amount"))


@query("payment_schedule", W("v_invoices") + """SELECT invoice_number, supplier, invoice_date, due_date,
round(CAST(amount AS DOUBLE), 2) AS amount, status FROM v_invoices WHERE lower(status) NOT IN ('paid', 'cancelled', 'void')""")
def q_payment_schedule(c: Ctx):
    """Unpaid invoices for the payment schedule export."""
    return FL.payment_schedule(c.invoices).withColumn("amount", out_money("amount"))


@query("customer_statement", W("v_invoices") + """SELECT invoice_number, supplier, invoice_date, due_date,
round(CAST(amount AS DOUBLE), 2) AS amount, status FROM v_invoices WHERE contains(lower(supplier), 'customer#0000001')""")
def q_customer_statement(c: Ctx):
    """Statement rows for counterparties matching 'Customer#0000001' (case-insensitive substring)."""
    return FL.customer_statement(c.invoices, "Customer#0000001").withColumn("amount", out_money("amount"))


@query("gst_transaction_report", W("o_classified") + """SELECT invoice_number, supplier, invoice_date, due_date,
round(CAST(amount AS DOUBLE), 2) AS amount, round(CAST(total - gst AS DOUBLE), 2) AS subtotal,
round(CAST(gst AS DOUBLE), 2) AS gst_amount, c_tax_code AS tax_code, c_validation AS validation_status, source_file,
invoice_kind, c_account_code AS account_code FROM o_classified""")
def q_gst_transaction_report(c: Ctx):
    """Invoice tax columns for the GST report (12 columns)."""
    return c.classified.select(
        "invoice_number", "supplier", "invoice_date", "due_date", out_money("amount").alias("amount"),
        out_money("net").alias("subtotal"), out_money("gst").alias("gst_amount"), F.col("c_tax_code").alias("tax_code"),
        F.col("c_validation").alias("validation_status"), "source_file", "invoice_kind",
        F.col("c_account_code").alias("account_code"))


@query("inventory_count_sheet", W("v_inventory") + """SELECT sku, name, quantity, CAST(NULL AS DOUBLE) AS counted_quantity,
CAST(NULL AS DOUBLE) AS variance, round(CAST(unit_cost AS DOUBLE), 2) AS unit_cost, location, status FROM v_inventory""")
def q_inventory_count_sheet(c: Ctx):
    """Stock list with blank counted quantity and variance columns."""
    return c.inventory.select("sku", "name", "quantity", F.lit(None).cast("double").alias("counted_quantity"),
                              F.lit(None).cast("double").alias("variance"), out_money("unit_cost").alias("unit_cost"),
                              "location", "status")


@query("marketing_records_filter", W("o_classified") + """SELECT invoice_number, supplier, invoice_date,
round(CAST(amount AS DOUBLE), 2) AS amount, description, c_account_code AS account_code, c_account_name AS category,
c_validation AS validation_status, source_file FROM o_classified
WHERE c_account_code = '6150' OR contains(lower(description), 'marketing') OR contains(lower(description), 'advertis')
   OR contains(lower(description), 'google ads') OR contains(lower(description), 'facebook') OR contains(lower(description), 'instagram')""")
def q_marketing_records_filter(c: Ctx):
    """Marketing mart rows: account 6150 or a marketing word in the description."""
    return FL.marketing_records_filter(c.classified).select(
        "invoice_number", "supplier", "invoice_date", out_money("amount").alias("amount"), "description",
        F.col("c_account_code").alias("account_code"), F.col("c_account_name").alias("category"),
        F.col("c_validation").alias("validation_status"), "source_file")


@query("marketing_invoices", W("o_classified") + """SELECT supplier, description, round(CAST(amount AS DOUBLE), 2) AS amount,
invoice_date FROM o_classified WHERE c_account_code = '6150' AND c_validation = 'approved'""")
def q_marketing_invoices(c: Ctx):
    """Approved marketing-account invoices (the fixed form of the reference's status test)."""
    return FL.marketing_invoices(c.classified).select("supplier", "description", out_money("amount").alias("amount"), "invoice_date")


_BUCKET_SQL = """CASE
  WHEN category = 'asset' AND contains(lower(name), 'cash') THEN 'Cash'
  WHEN category = 'asset' AND contains(lower(name), 'receivable') THEN 'Receivables'
  WHEN category = 'asset' AND contains(lower(name), 'inventory') THEN 'Inventory'
  WHEN category = 'asset' AND classification = 'current' THEN 'Other current assets'
  WHEN category = 'asset' THEN 'Non-current assets'
  WHEN category = 'liability' AND classification = 'current' THEN 'Current liabilities'
  WHEN category = 'liability' THEN 'Non-current liabilities' ELSE 'Other' END"""


@query("position_bucket", W("v_assets_liabilities") + f"""SELECT id, name, category, classification,
round(CAST(amount AS DOUBLE), 2) AS amount, {_BUCKET_SQL} AS label FROM v_assets_liabilities""")
def q_position_bucket(c: Ctx):
    """Asset/liability register rows with their 8-way position label."""
    return FL.position_bucket(c.assets_liabilities).select("id", "name", "category", "classification",
                                                            out_money("amount").alias("amount"), "label")


@query("position_class_ledger", W("o_trial_balance") + """SELECT code,
account_type = 'asset' AND contains(lower(subtype), 'current') AND NOT contains(lower(subtype), 'non-current') AS is_current_asset,
account_type = 'liability' AND contains(lower(subtype), 'current') AND NOT contains(lower(subtype), 'non-current') AS is_current_liability,
account_type = 'asset' AND contains(lower(name), 'inventory') AS is_inventory,
account_type = 'asset' AND (contains(lower(name), 'cash') OR contains(lower(name), 'bank')) AS is_cash,
round(CAST(balance AS DOUBLE), 2) AS balance FROM o_trial_balance""")
def q_position_class_ledger(c: Ctx):
    """Trial-balance accounts with current/inventory/cash position flags."""
    return FL.position_class_ledger(c.trial_balance).select(
        "code", "is_current_asset", "is_current_liability", "is_inventory", "is_cash", "balance")


@query("register_search", W("v_inventory") + """SELECT sku, name, quantity, location FROM v_inventory
WHERE contains(lower(concat_ws(' ', coalesce(sku, ''), coalesce(name, ''), coalesce(location, ''))), 'blue')
  AND location = 'WH-1'""")
def q_register_search(c: Ctx):
    """Inventory register search: text 'blue' in sku/name/location, state WH-1."""
    return FL.register_search(c.inventory, ["sku", "name", "location"], "blue", "location", "WH-1").select(
        "sku", "name", "quantity", "location")


@query("signal_tiering", W("v_market_signals") + """SELECT id, relevance_score,
CASE WHEN coalesce(relevance_score, 0) >= 0.75 THEN 'high' WHEN coalesce(relevance_score, 0) >= 0.4 THEN 'medium'
ELSE 'watch' END AS tier FROM v_market_signals""")
def q_signal_tiering(c: Ctx):
    """Market signals tiered by relevance (>=0.75 high, >=0.4 medium, else watch)."""
    return FL.signal_tiering(c.signals).select("id", "relevance_score", "tier")


@query("signal_alert_status", W("v_market_signals") + """SELECT id,
coalesce(nullif(topic, ''), nullif(signal_type, ''), 'Uploaded market signal') AS name,
CASE WHEN coalesce(relevance_score, 0) >= 0.85 THEN 'critical' ELSE 'watch' END AS status,
coalesce(nullif(estimated_impact, ''), 'Linked to ' || coalesce(nullif(entity, ''), nullif(geography, ''), 'company context') || '.') AS impact,
coalesce(nullif(source_url, ''), '') AS url, coalesce(nullif(source_name, ''), 'uploaded market file') AS source,
relevance_score FROM v_market_signals""")
def q_signal_alert_status(c: Ctx):
    """Signal alert cards: critical at relevance >= 0.85, with text fallbacks."""
    return FL.signal_alert_status(c.signals)


@query("official_domain_filter", """SELECT page_id, url FROM (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1)) AS host FROM pages)
WHERE host = 'example.org' OR ends_with(host, '.example.org')""")
def q_official_domain_filter(c: Ctx):
    """Pages whose URL host is an allowed domain or a subdomain of one (allowed: example.org)."""
    return FL.official_domain_filter(c.t.pages, ["example.org"]).select("page_id", "url")


# ----------------------------------------------------------------------------- aggregates

@query("monthly_flow", W("o_monthly") + """SELECT company_id, month, round(CAST(revenue AS DOUBLE), 2) AS revenue,
round(CAST(expenses AS DOUBLE), 2) AS expenses FROM o_monthly""")
def q_monthly_flow(c: Ctx):
    """Monthly revenue (inflows) and expenses (outflows) from transactions."""
    return AG.monthly_flow(c.transactions).select("company_id", "month", out_money("revenue").alias("revenue"),
                                                  out_money("expenses").alias("expenses"))


@query("position_totals", W("v_assets_liabilities") + """SELECT company_id,
round(CAST(sum(CASE WHEN category = 'asset' AND classification = 'current' THEN amount ELSE 0 END) AS DOUBLE), 2) AS current_assets,
round(CAST(sum(CASE WHEN category = 'liability' AND classification = 'current' THEN amount ELSE 0 END) AS DOUBLE), 2) AS current_liabilities,
round(CAST(sum(CASE WHEN category = 'asset' AND contains(lower(name), 'inventory') THEN amount ELSE 0 END) AS DOUBLE), 2) AS inventory,
round(CAST(sum(CASE WHEN category = 'asset' AND (id = 'asset-cash' OR contains(lower(name), 'cash')) THEN amount ELSE 0 END) AS DOUBLE), 2) AS cash,
round(CAST(sum(CASE WHEN category = 'asset' THEN amount ELSE 0 END) AS DOUBLE), 2) AS total_assets,
round(CAST(sum(CASE WHEN category = 'liability' THEN amount ELSE 0 END) AS DOUBLE), 2) AS total_liabilities
FROM v_assets_liabilities GROUP BY company_id""")
def q_position_totals(c: Ctx):
    """Statement-basis current/total assets and liabilities, cash and inventory in one pass."""
    p = AG.position_totals(c.assets_liabilities)
    return p.select("company_id", *[out_money(x).alias(x) for x in p.columns if x != "company_id"])


@query("position_series", W("v_assets_liabilities") + f"""SELECT company_id, label, round(abs(CAST(sum(amount) AS DOUBLE)), 2) AS value,
CASE label WHEN 'Cash' THEN 1 WHEN 'Receivables' THEN 2 WHEN 'Inventory' THEN 3 WHEN 'Other current assets' THEN 4
WHEN 'Non-current assets' THEN 5 WHEN 'Current liabilities' THEN 6 WHEN 'Non-current liabilities' THEN 7 ELSE 8 END AS sort_order
FROM (SELECT company_id, {_BUCKET_SQL} AS label, amount FROM v_assets_liabilities) GROUP BY company_id, label HAVING abs(sum(amount)) > 0.005""")
def q_position_series(c: Ctx):
    """Position chart: bucket sums with a fixed display order, near-zero buckets dropped."""
    return SN.position_series(c)


@query("invoice_exposure", W("v_invoices") + f"""SELECT company_id, CASE WHEN invoice_kind = 'sales' THEN 'Receivables' ELSE 'Payables' END AS label,
round(abs(CAST(sum(CASE WHEN status NOT IN ('paid', 'cancelled') THEN amount ELSE 0 END) AS DOUBLE)), 2) AS open,
round(abs(CAST(sum(CASE WHEN status NOT IN ('paid', 'cancelled') AND due_date < DATE '{AS_OF}' THEN amount ELSE 0 END) AS DOUBLE)), 2) AS overdue
FROM v_invoices GROUP BY 1, 2""")
def q_invoice_exposure(c: Ctx):
    """Receivables and payables: open and overdue totals."""
    return AG.invoice_exposure(c.invoices, AS_OF)


@query("profit_structure", W("v_statements") + """, pl AS (
  SELECT * FROM v_statements s WHERE statement_type = 'profit_loss'
   AND period_end = (SELECT max(period_end) FROM v_statements x WHERE x.statement_type = 'profit_loss' AND x.company_id = s.company_id)),
a AS (
  SELECT company_id, period_end, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS revenue,
    abs(sum(CASE WHEN amount < 0 THEN amount ELSE 0 END)) AS costs,
    abs(sum(CASE WHEN contains(lower(line_item), 'cost of goods') OR contains(lower(line_item), 'cogs')
                   OR contains(lower(line_item), 'cost of sales') THEN amount ELSE 0 END)) AS cogs,
    abs(sum(CASE WHEN (contains(lower(line_item), 'interest') OR contains(lower(line_item), 'tax')) AND amount < 0 THEN amount ELSE 0 END)) AS fin
  FROM pl GROUP BY 1, 2)
SELECT company_id, period_end, 'Revenue' AS label, round(CAST(revenue AS DOUBLE), 2) AS value FROM a
UNION ALL SELECT company_id, period_end, 'Cost of goods', round(CAST(cogs AS DOUBLE), 2) FROM a
UNION ALL SELECT company_id, period_end, 'Operating costs', round(CAST(greatest(0, costs - cogs - fin) AS DOUBLE), 2) FROM a
UNION ALL SELECT company_id, period_end, 'Finance & tax', round(CAST(fin AS DOUBLE), 2) FROM a
UNION ALL SELECT company_id, period_end, 'Net profit', round(CAST(revenue - costs AS DOUBLE), 2) FROM a""")
def q_profit_structure(c: Ctx):
    """Latest P&L period split into revenue, COGS, operating costs, finance & tax and profit."""
    return AG.profit_structure(c.statements)


@query("duplicate_invoice_numbers", W("v_invoices") + """SELECT company_id, invoice_number, CAST(count(*) AS BIGINT) AS count,
round(CAST(sum(amount) AS DOUBLE), 2) AS total, max(id) AS target_id FROM v_invoices GROUP BY company_id, invoice_number HAVING count(*) > 1""")
def q_duplicate_invoice_numbers(c: Ctx):
    """Invoice numbers used more than once, with count, total and the last record id."""
    return AG.duplicate_invoice_numbers(c.invoices)


# ----------------------------------------------------------------------------- windows

@query("revenue_change", W("o_monthly") + """SELECT company_id, month, round(CAST(revenue AS DOUBLE), 2) AS revenue,
round(CAST(coalesce(lag(revenue) OVER w, revenue) AS DOUBLE), 2) AS previous_revenue,
CASE WHEN CAST(coalesce(lag(revenue) OVER w, revenue) AS DOUBLE) <> 0
     THEN round((CAST(revenue AS DOUBLE) - CAST(coalesce(lag(revenue) OVER w, revenue) AS DOUBLE))
                / CAST(coalesce(lag(revenue) OVER w, revenue) AS DOUBLE) * 100, 1) ELSE 0.0 END AS revenue_change
FROM o_monthly WINDOW w AS (PARTITION BY company_id ORDER BY month)""")
def q_revenue_change(c: Ctx):
    """Month-over-month revenue change against the previous present month (lag window)."""
    return WN.revenue_change(AG.monthly_flow(c.transactions))


@query("last_n_months", W("o_monthly") + """SELECT company_id, month, strftime(strptime(month || '-01', '%Y-%m-%d'), '%b') AS label,
round(CAST(revenue AS DOUBLE), 2) AS revenue, round(CAST(expenses AS DOUBLE), 2) AS expenses
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS rn FROM o_monthly) WHERE rn <= 6""")
def q_last_n_months(c: Ctx):
    """Performance series: the latest 6 present months with month labels."""
    return WN.last_n_months(AG.monthly_flow(c.transactions), 6)


# ----------------------------------------------------------------------------- top-k

@query("top_positions", W("v_assets_liabilities") + """SELECT company_id, id, name, category, classification,
round(CAST(amount AS DOUBLE), 2) AS amount FROM v_assets_liabilities x
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY x.amount DESC NULLS LAST, id) <= 20""")
def q_top_positions(c: Ctx):
    """Top 20 asset/liability lines of each company by amount."""
    return WN.top_k_per_group(c.assets_liabilities, ["company_id"], 20, [F.col("amount").desc_nulls_last(), F.col("id")]).select(
        "company_id", "id", "name", "category", "classification", out_money("amount").alias("amount"))


@query("recent_invoices", W("v_invoices") + f"""SELECT company_id, {INV_COLS} FROM v_invoices
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY invoice_date DESC, id) <= 15""")
def q_recent_invoices(c: Ctx):
    """Newest 15 invoices of each company."""
    return _inv_cols(WN.top_k_per_group(c.invoices, ["company_id"], 15, [F.col("invoice_date").desc(), F.col("id")]), "company_id")


@query("recent_transactions_top", W("v_transactions") + """SELECT company_id, id, transaction_date, description, category,
round(CAST(amount AS DOUBLE), 2) AS amount, status FROM v_transactions
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY transaction_date DESC, id) <= 20""")
def q_recent_transactions_top(c: Ctx):
    """Newest 20 transactions of each company."""
    return WN.top_k_per_group(c.transactions, ["company_id"], 20, [F.col("transaction_date").desc(), F.col("id")]).select(
        "company_id", "id", "transaction_date", "description", "category", out_money("amount").alias("amount"), "status")


@query("top_signals", W("v_market_signals") + """SELECT company_id, id, tier, CAST(rank AS INTEGER) AS rank, relevance_score FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, tier ORDER BY relevance_score DESC NULLS LAST,
                                 coalesce(published_at, observed_at) DESC NULLS LAST, id) AS rank
  FROM (SELECT *, CASE WHEN coalesce(relevance_score, 0) >= 0.75 THEN 'high' WHEN coalesce(relevance_score, 0) >= 0.4
                       THEN 'medium' ELSE 'watch' END AS tier FROM v_market_signals))
WHERE rank <= CASE tier WHEN 'high' THEN 20 ELSE 30 END""")
def q_top_signals(c: Ctx):
    """Market snapshot lists of each company: top 20 high, 30 medium and 30 watch signals."""
    t = FL.signal_tiering(c.signals)
    r = WN.top_k_per_group(t, ["company_id", "tier"], 30, [F.col("relevance_score").desc_nulls_last(),
                                               F.coalesce("published_at", "observed_at").desc_nulls_last(), F.col("id")])
    return r.filter(F.col("rank") <= F.when(F.col("tier") == "high", 20).otherwise(30)).select(
        "company_id", "id", "tier", F.col("rank").cast("int").alias("rank"), "relevance_score")


@query("top_inventory_value", W("v_inventory") + """SELECT company_id, sku, name, round(CAST(total_value AS DOUBLE), 2) AS total_value
FROM v_inventory x QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY x.total_value DESC, sku) <= 8""")
def q_top_inventory_value(c: Ctx):
    """Eight most valuable stock lines of each company."""
    return WN.top_k_per_group(c.inventory, ["company_id"], 8, [F.col("total_value").desc(), F.col("sku")]).select(
        "company_id", "sku", "name", out_money("total_value").alias("total_value"))


@query("company_market_signals", W("v_market_signals") + """SELECT company_id, id, relevance_score FROM v_market_signals
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY relevance_score DESC NULLS LAST, id) <= 12""")
def q_company_market_signals(c: Ctx):
    """Top 12 market signals of each company by relevance."""
    return WN.top_k_per_group(c.signals, ["company_id"], 12, [F.col("relevance_score").desc_nulls_last(), F.col("id")]).select(
        "company_id", "id", "relevance_score")


# ----------------------------------------------------------------------------- composites

@query("financial_snapshot", W("o_snapshot") + "SELECT * FROM o_snapshot")
def q_financial_snapshot(c: Ctx):
    """22 KPIs; balance basis switches to the posted ledger once any journal line is posted."""
    return c.snapshot


@query("cash_forecast", W("o_forecast") + "SELECT * FROM o_forecast")
def q_cash_forecast(c: Ctx):
    """Weekly cash forecast over 90 days (13 points) from recent net flow and invoices due."""
    return SN.cash_forecast(c, AS_OF, P.FORECAST_DAYS)


@query("forecast_summary", W("o_forecast") + """SELECT company_id, max(daily_net_assumption) AS daily_net_assumption,
min(forecast) AS low_point, max(CASE WHEN step = 4 THEN forecast END) AS forecast_30d,
max(CASE WHEN step = 8 THEN forecast END) AS forecast_60d, max(CASE WHEN step = 12 THEN forecast END) AS forecast_90d
FROM o_forecast GROUP BY company_id""")
def q_forecast_summary(c: Ctx):
    """Forecast low point and the 30/60/90-day chart picks."""
    return SN.forecast_summary(c, AS_OF, P.FORECAST_DAYS)
