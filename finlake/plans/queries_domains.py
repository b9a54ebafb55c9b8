"""Domain product queries: HR, inventory, tax/BAS, marketing, money map, market/competitor."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..context import Ctx
from ..functions.expr import out_money
from ..oracle.views import with_views as W
from ..registry import query
from . import domains as D
from . import snapshot as SN


def m(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 2)"


def _money_cols(df, cols):
    return df.select(*[out_money(c).alias(c) if c in cols else F.col(c) for c in df.columns])


LATEST_PAY = """, lp AS (
  SELECT *, substr(pay_period, 1, 7) AS month FROM v_payroll p
  WHERE substr(pay_period, 1, 7) = (SELECT max(substr(pay_period, 1, 7)) FROM v_payroll x WHERE x.company_id = p.company_id))"""

REGISTER_SQL = LATEST_PAY + """,
pa AS (
  SELECT company_id, employee, sum(gross_pay) AS gross_pay, sum(payg_withholding) AS payg_withholding,
         sum(superannuation) AS superannuation, sum(net_pay) AS net_pay, max(currency) AS currency, max(source_file) AS source_file
  FROM lp GROUP BY 1, 2),
reg AS (
  SELECT pa.company_id, pa.employee, coalesce(pr.employee_code, '') AS employee_code,
         coalesce(pr.department, 'Unassigned') AS department, coalesce(pr.role, '') AS role_title,
         coalesce(pr.employment_type, '') AS employment_type, gross_pay, payg_withholding, superannuation, net_pay,
         CAST(round(gross_pay * 0.12, 2) AS DECIMAL(18,2)) AS expected_super,
         superannuation - CAST(round(gross_pay * 0.12, 2) AS DECIMAL(18,2)) AS super_gap, currency, source_file
  FROM pa LEFT JOIN v_profiles pr ON pr.company_id = pa.company_id AND pr.employee = pa.employee)"""

MONEY_REG = ("gross_pay", "payg_withholding", "superannuation", "net_pay", "expected_super", "super_gap")


@query("payroll_register", W("v_payroll", "v_profiles") + REGISTER_SQL + f"""
SELECT company_id, employee, employee_code, department, role_title, employment_type,
       {m('gross_pay')} AS gross_pay, {m('payg_withholding')} AS payg_withholding, {m('superannuation')} AS superannuation,
       {m('net_pay')} AS net_pay, {m('expected_super')} AS expected_super, {m('super_gap')} AS super_gap, currency, source_file
FROM reg""")
def q_payroll_register(c: Ctx):
    """Latest pay month per employee joined to profiles, with the 12 % super check."""
    return _money_cols(D.payroll_register(c.payroll, c.profiles), MONEY_REG)


@query("hr_department_costs", W("v_payroll", "v_profiles") + REGISTER_SQL + f"""
SELECT company_id, department, {m('sum(gross_pay)')} AS gross_pay, CAST(count(*) AS BIGINT) AS headcount
FROM reg GROUP BY 1, 2""")
def q_hr_department_costs(c: Ctx):
    """Gross pay and headcount per department for the latest pay month."""
    return D.hr_department_costs(D.payroll_register(c.payroll, c.profiles))


@query("hr_summary", W("v_payroll", "v_profiles") + REGISTER_SQL + f"""
SELECT company_id, CAST(count(*) AS BIGINT) AS headcount, {m('sum(gross_pay)')} AS gross_pay, {m('sum(net_pay)')} AS net_pay,
       {m('sum(payg_withholding)')} AS payg_withholding, {m('sum(superannuation)')} AS superannuation,
       CAST(count(CASE WHEN abs(super_gap) > 0.02 THEN 1 END) AS BIGINT) AS open_actions
FROM reg GROUP BY 1""")
def q_hr_summary(c: Ctx):
    """Headcount, pay totals and open super-gap actions."""
    return D.hr_summary(D.payroll_register(c.payroll, c.profiles))


@query("employee_profile_fill", W("v_payroll", "v_profiles") + """
, miss AS (SELECT DISTINCT company_id, employee FROM v_payroll p
           WHERE NOT EXISTS (SELECT 1 FROM v_profiles x WHERE x.company_id = p.company_id AND x.employee = p.employee)),
base AS (SELECT company_id, count(*) AS n FROM v_profiles GROUP BY 1)
SELECT m.company_id, m.employee,
       'EMP-' || lpad(CAST(coalesce(b.n, 0) + row_number() OVER (PARTITION BY m.company_id ORDER BY m.employee) AS VARCHAR), 3, '0') AS employee_code,
       'Unassigned' AS department, 'payroll_only' AS evidence_mode
FROM miss m LEFT JOIN base b USING (company_id)""")
def q_employee_profile_fill(c: Ctx):
    """Payroll employees without a profile get a generated EMP code (anti-join + numbering)."""
    return D.employee_profile_fill(c.payroll, c.profiles)


REORDER_SQL = """, rd AS (
  SELECT company_id, sku, quantity, row_number() OVER (PARTITION BY company_id ORDER BY sku) - 1 AS i
  FROM v_inventory WHERE coalesce(sku, '') <> ''),
settings AS (
  SELECT company_id, sku, round(quantity * CASE WHEN i % 7 = 0 THEN 1.12 ELSE 0.28 END, 2) AS reorder_point,
         round(greatest(quantity * 1.35, round(quantity * CASE WHEN i % 7 = 0 THEN 1.12 ELSE 0.28 END, 2) * 1.8), 2) AS target_stock,
         CASE i % 3 WHEN 0 THEN 14 WHEN 1 THEN 21 ELSE 30 END AS lead_time_days
  FROM rd)"""


@query("reorder_defaults", W("v_inventory") + REORDER_SQL + """
SELECT company_id, sku, reorder_point, target_stock, CAST(lead_time_days AS INTEGER) AS lead_time_days,
       'Use supplier master' AS preferred_supplier FROM settings""")
def q_reorder_defaults(c: Ctx):
    """Default reorder point, target stock and lead time by SKU position."""
    return D.reorder_defaults(c.inventory).withColumn("lead_time_days", F.col("lead_time_days").cast("int"))


MOVEMENTS_SQL = """, cut AS (
  SELECT company_id, max(try_strptime(regexp_extract(source_file,
         '(\\d{1,2}(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\d{4})', 1), '%d%b%Y'))::DATE AS cutoff
  FROM v_inventory GROUP BY 1),
nm AS (SELECT company_id, sku, min(name) AS inv_name FROM v_inventory GROUP BY 1, 2),
mv AS (
  SELECT i.company_id, 'invoice-movement-' || i.id AS id, i.invoice_date AS movement_date, i.sku,
         coalesce(nm.inv_name, nullif(i.description, ''), i.sku) AS item_name,
         CASE WHEN abs(i.quantity) * CASE WHEN i.invoice_kind = 'sales' THEN -1.0 ELSE 1.0 END < 0 THEN 'sale' ELSE 'purchase' END AS movement_type,
         abs(i.quantity) * CASE WHEN i.invoice_kind = 'sales' THEN -1.0 ELSE 1.0 END AS signed_quantity,
         i.invoice_number AS source_invoice, i.source_file, 'invoice_line' AS evidence_mode,
         (cut.cutoff IS NULL OR i.invoice_date > cut.cutoff) AS applied_to_stock
  FROM v_invoices i LEFT JOIN cut ON cut.company_id = i.company_id
  LEFT JOIN nm ON nm.company_id = i.company_id AND nm.sku = i.sku
  WHERE coalesce(i.sku, '') <> '' AND coalesce(i.quantity, 0.0) <> 0)"""


@query("inventory_movements_build", W("v_inventory", "v_invoices") + MOVEMENTS_SQL + " SELECT * FROM mv")
def q_inventory_movements_build(c: Ctx):
    """Stock movements from invoice lines; applied only after the stock-count date in the file name."""
    return D.inventory_movements_build(c.invoices, c.inventory)


REGISTER_INV_SQL = MOVEMENTS_SQL + REORDER_SQL + """,
d AS (SELECT company_id, sku, sum(signed_quantity) AS delta, max(item_name) AS mv_name FROM mv WHERE applied_to_stock GROUP BY 1, 2),
ap AS (
  SELECT coalesce(v.company_id, d.company_id) AS company_id, coalesce(v.sku, d.sku) AS sku, coalesce(v.name, d.mv_name) AS name,
         coalesce(v.quantity, 0.0) + coalesce(d.delta, 0.0) AS quantity, coalesce(v.unit_cost, 0) AS unit_cost,
         coalesce(v.location, 'Unassigned') AS location, coalesce(v.status, 'active') AS status
  FROM v_inventory v FULL JOIN d ON d.company_id = v.company_id AND d.sku = v.sku
  WHERE v.quantity IS NOT NULL OR d.delta > 0),
reg AS (
  SELECT ap.*, round(ap.quantity * CAST(ap.unit_cost AS DOUBLE), 2) AS total_value, coalesce(s.reorder_point, 0.0) AS reorder_point,
         coalesce(s.target_stock, 0.0) AS target_stock, coalesce(s.lead_time_days, 0) AS lead_time_days
  FROM ap LEFT JOIN settings s ON s.company_id = ap.company_id AND s.sku = ap.sku)"""


@query("inventory_register", W("v_inventory", "v_invoices") + REGISTER_INV_SQL + f"""
SELECT company_id, sku, name, round(quantity, 2) AS quantity, {m('unit_cost')} AS unit_cost, round(total_value, 2) AS total_value,
       location, status, reorder_point, target_stock, lead_time_days,
       CASE WHEN quantity <= reorder_point THEN 'reorder' WHEN quantity <= reorder_point * 1.35 THEN 'watch' ELSE 'healthy' END AS stock_state,
       round(greatest(0.0, target_stock - quantity), 2) AS suggested_order
FROM reg""")
def q_inventory_register(c: Ctx):
    """Stock after applying invoice movements, with reorder settings, stock state and suggested order."""
    return D.inventory_register(c)


@query("inventory_summary", W("v_inventory", "v_invoices") + REGISTER_INV_SQL + """
, st AS (SELECT *, CASE WHEN quantity <= reorder_point THEN 'reorder' WHEN quantity <= reorder_point * 1.35 THEN 'watch'
                   ELSE 'healthy' END AS stock_state FROM reg),
s AS (SELECT company_id, CAST(count(*) AS BIGINT) AS sku_count, round(sum(round(quantity, 2)), 2) AS units_on_hand,
             round(sum(round(total_value, 2)), 2) AS inventory_value,
             CAST(count(CASE WHEN stock_state = 'reorder' THEN 1 END) AS BIGINT) AS reorder_count FROM st GROUP BY 1),
mc AS (SELECT company_id, CAST(count(CASE WHEN coalesce(source_invoice, '') <> '' THEN 1 END) AS BIGINT) AS invoice_linked_movements,
              CAST(count(CASE WHEN applied_to_stock THEN 1 END) AS BIGINT) AS auto_applied_movements FROM mv GROUP BY 1)
SELECT s.*, mc.invoice_linked_movements, mc.auto_applied_movements FROM s LEFT JOIN mc USING (company_id)""")
def q_inventory_summary(c: Ctx):
    """SKU count, units, value, reorder count and movement counters."""
    inv = c.inventory
    return D.inventory_summary(D.inventory_register(c), D.inventory_movements_build(c.invoices, inv))


BAS_SQL = LATEST_PAY + """,
iv AS (
  SELECT company_id,
    sum(CASE WHEN invoice_kind = 'sales' THEN amount ELSE 0 END) AS sales_total,
    sum(CASE WHEN invoice_kind = 'sales' THEN gst ELSE 0 END) AS sales_gst,
    sum(CASE WHEN invoice_kind <> 'sales' THEN amount ELSE 0 END) AS purchase_total,
    sum(CASE WHEN invoice_kind <> 'sales' THEN gst ELSE 0 END) AS purchase_gst
  FROM o_classified WHERE c_validation = 'approved' GROUP BY 1),
py AS (SELECT company_id, sum(gross_pay) AS w1, sum(payg_withholding) AS w2 FROM lp GROUP BY 1),
bas AS (
  SELECT iv.company_id, sales_total AS g1, sales_gst AS one_a, purchase_gst AS one_b, coalesce(w1, 0) AS w1, coalesce(w2, 0) AS w2,
         sales_gst - purchase_gst AS net_gst, purchase_total, sales_total
  FROM iv LEFT JOIN py USING (company_id))"""


@query("bas_labels", W("o_classified", "v_payroll") + BAS_SQL + f"""
SELECT company_id, {m('g1')} AS "G1", {m('one_a')} AS "1A", {m('one_b')} AS "1B", {m('w1')} AS "W1", {m('w2')} AS "W2",
       {m('net_gst')} AS net_gst, {m('purchase_total')} AS purchase_total, {m('sales_total')} AS sales_total FROM bas""")
def q_bas_labels(c: Ctx):
    """BAS labels G1, 1A, 1B, W1, W2 and net GST from approved invoices and the latest pay month."""
    return D.bas_labels(c)


@query("payroll_period_totals", W("v_payroll") + LATEST_PAY + f"""
SELECT company_id, month AS period, {m('sum(gross_pay)')} AS gross_pay, {m('sum(payg_withholding)')} AS payg_withholding
FROM lp GROUP BY 1, 2""")
def q_payroll_period_totals(c: Ctx):
    """Latest pay month gross pay and PAYG withheld."""
    return D.payroll_period_totals(c.payroll)


REVIEW_SQL = """, rc AS (
  SELECT company_id,
    CAST(count(CASE WHEN c_validation <> 'approved' THEN 1 END) AS BIGINT) AS unresolved,
    CAST(count(CASE WHEN invoice_kind <> 'sales' AND c_tax_code = 'REVIEW' THEN 1 END) AS BIGINT) AS missing_gst,
    CAST(count(CASE WHEN c_account_code = '1500' THEN 1 END) AS BIGINT) AS capital_review,
    CAST(count(CASE WHEN c_account_code = '6190' THEN 1 END) AS BIGINT) AS entertainment_review,
    CAST(count(CASE WHEN coalesce(source_file, '') = '' THEN 1 END) AS BIGINT) AS evidence_missing
  FROM o_classified GROUP BY 1)"""


@query("tax_review_counts", W("o_classified") + REVIEW_SQL + " SELECT * FROM rc")
def q_tax_review_counts(c: Ctx):
    """Unresolved, missing-GST, capital, entertainment and missing-evidence counts in one pass."""
    return D.tax_review_counts(c)


@query("tax_review_items", W("o_classified") + REVIEW_SQL + """,
it AS (
  SELECT company_id, 'Review missing GST treatment' AS title, missing_gst AS count, 'review' AS status FROM rc
  UNION ALL SELECT company_id, 'Review capital purchases', capital_review, 'review' FROM rc
  UNION ALL SELECT company_id, 'Review entertainment and FBT', entertainment_review, 'review' FROM rc
  UNION ALL SELECT company_id, 'Resolve uncategorised invoices', unresolved, 'high' FROM rc
  UNION ALL SELECT company_id, 'Attach missing source evidence', evidence_missing, 'review' FROM rc),
pos AS (SELECT * FROM it WHERE count > 0)
SELECT * FROM pos
UNION ALL SELECT company_id, 'No obvious exceptions detected', CAST(0 AS BIGINT), 'ready' FROM rc
WHERE company_id NOT IN (SELECT company_id FROM pos)""")
def q_tax_review_items(c: Ctx):
    """Review items with a non-zero count, or one 'no exceptions' row."""
    return D.tax_review_items(c)


@query("business_signals", W("o_classified", "v_inventory", "v_payroll") + f"""
, a AS (SELECT company_id, CAST(count(CASE WHEN c_account_code = '1500' THEN 1 END) AS BIGINT) AS capital_invoice_count,
               CAST(count(CASE WHEN c_tax_code = 'REVIEW' THEN 1 END) AS BIGINT) AS gst_review_rows,
               {m("sum(CASE WHEN contains(lower(c_account_name), 'software') THEN amount ELSE 0 END)")} AS software_spend
        FROM o_classified GROUP BY 1),
b AS (SELECT company_id, {m('sum(total_value)')} AS inventory_value FROM v_inventory GROUP BY 1),
p AS (SELECT company_id, CAST(count(*) AS BIGINT) AS payroll_rows FROM v_payroll GROUP BY 1)
SELECT a.*, b.inventory_value, p.payroll_rows FROM a LEFT JOIN b USING (company_id) LEFT JOIN p USING (company_id)""")
def q_business_signals(c: Ctx):
    """Tax-scheme evidence signals: capital invoices, inventory value, payroll rows, GST review rows, software spend."""
    return D.business_signals(c)


TAX_POSITION_SQL = BAS_SQL + REVIEW_SQL + f""",
acc AS (
  SELECT round(CAST(sum(CASE WHEN account_type = 'revenue' THEN balance WHEN account_type = 'expense' THEN -balance ELSE 0 END) AS DOUBLE), 2) AS acct_profit,
         abs(round(CAST(sum(CASE WHEN account_type = 'revenue' THEN balance ELSE 0 END) AS DOUBLE), 2)) AS posted_revenue,
         round(CAST(sum(CASE WHEN code = '2100' THEN balance ELSE 0 END) AS DOUBLE), 2)
           - round(CAST(sum(CASE WHEN code = '1300' THEN balance ELSE 0 END) AS DOUBLE), 2) AS gst_control
  FROM o_trial_balance),
pl AS (
  SELECT company_id, round(CAST(sum(amount) AS DOUBLE), 2) AS statement_profit,
         abs(round(CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE), 2)) AS statement_revenue
  FROM v_statements s WHERE statement_type = 'profit_loss'
   AND period_end = (SELECT max(period_end) FROM v_statements x WHERE x.statement_type = 'profit_loss' AND x.company_id = s.company_id)
  GROUP BY 1),
tp AS (
  SELECT pl.company_id, pl.statement_profit, acc.acct_profit, acc.gst_control, {m('bas.net_gst')} AS net_gst, rc.unresolved,
         abs(statement_profit) > 0.005 AND (abs(acct_profit) < 0.005
           OR (statement_revenue > 0.005 AND posted_revenue < statement_revenue * 0.75)) AS use_stmt
  FROM pl JOIN bas USING (company_id) JOIN rc USING (company_id) CROSS JOIN acc),
tx AS (SELECT *, CASE WHEN use_stmt THEN statement_profit ELSE acct_profit END AS profit FROM tp)"""


@query("tax_position", W("o_classified", "v_payroll", "o_trial_balance", "v_statements") + TAX_POSITION_SQL + f"""
SELECT company_id, round(profit, 2) AS accounting_profit,
       CASE WHEN use_stmt THEN 'latest_profit_loss' ELSE 'posted_journals' END AS profit_basis,
       round(greatest(0.0, profit), 2) AS estimated_taxable_income,
       round(greatest(0.0, profit) * {P.INCOME_TAX_RATE} / 100, 2) AS estimated_income_tax,
       CASE WHEN unresolved > 0 THEN 'low' ELSE 'medium' END AS confidence,
       round(gst_control - net_gst, 2) AS gst_reconciliation_difference
FROM tx""")
def q_tax_position(c: Ctx):
    """Indicative tax position: profit basis choice, taxable income, estimated tax, GST reconciliation."""
    return D.tax_position(c)


CHANNEL_SQL = """, mk AS (SELECT * FROM o_classified WHERE c_account_code = '6150' AND c_validation = 'approved'),
ch AS (
  SELECT company_id, CASE
      WHEN contains(t, 'google ads') OR contains(t, 'search ads') OR contains(t, 'sem') OR contains(t, 'ppc') THEN 'Paid search'
      WHEN contains(t, 'facebook') OR contains(t, 'instagram') OR contains(t, 'linkedin') OR contains(t, 'tiktok') OR contains(t, 'social') THEN 'Social'
      WHEN contains(t, 'mailchimp') OR contains(t, 'hubspot') OR contains(t, 'klaviyo') OR contains(t, 'email') OR contains(t, 'crm') THEN 'Email & CRM'
      WHEN contains(t, 'content') OR contains(t, 'seo') OR contains(t, 'copywriting') OR contains(t, 'blog') THEN 'Content & SEO'
      WHEN contains(t, 'event') OR contains(t, 'sponsor') OR contains(t, 'partnership') OR contains(t, 'expo') THEN 'Events & partnerships'
      ELSE 'Brand & other' END AS channel, amt
  FROM (SELECT company_id, lower(coalesce(supplier, '') || ' ' || coalesce(description, '')) AS t, abs(amount) AS amt FROM mk)),
chs AS (SELECT company_id, channel, sum(amt) AS amt FROM ch GROUP BY 1, 2),
tot AS (
  SELECT i.company_id, CASE WHEN coalesce(l.balance, 0) > 0.01 THEN CAST(l.balance AS DOUBLE) ELSE CAST(i.s AS DOUBLE) END AS spend
  FROM (SELECT company_id, sum(abs(amount)) AS s FROM mk GROUP BY 1) i
  LEFT JOIN (SELECT company_id, round(CAST(balance AS DOUBLE), 2) AS balance FROM o_trial_balance WHERE code = '6150') l USING (company_id)),
cs AS (
  SELECT chs.company_id, channel, round(CAST(amt AS DOUBLE), 2) AS spend,
         CASE WHEN tot.spend <> 0 THEN round(CAST(amt AS DOUBLE) / tot.spend * 100, 1) ELSE 0.0 END AS share, 'review' AS status
  FROM chs JOIN tot USING (company_id))"""


@query("channel_spend", W("o_classified", "o_trial_balance") + CHANNEL_SQL + " SELECT * FROM cs")
def q_channel_spend(c: Ctx):
    """Approved marketing spend by channel with its share of total spend."""
    return D.channel_spend(c)


@query("month_spend_allocation", W("o_classified", "o_trial_balance", "o_monthly") + CHANNEL_SQL + """,
sp AS (SELECT company_id, sum(spend) AS spend FROM cs GROUP BY 1),
lm AS (
  SELECT company_id, month, round(CAST(revenue AS DOUBLE), 2) AS revenue, round(CAST(expenses AS DOUBLE), 2) AS expenses
  FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS rn FROM o_monthly) WHERE rn <= 6),
ob AS (
  SELECT *, count(*) OVER (PARTITION BY company_id) AS n_obs, sum(greatest(0.0, revenue)) OVER (PARTITION BY company_id) AS tot
  FROM lm WHERE abs(revenue) > 0.01 OR abs(expenses) > 0.01)
SELECT ob.company_id, month, revenue,
       round(coalesce(sp.spend, 0.0) * greatest(0.0, revenue) / CASE WHEN tot <> 0 THEN tot ELSE 1.0 END, 2) AS marketing_spend
FROM ob LEFT JOIN sp USING (company_id) WHERE n_obs >= 4""")
def q_month_spend_allocation(c: Ctx):
    """Marketing spend apportioned to the last 6 months by revenue share (needs >= 4 observed months)."""
    return D.month_spend_allocation(c)


RECEIPTS_SQL = """, bm AS (SELECT *, strftime(transaction_date, '%Y-%m') AS m FROM v_bank),
rs AS (
  SELECT company_id, CASE
      WHEN contains(lower(description), 'key account') THEN 'Key accounts'
      WHEN contains(lower(description), 'healthcare') OR contains(lower(description), 'education') THEN 'Healthcare & education'
      WHEN contains(lower(description), 'commercial') THEN 'Commercial customers'
      ELSE 'Other receipts' END AS name, round(CAST(sum(amount) AS DOUBLE), 2) AS value
  FROM bm b WHERE amount > 0 AND m = (SELECT max(m) FROM bm x WHERE x.company_id = b.company_id)
  GROUP BY 1, 2)"""

DEPTS_SQL = """, dp AS (
  SELECT company_id, CASE
      WHEN contains(li, 'cost of goods') OR contains(li, 'freight') OR contains(li, 'depreciation') THEN 'Operations & supply'
      WHEN contains(li, 'payroll') OR contains(li, 'wage') OR contains(li, 'super') THEN 'People'
      WHEN contains(li, 'rent') OR contains(li, 'utilit') THEN 'Facilities'
      WHEN contains(li, 'advert') OR contains(li, 'marketing') THEN 'Growth'
      WHEN contains(li, 'software') OR contains(li, 'subscription') THEN 'Technology'
      WHEN contains(li, 'interest') OR contains(li, 'finance') OR contains(li, 'bank') THEN 'Finance'
      ELSE 'Other operations' END AS name, round(CAST(abs(sum(amount)) AS DOUBLE), 2) AS value
  FROM (SELECT *, lower(line_item) AS li FROM v_statements s WHERE statement_type = 'profit_loss' AND amount < 0
        AND period_end = (SELECT max(period_end) FROM v_statements x WHERE x.statement_type = 'profit_loss' AND x.company_id = s.company_id))
  GROUP BY 1, 2)"""


@query("receipt_sources", W("v_bank") + RECEIPTS_SQL + " SELECT * FROM rs")
def q_receipt_sources(c: Ctx):
    """Latest bank month receipts by source label."""
    return D.receipt_sources(c.bank)


@query("department_costs_flow", W("v_statements") + DEPTS_SQL + " SELECT * FROM dp")
def q_department_costs_flow(c: Ctx):
    """Latest P&L costs by department."""
    return D.department_costs_flow(c.statements)


MONEY_MAP_SQL = TAX_POSITION_SQL + RECEIPTS_SQL + DEPTS_SQL + f""",
plr AS (
  SELECT company_id, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS stmt_rev
  FROM v_statements s WHERE statement_type = 'profit_loss'
   AND period_end = (SELECT max(period_end) FROM v_statements x WHERE x.statement_type = 'profit_loss' AND x.company_id = s.company_id)
  GROUP BY 1),
srt AS (SELECT company_id, sum(value) AS src_tot FROM rs GROUP BY 1),
dpt AS (SELECT company_id, sum(value) AS costs FROM dp GROUP BY 1),
itx AS (SELECT company_id, round(greatest(0.0, profit) * {P.INCOME_TAX_RATE} / 100, 2) AS itax FROM tx),
mm AS (
  SELECT coalesce(plr.company_id, srt.company_id) AS company_id,
         CASE WHEN coalesce(stmt_rev, 0.0) <> 0 THEN stmt_rev ELSE coalesce(src_tot, 0.0) END AS revenue,
         coalesce(costs, 0.0) AS costs, coalesce(itax, 0.0) AS itax
  FROM plr FULL JOIN srt ON srt.company_id = plr.company_id
  LEFT JOIN dpt ON dpt.company_id = coalesce(plr.company_id, srt.company_id)
  LEFT JOIN itx ON itx.company_id = coalesce(plr.company_id, srt.company_id)),
mm2 AS (SELECT *, greatest(0.0, revenue - costs) AS pre_tax FROM mm),
mm3 AS (SELECT *, least(pre_tax, itax) AS tax_est FROM mm2),
summary AS (
  SELECT company_id, round(revenue, 2) AS revenue, round(costs, 2) AS operating_costs, round(pre_tax, 2) AS profit_before_tax,
         round(tax_est, 2) AS estimated_tax, round(greatest(0.0, pre_tax - tax_est), 2) AS retained_profit,
         CASE WHEN revenue <> 0 THEN round(pre_tax / revenue * 100, 1) ELSE 0.0 END AS profit_margin_pct
  FROM mm3)"""


@query("money_map_summary", W("o_classified", "v_payroll", "o_trial_balance", "v_statements", "v_bank") + MONEY_MAP_SQL +
       " SELECT * FROM summary")
def q_money_map_summary(c: Ctx):
    """Money map summary: revenue, operating costs, pre-tax profit, estimated tax, retained profit."""
    return D.money_map(c)[0]


@query("money_map_links", W("o_classified", "v_payroll", "o_trial_balance", "v_statements", "v_bank") + MONEY_MAP_SQL + """
SELECT company_id, name AS source, 'Revenue hub' AS target, value FROM rs
UNION ALL SELECT company_id, 'Revenue hub', name, value FROM dp
UNION ALL SELECT company_id, 'Revenue hub', 'Profit before tax', profit_before_tax FROM summary
UNION ALL SELECT company_id, 'Profit before tax', 'Estimated income tax', estimated_tax FROM summary
  WHERE profit_before_tax > 0 AND estimated_tax > 0
UNION ALL SELECT company_id, 'Profit before tax', 'Retained profit', retained_profit FROM summary
  WHERE profit_before_tax > 0 AND retained_profit > 0""")
def q_money_map_links(c: Ctx):
    """Money map links: receipt sources -> hub -> departments / profit -> tax / retained."""
    return D.money_map(c)[1]


COMPETITOR_SQL = """, s AS (
  SELECT company_id, trim(entity) AS entity, lower(coalesce(signal_type, '') || ' ' || coalesce(topic, '')) AS t,
         TRY_CAST(nullif(regexp_extract(replace(value, ',', ''), '-?\\d+(?:\\.\\d+)?', 0), '') AS DOUBLE) AS v
  FROM v_market_signals WHERE trim(coalesce(entity, '')) <> ''),
s2 AS (
  SELECT *, CASE
      WHEN contains(t, 'current ratio') OR contains(t, 'liquidity') OR contains(t, 'working capital') THEN 'Liquidity'
      WHEN contains(t, 'margin') OR contains(t, 'profitability') OR contains(t, 'gross profit') THEN 'Margin strength'
      WHEN contains(t, 'growth') OR contains(t, 'revenue') OR contains(t, 'sales') THEN 'Revenue momentum'
      WHEN contains(t, 'cash') OR contains(t, 'runway') OR contains(t, 'resilience') OR contains(t, 'debt') THEN 'Cash resilience'
    END AS dimension FROM s WHERE v IS NOT NULL),
s3 AS (
  SELECT company_id, entity, dimension, CASE dimension
      WHEN 'Liquidity' THEN round(greatest(0.0, least(140.0, v / 1.2 * 100)), 1)
      WHEN 'Margin strength' THEN round(greatest(0.0, least(140.0, v / 30.0 * 100)), 1)
      WHEN 'Revenue momentum' THEN round(greatest(0.0, least(140.0, 50 + v * 3.0)), 1)
      ELSE round(greatest(0.0, least(140.0, v)), 1) END AS score
  FROM s2 WHERE dimension IS NOT NULL),
dims AS (SELECT company_id, entity, dimension, ((2 * sum(CAST(round(score * 10) AS BIGINT)) + count(*)) // (2 * count(*))) / 10.0 AS value
         FROM s3 GROUP BY 1, 2, 3)"""


@query("competitor_dimensions", W("v_market_signals") + COMPETITOR_SQL + " SELECT * FROM dims")
def q_competitor_dimensions(c: Ctx):
    """Average clamped metric per competitor and dimension."""
    return D.competitor_dimensions(c.signals)[0]


@query("competitor_ranking", W("v_market_signals") + COMPETITOR_SQL + """,
ent AS (SELECT company_id, entity, count(*) AS n, sum(CAST(round(value * 10) AS BIGINT)) AS t FROM dims GROUP BY 1, 2)
SELECT e.company_id, e.entity, CAST(coalesce(n, 0) AS BIGINT) AS verified_dimensions,
       CASE WHEN coalesce(n, 0) >= 2 THEN ((2 * t + n) // (2 * n)) / 10.0 END AS score,
       CASE WHEN coalesce(n, 0) >= 2 THEN 'comparable' ELSE 'more verified metrics required' END AS status
FROM (SELECT DISTINCT company_id, entity FROM s WHERE v IS NOT NULL) e LEFT JOIN ent USING (company_id, entity)""")
def q_competitor_ranking(c: Ctx):
    """Competitor score = mean of its dimensions when at least two are verified."""
    return D.competitor_dimensions(c.signals)[1]


@query("company_dimensions", W("o_snapshot") + f"""
SELECT company_id, 'Liquidity' AS dimension, round(greatest(0.0, least(140.0, coalesce(current_ratio, 0.0) / 1.2 * 100)), 1) AS value FROM o_snapshot
UNION ALL SELECT company_id, 'Cash resilience', round(greatest(0.0, least(140.0, coalesce(CAST(cash_runway_days AS DOUBLE), 0.0) / 45 * 100)), 1) FROM o_snapshot
UNION ALL SELECT company_id, 'Margin strength', round(greatest(0.0, least(140.0, coalesce(gross_margin, 0.0) / 30.0 * 100)), 1) FROM o_snapshot
UNION ALL SELECT company_id, 'Revenue momentum', round(greatest(0.0, least(140.0, 50 + coalesce(revenue_change, 0.0) * 3.0)), 1) FROM o_snapshot""")
def q_company_dimensions(c: Ctx):
    """The company's own liquidity, resilience, margin and momentum scores from the snapshot."""
    return D.company_dimensions(c.snapshot)


@query("distinct_market_exposure", """
SELECT DISTINCT 'supplier' AS side, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 'customer', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_distinct_market_exposure(c: Ctx):
    """Distinct supplier and customer countries (market profile exposure sets)."""
    return D.distinct_market_exposure(c)


@query("signal_counts", W("v_market_signals") + """
SELECT company_id, CASE WHEN coalesce(relevance_score, 0) >= 0.75 THEN 'high' WHEN coalesce(relevance_score, 0) >= 0.4 THEN 'medium'
       ELSE 'watch' END AS tier, CAST(count(*) AS BIGINT) AS signals FROM v_market_signals GROUP BY 1, 2""")
def q_signal_counts(c: Ctx):
    """Number of market signals per relevance tier."""
    from ..operators.filters import signal_tiering

    return signal_tiering(c.signals).groupBy("company_id", "tier").agg(F.count("*").cast("bigint").alias("signals"))
