"""DuckDB definitions of the canonical views (twins of ``finlake.sources.adapters``) and of the
derived ledger tables, as CTE text. ``with_views(*names)`` returns a ``WITH`` clause containing the
named views and everything they depend on, in dependency order.
"""

from __future__ import annotations

from .. import params as P
from ..functions import rules as R


def _q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def _case_phrase(expr: str, phrases) -> str:
    whens = " ".join(f"WHEN {i} THEN {_q(p)}" for i, p in enumerate(phrases))
    return f"(CASE {expr} {whens} END)"


def _norm(expr: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(coalesce(CAST({expr} AS VARCHAR), '')), "
            f"'[^a-z0-9& .-]+', ' ', 'g'), '\\s+', ' ', 'g'))")  # two-step form, as specified


def _money(cents_expr: str) -> str:
    return f"CAST(({cents_expr}) / 100.0 AS DECIMAL(18,2))"


def _cents(x: str) -> str:
    return f"CAST(round({x} * 100) AS BIGINT)"


_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, deps: tuple[str, ...], sql: str) -> None:
    _VIEWS[name] = (deps, sql)


_view("li", (), f"""
SELECT *, {_cents('l_extendedprice')} AS price_cents,
       ({_cents('l_extendedprice')} * (100 - {_cents('l_discount')}) + 50) // 100 AS net_cents
FROM lineitem""")

_view("v_sales_invoices", (), f"""
SELECT {_q(P.COMPANY)} AS company_id, 'so-' || o_orderkey AS id, 'INV-' || o_orderkey AS invoice_number,
       c_name AS supplier, CAST(o_orderdate AS DATE) AS invoice_date, CAST(o_orderdate AS DATE) + 30 AS due_date,
       {_money(_cents('o_totalprice'))} AS amount,
       CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'due' ELSE 'review' END AS status,
       'sales_invoices_' || year(o_orderdate) || '.csv' AS source_file, 'sales' AS invoice_kind,
       {_q(P.CURRENCY)} AS currency, CAST(NULL AS DECIMAL(18,2)) AS subtotal, CAST(NULL AS DECIMAL(18,2)) AS gst_amount,
       'Order ' || o_orderpriority AS description, CAST(NULL AS VARCHAR) AS tax_code,
       CAST(NULL AS VARCHAR) AS account_code, 'imported' AS validation_status,
       CAST(NULL AS VARCHAR) AS sku, CAST(NULL AS DOUBLE) AS quantity
FROM orders JOIN customer ON c_custkey = o_custkey""")

_view("v_supplier_invoices", ("li",), f"""
SELECT {_q(P.COMPANY)} AS company_id,
       'bl-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || price_cents AS id,
       'BILL-' || l_orderkey || '-' || l_linenumber AS invoice_number, s_name AS supplier,
       CAST(l_shipdate AS DATE) AS invoice_date, CAST(l_shipdate AS DATE) + 45 AS due_date,
       {_money('net_cents')} AS amount,
       CASE l_linestatus WHEN 'F' THEN 'paid' ELSE 'due' END AS status,
       'supplier_invoices_' || year(l_shipdate) || '.csv' AS source_file, 'supplier' AS invoice_kind,
       {_q(P.CURRENCY)} AS currency, CAST(NULL AS DECIMAL(18,2)) AS subtotal, CAST(NULL AS DECIMAL(18,2)) AS gst_amount,
       p_name || ' ' || {_case_phrase(f'l_partkey % {len(P.DESCRIPTION_PHRASES)}', P.DESCRIPTION_PHRASES)} AS description,
       CAST(NULL AS VARCHAR) AS tax_code, CAST(NULL AS VARCHAR) AS account_code, 'imported' AS validation_status,
       'SKU-' || l_partkey AS sku, l_quantity AS quantity
FROM li JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey""")

_view("v_invoices", ("v_sales_invoices", "v_supplier_invoices"), """
SELECT * FROM v_sales_invoices UNION ALL SELECT * FROM v_supplier_invoices""")

_view("v_transactions", ("li",), f"""
SELECT {_q(P.COMPANY)} AS company_id, 'tx-s-' || o_orderkey AS id, CAST(o_orderdate AS DATE) AS transaction_date,
       'Customer receipt INV-' || o_orderkey AS description, 'sales receipt' AS category,
       {_money(_cents('o_totalprice'))} AS amount, 'imported' AS status,
       'transactions_' || year(o_orderdate) || '.csv' AS source_file
FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT {_q(P.COMPANY)}, 'tx-p-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || price_cents,
       CAST(l_shipdate AS DATE), s_name || ' INV-' || l_orderkey, 'supplier payment',
       {_money('-net_cents')}, 'imported', 'transactions_' || year(l_shipdate) || '.csv'
FROM li JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus = 'F'""")

_view("v_bank", (), f"""
SELECT {_q(P.COMPANY)} AS company_id, 'bk-' || o_orderkey AS id, CAST(o_orderdate AS DATE) + 2 AS transaction_date,
       'Payment INV-' || o_orderkey || ' ' || c_name || ' ' || {_case_phrase('o_custkey % 4', P.BANK_SEGMENT_PHRASES)} AS description,
       'Operating account' AS account_name,
       {_money(_cents('o_totalprice') + " + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 11 = 0 THEN 500 ELSE 0 END")} AS amount,
       CAST(NULL AS DECIMAL(18,2)) AS balance, {_q(P.CURRENCY)} AS currency, 'imported' AS status,
       'bank_' || year(CAST(o_orderdate AS DATE) + 2) || '.csv' AS source_file
FROM orders JOIN customer ON c_custkey = o_custkey""")

_view("v_statements", ("li",), f"""
WITH pl_rev AS (
  SELECT year(o_orderdate) AS y, SUM({_cents('o_totalprice')}) AS rev FROM orders GROUP BY 1),
pl_cost AS (
  SELECT year(l_shipdate) AS y,
         SUM(CASE WHEN l_returnflag = 'N' THEN net_cents ELSE 0 END) AS cogs,
         SUM(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN net_cents ELSE 0 END) AS wages,
         SUM(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN net_cents ELSE 0 END) AS rent,
         SUM(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN net_cents ELSE 0 END) AS interest,
         SUM(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN net_cents ELSE 0 END) AS itax
  FROM li GROUP BY 1),
pl AS (
  SELECT coalesce(r.y, c.y) AS y, coalesce(rev, 0) AS rev, coalesce(cogs, 0) AS cogs, coalesce(wages, 0) AS wages,
         coalesce(rent, 0) AS rent, coalesce(interest, 0) AS interest, coalesce(itax, 0) AS itax
  FROM pl_rev r FULL JOIN pl_cost c ON r.y = c.y),
pl_long AS (
  SELECT y, 'Sales revenue' AS line_item, rev AS cents FROM pl
  UNION ALL SELECT y, 'Cost of goods sold', -cogs FROM pl
  UNION ALL SELECT y, 'Wages and salaries', -wages FROM pl
  UNION ALL SELECT y, 'Rent and occupancy', -rent FROM pl
  UNION ALL SELECT y, 'Interest expense', -(interest // 10) FROM pl
  UNION ALL SELECT y, 'Income tax expense', -(itax // 10) FROM pl),
bs_o AS (
  SELECT year(o_orderdate) AS y,
         SUM(CASE WHEN o_orderstatus = 'F' THEN {_cents('o_totalprice')} ELSE 0 END) AS cash,
         SUM(CASE WHEN o_orderstatus = 'O' THEN {_cents('o_totalprice')} ELSE 0 END) AS ar,
         SUM(CASE WHEN o_orderstatus = 'P' THEN {_cents('o_totalprice')} // 11 ELSE 0 END) AS gst
  FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1),
bs_l AS (
  SELECT year(l_shipdate) AS y,
         SUM(CASE WHEN l_returnflag = 'R' THEN net_cents ELSE 0 END) AS inv,
         SUM(CASE WHEN l_returnflag = 'A' THEN net_cents ELSE 0 END) AS ppe,
         SUM(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN net_cents ELSE 0 END) AS ap,
         SUM(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN net_cents ELSE 0 END) AS loan
  FROM li WHERE year(l_shipdate) IN (1995, 1996) GROUP BY 1),
bs AS (
  SELECT coalesce(o.y, l.y) AS y, coalesce(cash, 0) AS cash, coalesce(ar, 0) AS ar, coalesce(gst, 0) AS gst,
         coalesce(inv, 0) AS inv, coalesce(ppe, 0) AS ppe, coalesce(ap, 0) AS ap, coalesce(loan, 0) AS loan
  FROM bs_o o FULL JOIN bs_l l ON o.y = l.y),
bs_long AS (
  SELECT y, 'Cash at bank' AS line_item, cash AS cents FROM bs
  UNION ALL SELECT y, 'Accounts receivable', ar FROM bs
  UNION ALL SELECT y, 'Inventory', inv FROM bs
  UNION ALL SELECT y, 'Plant and equipment', ppe FROM bs
  UNION ALL SELECT y, 'Accounts payable', -ap FROM bs
  UNION ALL SELECT y, 'Loans payable', -loan FROM bs
  UNION ALL SELECT y, 'GST payable', -gst FROM bs),
allst AS (
  SELECT y, line_item, cents, 'profit_loss' AS statement_type FROM pl_long
  UNION ALL SELECT y, line_item, cents, 'balance_sheet' FROM bs_long)
SELECT {_q(P.COMPANY)} AS company_id,
       'st-' || statement_type || '-' || y || '-' || regexp_replace(lower(line_item), '[^a-z0-9]+', '_', 'g') AS id,
       statement_type, make_date(CAST(y AS INTEGER), 1, 1) AS period_start, make_date(CAST(y AS INTEGER), 12, 31) AS period_end,
       line_item, {_money('cents')} AS amount, {_q(P.CURRENCY)} AS currency,
       statement_type || '_' || y || '.xlsx' AS source_file
FROM allst""")

_CURRENT = "('Cash at bank', 'Accounts receivable', 'Inventory', 'Accounts payable', 'GST payable')"

_view("v_assets_liabilities", ("v_statements",), f"""
SELECT s.company_id, 'al-' || regexp_replace(lower(line_item), '[^a-z0-9]+', '-', 'g') AS id, line_item AS name,
       CASE WHEN amount >= 0 THEN 'asset' ELSE 'liability' END AS category,
       CASE WHEN line_item IN {_CURRENT} THEN 'current' ELSE 'non-current' END AS classification,
       abs(amount) AS amount, 'imported' AS status, source_file
FROM v_statements s
WHERE statement_type = 'balance_sheet'
  AND period_end = (SELECT max(period_end) FROM v_statements x
                    WHERE x.statement_type = 'balance_sheet' AND x.company_id = s.company_id)""")

_view("v_inventory", (), f"""
SELECT {_q(P.COMPANY)} AS company_id, 'stk-' || p_partkey AS id, 'SKU-' || p_partkey AS sku, p_name AS name,
       coalesce(q.qty, 0.0) AS quantity, {_money(_cents('p_retailprice'))} AS unit_cost,
       {_money(f"CAST(round(coalesce(q.qty, 0.0) * {_cents('p_retailprice')}) AS BIGINT)")} AS total_value,
       'WH-' || (p_size % 3) AS location, 'active' AS status, {_q(P.STOCK_COUNT_FILE)} AS source_file
FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem
                     WHERE CAST(l_shipdate AS DATE) <= DATE '{P.STOCK_CUTOFF}' GROUP BY 1) q
  ON p_partkey = q.l_partkey""")

_view("v_movements", ("li",), f"""
SELECT {_q(P.COMPANY)} AS company_id,
       'mv-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || price_cents AS id,
       CAST(l_shipdate AS DATE) AS movement_date, 'SKU-' || l_partkey AS sku,
       CASE WHEN l_returnflag = 'R' THEN 'purchase' ELSE 'sale' END AS movement_type,
       CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE -1.0 END * l_quantity AS signed_quantity,
       'BILL-' || l_orderkey || '-' || l_linenumber AS source_invoice,
       'movements_' || year(l_shipdate) || '.csv' AS source_file
FROM li""")

_view("v_payroll", (), f"""
SELECT {_q(P.COMPANY)} AS company_id, 'pay-' || event_id AS id, strftime(ts, '%Y-%m-%d') AS pay_period,
       'Employee ' || user_id AS employee,
       {_money('g')} AS gross_pay, {_money('g')} AS ordinary_time_earnings, {_money('g // 5')} AS payg_withholding,
       {_money('CASE WHEN user_id % 5 = 0 THEN (g * 115) // 1000 ELSE (g * 12) // 100 END')} AS superannuation,
       {_money('g - g // 5')} AS net_pay, {_q(P.CURRENCY)} AS currency, 'imported' AS status,
       'payroll_' || strftime(ts, '%Y_%m') || '.csv' AS source_file
FROM (SELECT *, {_cents('value')} * 100 AS g FROM events WHERE event_type = 'purchase')""")

_view("v_profiles", (), f"""
SELECT {_q(P.COMPANY)} AS company_id, 'Employee ' || user_id AS employee,
       'EMP-' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS employee_code,
       {_case_phrase(f'user_id % {len(P.DEPARTMENTS)}', P.DEPARTMENTS)} AS department,
       CASE WHEN user_id % 3 = 0 THEN 'Manager' ELSE 'Associate' END AS role,
       CASE WHEN user_id % 2 = 0 THEN 'full_time' ELSE 'part_time' END AS employment_type,
       'active' AS status
FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 <> 0)""")

_view("v_market_signals", (), f"""
SELECT {_q(P.COMPANY)} AS company_id, 'sig-' || s_suppkey AS id,
       {_case_phrase('s_suppkey % 4', P.SIGNAL_TYPES)} AS signal_type,
       lower(n_name) || ' ' || {_case_phrase('s_suppkey % 4', P.SIGNAL_TYPES)} AS topic,
       n_name AS entity, n_name AS geography,
       DATE '2024-01-01' + CAST(s_suppkey % 700 AS INTEGER) AS observed_at,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE DATE '2023-12-01' + CAST(s_suppkey % 500 AS INTEGER) END AS published_at,
       CAST(abs({_cents('s_acctbal')}) // 100000 AS VARCHAR) || ' pts' AS value, 'AUD' AS unit,
       CASE WHEN s_acctbal >= 0 THEN 'up' ELSE 'down' END AS direction,
       'source ' || (s_suppkey % 7) AS source_name,
       'https://source' || (s_suppkey % 7) || '.example.com/' || s_suppkey AS source_url,
       (s_suppkey % 100) / 100.0 AS relevance_score,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'Impact on ' || lower(n_name) END AS estimated_impact,
       'market_context.xlsx' AS source_file
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")

_view("v_uploads", (), f"""
SELECT {_q(P.COMPANY)} AS company_id, 'up-' || doc_id AS upload_id,
       {_case_phrase(f'doc_id % {len(P.UPLOAD_FILE_STEMS)}', P.UPLOAD_FILE_STEMS)} || '_' || doc_id || '.csv' AS filename,
       sha256(text) AS sha256,
       {_case_phrase(f'doc_id % {len(P.UPLOAD_STATUSES)}', P.UPLOAD_STATUSES)} AS processing_status,
       CASE WHEN doc_id % 2 = 0 THEN 'setup' ELSE 'recurring' END AS intake_category,
       CAST(n_chars AS BIGINT) AS file_size, source, lang,
       DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS created_at
FROM documents""")


# ------------------------------------------------------------------ derived ledger tables

def _rules_values() -> str:
    rows = []
    for i, r in enumerate(R.rule_rows()):
        conf = R.rule_confidence(r["priority"])
        rows.append(f"({_q(r['rule_id'])}, {_q(r['keyword'])}, {_q(r['keyword_norm'])}, {_q(r['match_type'])}, "
                    f"{_q(r['account_code'])}, {_q(r['tax_code'])}, {r['priority']}, {conf}, {i})")
    return ",\n  ".join(rows)


def _rule_case() -> str:
    """Number of the first rule that fits an invoice, as one CASE over its normalised texts."""
    field = {"supplier_exact": "supplier_norm = {k}", "supplier_contains": "contains(supplier_norm, {k})",
             "description_contains": "contains(description_norm, {k})"}
    whens = [f"WHEN {field.get(r['match_type'], 'contains(haystack, {k})').format(k=_q(r['keyword_norm']))} THEN {i}"
             for i, r in enumerate(R.rule_rows())]
    return "CASE WHEN invoice_kind = 'sales' THEN NULL " + " ".join(whens) + " END"


def _coa_values() -> str:
    return ",\n  ".join(
        f"({_q(c)}, {_q(n)}, {_q(t)}, {_q(s)}, {_q(x)}, {str(a).upper()}, {_q(src)})"
        for c, n, t, s, x, a, src in R.DEFAULT_ACCOUNTS)


_view("o_coa", (), f"""
SELECT * FROM (VALUES
  {_coa_values()}) t(code, name, account_type, subtype, default_tax_code, active, source)""")

_view("o_rules", (), f"""
SELECT * FROM (VALUES
  {_rules_values()}) t(rule_id, keyword, keyword_norm, match_type, account_code, tax_code, priority, confidence, eval_order)""")

_view("o_classified", ("v_invoices", "o_rules", "o_coa"), f"""
WITH n AS (
  SELECT *, {_norm('supplier')} AS supplier_norm, {_norm('description')} AS description_norm FROM v_invoices),
h AS (SELECT *, trim(supplier_norm || ' ' || description_norm) AS haystack FROM n),
m AS (SELECT h.id, {_rule_case()} AS n FROM h),
f AS (SELECT m.id, r.* FROM m JOIN o_rules r ON r.eval_order = m.n),
c AS (
  SELECT h.*,
    CASE WHEN h.invoice_kind = 'sales' THEN '4000' WHEN f.id IS NOT NULL THEN f.account_code ELSE '6999' END AS c_account_code,
    CASE WHEN h.invoice_kind = 'sales' THEN coalesce(h.tax_code, 'GST') WHEN f.id IS NOT NULL THEN f.tax_code ELSE 'REVIEW' END AS c_tax_code,
    CASE WHEN h.invoice_kind = 'sales' THEN 0.99
         WHEN f.id IS NOT NULL AND abs(h.amount) >= 1000 AND f.account_code = '1500' THEN least(f.confidence, 0.9)
         WHEN f.id IS NOT NULL THEN f.confidence ELSE 0.35 END AS c_confidence,
    CASE WHEN h.invoice_kind = 'sales' THEN 'auto_approved'
         WHEN f.id IS NOT NULL AND abs(h.amount) >= 1000 AND f.account_code = '1500' THEN 'suggested'
         WHEN f.id IS NOT NULL AND f.confidence >= 0.95 THEN 'auto_approved'
         WHEN f.id IS NOT NULL THEN 'suggested' ELSE 'needs_review' END AS c_status,
    CASE WHEN h.invoice_kind = 'sales' THEN NULL ELSE f.rule_id END AS c_rule_id,
    CASE WHEN h.invoice_kind = 'sales' THEN NULL ELSE f.keyword END AS c_keyword
  FROM h LEFT JOIN f ON f.id = h.id)
SELECT c.*, coa.name AS c_account_name, coa.account_type AS c_account_type,
  abs(c.amount) AS total,
  CASE WHEN abs(coalesce(c.gst_amount, 0)) > 0 THEN abs(c.gst_amount)
       WHEN {str(P.GST_REGISTERED).upper()} AND c.c_tax_code = 'GST' THEN CAST(round(abs(c.amount) / 11, 2) AS DECIMAL(18,2))
       ELSE CAST(0 AS DECIMAL(18,2)) END AS gst,
  CASE WHEN c.c_status IN ('auto_approved', 'approved') THEN 'approved' ELSE 'needs_review' END AS c_validation
FROM c LEFT JOIN o_coa coa ON coa.code = c.c_account_code""")

_view("o_invoice_lines", ("o_classified", "o_coa"), f"""
WITH g AS (
  SELECT *,
    CASE WHEN abs(coalesce(gst_amount, 0)) > 0 THEN coalesce(nullif(abs(subtotal), 0), greatest(total - gst, 0))
         ELSE total - gst END AS net,
    CASE WHEN c_validation <> 'approved' THEN 'draft'
         WHEN invoice_date <= DATE '{P.OPENING_CUTOFF}' THEN 'included_in_opening' ELSE 'posted' END AS entry_status
  FROM o_classified),
l AS (
  SELECT company_id, id, entry_status, source_file, supplier, 1 AS line_number,
         CASE WHEN invoice_kind = 'sales' THEN '1100' ELSE c_account_code END AS account_code,
         CASE WHEN invoice_kind = 'sales' THEN total ELSE net END AS debit, CAST(0 AS DECIMAL(18,2)) AS credit,
         c_tax_code AS tax_code FROM g
  UNION ALL
  SELECT company_id, id, entry_status, source_file, supplier, 2,
         CASE WHEN invoice_kind = 'sales' THEN '4000' WHEN gst <> 0 THEN '1300' ELSE '2000' END,
         CASE WHEN invoice_kind = 'sales' THEN 0 WHEN gst <> 0 THEN gst ELSE 0 END,
         CASE WHEN invoice_kind = 'sales' THEN net WHEN gst <> 0 THEN 0 ELSE total END,
         CASE WHEN invoice_kind <> 'sales' AND gst <> 0 THEN 'GST' ELSE c_tax_code END FROM g
  UNION ALL
  SELECT company_id, id, entry_status, source_file, supplier, 3,
         CASE WHEN invoice_kind = 'sales' THEN '2100' ELSE '2000' END,
         0, CASE WHEN invoice_kind = 'sales' THEN gst ELSE total END,
         CASE WHEN invoice_kind = 'sales' THEN 'GST' ELSE c_tax_code END FROM g WHERE gst <> 0)
SELECT l.company_id, 'je-invoice-' || l.id || '-' || l.line_number AS id, 'je-invoice-' || l.id AS journal_id,
       l.line_number, l.account_code, coa.name AS account_name,
       CAST(l.debit AS DECIMAL(18,2)) AS debit, CAST(l.credit AS DECIMAL(18,2)) AS credit, l.tax_code,
       l.supplier AS counterparty, l.source_file, l.entry_status
FROM l LEFT JOIN o_coa coa ON coa.code = l.account_code""")

_OPEN_CASE = " ".join(
    "WHEN " + " OR ".join(f"contains(nl, {_q(tok)})" for tok in toks) + f" THEN {_q(code)}"
    for toks, code in R.OPENING_ACCOUNT_RULES)

_view("o_opening_lines", ("v_statements", "o_coa"), f"""
WITH latest AS (
  SELECT company_id, max(period_end) AS period_end FROM v_statements WHERE statement_type = 'balance_sheet' GROUP BY 1),
rows_ AS (
  SELECT s.company_id, s.line_item, s.amount, s.source_file, s.period_end, {_norm('s.line_item')} AS nl
  FROM v_statements s JOIN latest USING (company_id, period_end)
  WHERE s.statement_type = 'balance_sheet' AND abs(s.amount) >= 0.005),
mapped AS (
  SELECT *, CASE {_OPEN_CASE} ELSE NULL END AS mcode,
         row_number() OVER (PARTITION BY company_id ORDER BY line_item) AS line_number FROM rows_),
det AS (
  SELECT company_id, line_number, coalesce(mcode, CASE WHEN amount >= 0 THEN '1190' ELSE '2290' END) AS account_code,
         CASE WHEN amount >= 0 THEN abs(amount) ELSE 0 END AS debit, CASE WHEN amount < 0 THEN abs(amount) ELSE 0 END AS credit,
         line_item AS counterparty, source_file FROM mapped),
bal AS (
  SELECT company_id, max(line_number) + 1 AS line_number, '3000' AS account_code,
         CASE WHEN sum(debit) - sum(credit) > 0 THEN 0 ELSE abs(sum(debit) - sum(credit)) END AS debit,
         CASE WHEN sum(debit) - sum(credit) > 0 THEN sum(debit) - sum(credit) ELSE 0 END AS credit,
         'Opening equity' AS counterparty, 'Opening balance sheet' AS source_file
  FROM det GROUP BY 1 HAVING abs(sum(debit) - sum(credit)) >= 0.005),
al AS (SELECT * FROM det UNION ALL SELECT * FROM bal)
SELECT al.company_id, 'je-opening-balance-' || line_number AS id, 'je-opening-balance' AS journal_id, line_number,
       account_code, coa.name AS account_name, CAST(debit AS DECIMAL(18,2)) AS debit, CAST(credit AS DECIMAL(18,2)) AS credit,
       'N-T' AS tax_code, counterparty, source_file, 'posted' AS entry_status
FROM al LEFT JOIN o_coa coa ON coa.code = al.account_code""")

_view("o_lines", ("o_invoice_lines", "o_opening_lines"), """
SELECT * FROM o_invoice_lines UNION ALL SELECT * FROM o_opening_lines""")

_view("o_trial_balance", ("o_lines", "o_coa"), f"""
SELECT k.company_id, c.code, c.name, c.account_type, c.subtype, c.default_tax_code AS tax_code,
       coalesce(sum(l.debit), 0) AS debits, coalesce(sum(l.credit), 0) AS credits,
       CASE WHEN c.account_type IN ('asset', 'expense') THEN coalesce(sum(l.debit - l.credit), 0)
            ELSE coalesce(sum(l.credit - l.debit), 0) END AS balance,
       count(l.id) AS posted_lines
FROM o_coa c CROSS JOIN (SELECT DISTINCT company_id FROM o_lines) k
LEFT JOIN (SELECT * FROM o_lines WHERE entry_status = 'posted') l ON l.account_code = c.code AND l.company_id = k.company_id
WHERE c.active
GROUP BY k.company_id, c.code, c.name, c.account_type, c.subtype, c.default_tax_code""")


_view("o_monthly", ("v_transactions",), """
SELECT company_id, strftime(transaction_date, '%Y-%m') AS month,
       sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS revenue,
       sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS expenses
FROM v_transactions GROUP BY 1, 2""")

_view("o_snapshot", ("v_assets_liabilities", "o_trial_balance", "o_monthly", "v_invoices", "v_transactions"), f"""
WITH st AS (
  SELECT company_id,
    sum(CASE WHEN category = 'asset' AND classification = 'current' THEN amount ELSE 0 END) AS current_assets,
    sum(CASE WHEN category = 'liability' AND classification = 'current' THEN amount ELSE 0 END) AS current_liabilities,
    sum(CASE WHEN category = 'asset' AND contains(lower(name), 'inventory') THEN amount ELSE 0 END) AS inventory,
    sum(CASE WHEN category = 'asset' AND (id = 'asset-cash' OR contains(lower(name), 'cash')) THEN amount ELSE 0 END) AS cash,
    sum(CASE WHEN category = 'asset' THEN amount ELSE 0 END) AS total_assets,
    sum(CASE WHEN category = 'liability' THEN amount ELSE 0 END) AS total_liabilities
  FROM v_assets_liabilities GROUP BY company_id),
tb AS (SELECT *, CAST(round(CAST(balance AS DOUBLE), 2) AS DECIMAL(18,2)) AS b FROM o_trial_balance),
lg AS (
  SELECT company_id, sum(posted_lines) AS l_posted_lines,
    sum(CASE WHEN account_type = 'asset' AND contains(lower(subtype), 'current') AND NOT contains(lower(subtype), 'non-current') THEN b ELSE 0 END) AS l_current_assets,
    sum(CASE WHEN account_type = 'liability' AND contains(lower(subtype), 'current') AND NOT contains(lower(subtype), 'non-current') THEN b ELSE 0 END) AS l_current_liabilities,
    sum(CASE WHEN account_type = 'asset' AND contains(lower(name), 'inventory') THEN b ELSE 0 END) AS l_inventory,
    sum(CASE WHEN account_type = 'asset' AND (contains(lower(name), 'cash') OR contains(lower(name), 'bank')) THEN b ELSE 0 END) AS l_cash,
    sum(CASE WHEN account_type = 'asset' THEN b ELSE 0 END) AS l_total_assets,
    sum(CASE WHEN account_type = 'liability' THEN b ELSE 0 END) AS l_total_liabilities,
    sum(CASE WHEN account_type = 'revenue' THEN b ELSE 0 END) AS l_revenue,
    sum(CASE WHEN account_type = 'expense' THEN b ELSE 0 END) AS l_expenses
  FROM tb GROUP BY company_id),
mr AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS rn FROM o_monthly),
mo AS (
  SELECT company_id, count(*) AS months, sum(CASE WHEN rn = 1 THEN revenue ELSE 0 END) AS rev1,
         sum(CASE WHEN rn = 1 THEN expenses ELSE 0 END) AS exp1, sum(CASE WHEN rn = 2 THEN revenue ELSE 0 END) AS rev2
  FROM mr WHERE rn <= 2 GROUP BY company_id),
iv AS (
  SELECT company_id, sum(CASE WHEN status NOT IN ('paid', 'cancelled') THEN amount ELSE 0 END) AS open_total,
         sum(CASE WHEN status NOT IN ('paid', 'cancelled') AND due_date < DATE '{P.AS_OF}' THEN amount ELSE 0 END) AS overdue_total
  FROM v_invoices GROUP BY company_id),
an AS (SELECT company_id, count(CASE WHEN status IN ('anomaly', 'critical') THEN 1 END) AS anomaly_count
       FROM v_transactions GROUP BY company_id),
b AS (
  SELECT lg.company_id, coalesce(l_posted_lines, 0) > 0 AS use_ledger,
    CASE WHEN coalesce(l_posted_lines, 0) > 0 THEN l_current_assets ELSE coalesce(st.current_assets, 0) END AS ca,
    CASE WHEN coalesce(l_posted_lines, 0) > 0 THEN l_current_liabilities ELSE coalesce(st.current_liabilities, 0) END AS cl,
    CASE WHEN coalesce(l_posted_lines, 0) > 0 THEN l_inventory ELSE coalesce(st.inventory, 0) END AS inv,
    CASE WHEN coalesce(l_posted_lines, 0) > 0 THEN l_cash ELSE coalesce(st.cash, 0) END AS cash,
    CASE WHEN coalesce(l_posted_lines, 0) > 0 THEN l_total_assets ELSE coalesce(st.total_assets, 0) END AS ta,
    CASE WHEN coalesce(l_posted_lines, 0) > 0 THEN l_total_liabilities ELSE coalesce(st.total_liabilities, 0) END AS tl,
    CASE WHEN coalesce(months, 0) > 0 THEN rev1 ELSE coalesce(l_revenue, 0) END AS rev,
    CASE WHEN coalesce(months, 0) > 0 THEN exp1 ELSE coalesce(l_expenses, 0) END AS exp,
    CASE WHEN coalesce(months, 0) > 1 THEN rev2 WHEN coalesce(months, 0) > 0 THEN rev1 ELSE coalesce(l_revenue, 0) END AS prev,
    coalesce(open_total, 0) AS open_total, coalesce(overdue_total, 0) AS overdue_total,
    CAST(coalesce(anomaly_count, 0) AS BIGINT) AS anomaly_count
  FROM lg LEFT JOIN st USING (company_id) LEFT JOIN mo USING (company_id) LEFT JOIN iv USING (company_id)
  LEFT JOIN an USING (company_id)),
d AS (
  SELECT *, CAST(ca AS DOUBLE) AS ca_d, CAST(cl AS DOUBLE) AS cl_d, CAST(inv AS DOUBLE) AS inv_d,
         CAST(cash AS DOUBLE) AS cash_d, CAST(ta AS DOUBLE) AS ta_d, CAST(tl AS DOUBLE) AS tl_d,
         CAST(rev AS DOUBLE) AS rv, CAST(exp AS DOUBLE) AS ex, CAST(prev AS DOUBLE) AS pv, CAST(open_total AS DOUBLE) AS ot
  FROM b)
SELECT company_id,
  round(ca_d, 2) AS current_assets, round(cl_d, 2) AS current_liabilities,
  CASE WHEN cl_d <> 0 THEN round(ca_d / cl_d, 2) END AS current_ratio,
  CASE WHEN cl_d <> 0 THEN round((ca_d - inv_d) / cl_d, 2) END AS quick_ratio,
  round(CAST(ca - cl AS DOUBLE), 2) AS working_capital, round(cash_d, 2) AS cash, round(inv_d, 2) AS inventory,
  round(ta_d, 2) AS total_assets, round(tl_d, 2) AS total_liabilities,
  CASE WHEN ta_d <> 0 THEN round(tl_d / ta_d, 2) END AS debt_to_assets, anomaly_count,
  round(rv, 2) AS revenue_month, round(ex, 2) AS expenses_month,
  CASE WHEN pv <> 0 THEN round((rv - pv) / pv * 100, 1) ELSE 0.0 END AS revenue_change,
  CASE WHEN rv <> 0 THEN round((rv - ex) / rv * 100, 1) ELSE 0.0 END AS gross_margin,
  CAST(round_even(ot / greatest(rv, 1.0) * 30, 0) AS BIGINT) AS receivable_days,
  CAST(round_even(cl_d / greatest(ex, 1.0) * 30, 0) AS BIGINT) AS payable_days,
  CASE WHEN ex / 30 <> 0 THEN CAST(trunc(cash_d / (ex / 30)) AS BIGINT) ELSE 0 END AS cash_runway_days,
  round(ot, 2) AS open_invoice_total, round(CAST(overdue_total AS DOUBLE), 2) AS overdue_invoice_total,
  CASE WHEN use_ledger THEN 'posted_ledger' ELSE 'assets_liabilities' END AS position_basis
FROM d""")

_view("o_forecast", ("o_snapshot", "v_transactions", "v_invoices"), f"""
WITH r AS (
  SELECT company_id, sum(amount) AS net, count(*) AS n FROM v_transactions
  WHERE transaction_date >= DATE '{P.AS_OF}' - 90 GROUP BY company_id),
base AS (
  SELECT s.company_id, s.cash,
         coalesce(CAST(r.net AS DOUBLE), 0.0) / CASE WHEN coalesce(r.n, 0) > 0 THEN 90.0 ELSE 30.0 END AS daily_net
  FROM o_snapshot s LEFT JOIN r USING (company_id)),
due AS (
  SELECT company_id, CAST(ceil(date_diff('day', DATE '{P.AS_OF}', due_date) / 7) AS INTEGER) AS step, sum(amount) AS due
  FROM v_invoices
  WHERE status NOT IN ('paid', 'cancelled') AND due_date BETWEEN DATE '{P.AS_OF}' AND DATE '{P.AS_OF}' + 90
  GROUP BY 1, 2),
grid AS (SELECT base.*, CAST(step AS INTEGER) AS step FROM base, range(0, {P.FORECAST_DAYS // 7 + 1}) t(step)),
j AS (
  SELECT g.*, sum(coalesce(d.due, 0)) OVER (PARTITION BY g.company_id ORDER BY g.step
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_due
  FROM grid g LEFT JOIN due d ON d.company_id = g.company_id AND d.step = g.step AND d.step BETWEEN 1 AND {P.FORECAST_DAYS // 7})
SELECT company_id, step, DATE '{P.AS_OF}' + step * 7 AS date, strftime(DATE '{P.AS_OF}' + step * 7, '%d %b') AS label,
       round(cash + (step * 7) * daily_net - CAST(cum_due AS DOUBLE), 2) AS forecast,
       round(daily_net, 2) AS daily_net_assumption
FROM j""")

_view("v_batch_old", (), f"""
SELECT {_q(P.COMPANY)} AS company_id, 'customers' AS document_type, 'C-' || c_custkey AS code, c_name AS name,
       CAST(c_nationkey AS VARCHAR) AS country, c_mktsegment AS segment, {_money(_cents('c_acctbal'))} AS balance,
       c_custkey * 2 AS seq
FROM customer""")

_view("v_batch_new", (), f"""
WITH b AS (SELECT *, {_cents('c_acctbal')} + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END AS bc
           FROM customer WHERE c_custkey % 13 <> 0),
r AS (
  SELECT 'C-' || c_custkey AS code, c_name, c_nationkey, c_mktsegment, bc AS cents, c_custkey * 2 AS seq FROM b
  UNION ALL SELECT 'C-' || c_custkey, c_name, c_nationkey, c_mktsegment, bc + 200, c_custkey * 2 + 1 FROM b WHERE c_custkey % 17 = 0
  UNION ALL SELECT 'C-N' || c_custkey, c_name, c_nationkey, c_mktsegment, bc, c_custkey * 2 FROM b WHERE c_custkey % 19 = 0)
SELECT {_q(P.COMPANY)} AS company_id, 'customers' AS document_type, code, c_name AS name, CAST(c_nationkey AS VARCHAR) AS country,
       c_mktsegment AS segment, {_money('cents')} AS balance, seq
FROM r""")

def with_views(*names: str) -> str:
    """``WITH`` clause holding the named views and their dependencies (topologically ordered)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        deps, _ = _VIEWS[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n][1]}\n)" for n in order) + "\n"


def view_names() -> list[str]:
    return list(_VIEWS)
