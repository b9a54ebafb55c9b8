"""Ledger queries: classification, journals, trial balance and the accounting dashboard pieces."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import params as P
from ..context import Ctx
from ..functions.expr import out_money
from ..operators import windows as WN
from ..oracle.views import with_views as W
from ..registry import query
from . import ledger as L


@query("trial_balance", W("o_trial_balance") + """
SELECT company_id, code, name, account_type, subtype, tax_code,
       round(CAST(debits AS DOUBLE), 2) AS debits, round(CAST(credits AS DOUBLE), 2) AS credits,
       round(CAST(balance AS DOUBLE), 2) AS balance, CAST(posted_lines AS BIGINT) AS posted_lines
FROM o_trial_balance""")
def q_trial_balance(c: Ctx):
    """Chart of accounts with posted debits, credits and signed balance (opening + invoice journals)."""
    return c.trial_balance


@query("rule_first_match", W("o_classified") + """
SELECT id, c_rule_id AS rule_id, c_keyword AS keyword, c_account_code AS account_code,
       c_account_name AS account_name, c_account_type AS account_type, c_tax_code AS tax_code,
       CAST(c_confidence AS DOUBLE) AS confidence, c_status AS status
FROM o_classified WHERE invoice_kind <> 'sales'""")
def q_rule_first_match(c: Ctx):
    """First categorisation rule per supplier invoice (priority desc, keyword length desc), as
    stored on the invoices Gold table (built by ``ledger.rule_first_match``)."""
    df = c.classified.filter(F.col("invoice_kind") != "sales")
    return df.select("id", "rule_id", "keyword", F.col("c_account_code").alias("account_code"),
                     F.col("c_account_name").alias("account_name"), F.col("c_account_type").alias("account_type"),
                     F.col("c_tax_code").alias("tax_code"), F.col("c_confidence").cast("double").alias("confidence"),
                     F.col("c_status").alias("status"))


@query("gst_split", W("o_classified") + """
SELECT id, invoice_kind, c_tax_code AS tax_code, round(CAST(total AS DOUBLE), 2) AS total,
       round(CAST(gst AS DOUBLE), 2) AS gst, round(CAST(total - gst AS DOUBLE), 2) AS net
FROM o_classified""")
def q_gst_split(c: Ctx):
    """Per-invoice GST split: explicit GST, else total/11 for GST-coded invoices when registered."""
    df = c.classified
    return df.select("id", "invoice_kind", F.col("c_tax_code").alias("tax_code"), out_money("total").alias("total"),
                     out_money("gst").alias("gst"), out_money("net").alias("net"))


@query("journal_lines", W("o_lines") + """
SELECT company_id, id, journal_id, CAST(line_number AS INTEGER) AS line_number, account_code, account_name,
       round(CAST(debit AS DOUBLE), 2) AS debit, round(CAST(credit AS DOUBLE), 2) AS credit, tax_code,
       counterparty, source_file, entry_status
FROM o_lines""")
def q_journal_lines(c: Ctx):
    """All journal lines (opening balance + invoice journals) with their entry status."""
    return c.lines.select("company_id", "id", "journal_id", F.col("line_number").cast("int").alias("line_number"),
                          "account_code", "account_name", out_money("debit").alias("debit"),
                          out_money("credit").alias("credit"), "tax_code", "counterparty", "source_file", "entry_status")


@query("journal_balance_check", W("o_lines") + """
SELECT company_id, journal_id, round(CAST(sum(debit) AS DOUBLE), 2) AS debit_total, round(CAST(sum(credit) AS DOUBLE), 2) AS credit_total
FROM o_lines GROUP BY company_id, journal_id HAVING sum(debit) <> sum(credit)""")
def q_journal_balance_check(c: Ctx):
    """Journals whose debits and credits differ (expected empty: every journal balances)."""
    return (c.lines.groupBy("company_id", "journal_id").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"))
            .filter(F.col("d") != F.col("c"))
            .select("company_id", "journal_id", out_money("d").alias("debit_total"), out_money("c").alias("credit_total")))


@query("journal_status_counts", W("o_lines", "v_invoices") + """
SELECT company_id, entry_status AS status, count(DISTINCT journal_id) AS journals, CAST(count(*) AS BIGINT) AS lines,
       round(CAST(sum(debit) AS DOUBLE), 2) AS debits
FROM o_lines GROUP BY company_id, entry_status""")
def q_journal_status_counts(c: Ctx):
    """Journals, lines and debit volume per entry status (draft / included_in_opening / posted)."""
    return (c.lines.groupBy("company_id", F.col("entry_status").alias("status"))
            .agg(F.countDistinct("journal_id").cast("bigint").alias("journals"), F.count("*").cast("bigint").alias("lines"),
                 out_money(F.sum("debit")).alias("debits")))


@query("account_type_summary", W("o_trial_balance") + """
SELECT company_id, round(CAST(sum(CASE WHEN account_type = 'asset' THEN balance ELSE 0 END) AS DOUBLE), 2) AS assets,
       round(CAST(sum(CASE WHEN account_type = 'liability' THEN balance ELSE 0 END) AS DOUBLE), 2) AS liabilities,
       round(CAST(sum(CASE WHEN account_type = 'equity' THEN balance ELSE 0 END) AS DOUBLE), 2) AS equity,
       round(CAST(sum(CASE WHEN account_type = 'revenue' THEN balance ELSE 0 END) AS DOUBLE), 2) AS revenue,
       round(CAST(sum(CASE WHEN account_type = 'expense' THEN balance ELSE 0 END) AS DOUBLE), 2) AS expenses,
       round(CAST(sum(CASE WHEN account_type = 'revenue' THEN balance WHEN account_type = 'expense' THEN -balance ELSE 0 END) AS DOUBLE), 2) AS profit,
       round(CAST(sum(CASE WHEN code = '1100' THEN balance ELSE 0 END) AS DOUBLE), 2) AS accounts_receivable,
       round(CAST(sum(CASE WHEN code = '2000' THEN balance ELSE 0 END) AS DOUBLE), 2) AS accounts_payable,
       round(CAST(sum(CASE WHEN code = '1300' THEN balance ELSE 0 END) AS DOUBLE), 2) AS gst_receivable,
       round(CAST(sum(CASE WHEN code = '2100' THEN balance ELSE 0 END) AS DOUBLE), 2) AS gst_payable,
       round(CAST(sum(CASE WHEN code = '2100' THEN balance WHEN code = '1300' THEN -balance ELSE 0 END) AS DOUBLE), 2) AS net_gst
FROM o_trial_balance GROUP BY company_id""")
def q_account_type_summary(c: Ctx):
    """Asset/liability/equity/revenue/expense totals, profit, AR, AP and GST control balances."""
    return account_type_summary(c)


def account_type_summary(c: Ctx):
    tb = c.trial_balance.withColumn("b", F.col("balance").cast("decimal(18,2)"))
    t, code, b = F.col("account_type"), F.col("code"), F.col("b")

    def s(cond, val=b):
        return out_money(F.sum(F.when(cond, val).otherwise(F.lit(0))))

    return tb.groupBy("company_id").agg(
        s(t == "asset").alias("assets"), s(t == "liability").alias("liabilities"), s(t == "equity").alias("equity"),
        s(t == "revenue").alias("revenue"), s(t == "expense").alias("expenses"),
        out_money(F.sum(F.when(t == "revenue", b).when(t == "expense", -b).otherwise(F.lit(0)))).alias("profit"),
        s(code == "1100").alias("accounts_receivable"), s(code == "2000").alias("accounts_payable"),
        s(code == "1300").alias("gst_receivable"), s(code == "2100").alias("gst_payable"),
        out_money(F.sum(F.when(code == "2100", b).when(code == "1300", -b).otherwise(F.lit(0)))).alias("net_gst"))


@query("journal_totals", W("o_lines", "v_invoices") + f"""
, e AS (
  SELECT company_id, 'je-invoice-' || id AS id, invoice_date AS entry_date, invoice_number AS reference, 'invoice' AS source_type,
         id AS source_id FROM v_invoices
  UNION ALL SELECT DISTINCT company_id, 'je-opening-balance', DATE '{P.OPENING_CUTOFF}', 'OPEN-{P.OPENING_CUTOFF}', 'opening_balance', '{P.OPENING_CUTOFF}' FROM v_invoices)
SELECT e.company_id, e.id, e.entry_date, e.reference, e.source_type, e.source_id,
       round(CAST(sum(l.debit) AS DOUBLE), 2) AS debit_total, round(CAST(sum(l.credit) AS DOUBLE), 2) AS credit_total
FROM e LEFT JOIN o_lines l ON l.journal_id = e.id AND l.company_id = e.company_id
GROUP BY e.company_id, e.id, e.entry_date, e.reference, e.source_type, e.source_id
QUALIFY row_number() OVER (PARTITION BY e.company_id ORDER BY e.entry_date DESC, e.id DESC) <= 100""")
def q_journal_totals(c: Ctx):
    """Newest 100 journals of each company with their debit and credit totals: the journals are picked first, then
    only their lines are added up."""
    newest = WN.top_k_per_group(c.entries, ["company_id"], 100, [F.col("entry_date").desc(), F.col("id").desc()])
    shown = newest.select("company_id", F.col("id").alias("journal_id"))
    tot = (c.lines.select("company_id", "journal_id", "debit", "credit").join(shown, ["company_id", "journal_id"], "left_semi")
           .groupBy("company_id", F.col("journal_id").alias("id")).agg(F.sum("debit").alias("d"), F.sum("credit").alias("cr")))
    return (newest.join(tot, ["company_id", "id"], "left")
            .select("company_id", "id", "entry_date", "reference", "source_type", "source_id",
                    out_money("d").alias("debit_total"), out_money("cr").alias("credit_total")))


@query("review_tasks", W("o_classified") + """
SELECT 'task-' || substr(sha1(id), 1, 16) AS id, 'invoice_categorisation' AS task_type, id AS source_id, source_file,
       supplier AS counterparty, coalesce(nullif(description, ''), invoice_number) AS description,
       round(CAST(total AS DOUBLE), 2) AS amount, c_account_code AS suggested_account_code,
       c_account_name AS suggested_account_name, c_tax_code AS suggested_tax_code,
       CAST(c_confidence AS DOUBLE) AS confidence, 'open' AS status
FROM o_classified WHERE c_validation <> 'approved'""")
def q_review_tasks(c: Ctx):
    """One open categorisation task per invoice that is not approved."""
    return review_tasks(c)


def review_tasks(c: Ctx):
    df = c.classified.filter(F.col("c_validation") != "approved")
    return df.select(
        F.concat(F.lit("task-"), F.substring(F.sha1(F.col("id")), 1, 16)).alias("id"),
        F.lit("invoice_categorisation").alias("task_type"), F.col("id").alias("source_id"), "source_file",
        F.col("supplier").alias("counterparty"),
        F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("invoice_number")).alias("description"),
        out_money("total").alias("amount"), F.col("c_account_code").alias("suggested_account_code"),
        F.col("c_account_name").alias("suggested_account_name"), F.col("c_tax_code").alias("suggested_tax_code"),
        F.col("c_confidence").cast("double").alias("confidence"), F.lit("open").alias("status"))


@query("task_queue", W("o_classified") + """
SELECT company_id, 'task-' || substr(sha1(id), 1, 16) AS id, id AS source_id, CAST(c_confidence AS DOUBLE) AS confidence,
       round(CAST(total AS DOUBLE), 2) AS amount
FROM o_classified WHERE c_validation <> 'approved'
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY c_confidence, invoice_date DESC, o_classified.id) <= 100""")
def q_task_queue(c: Ctx):
    """Top 100 open review tasks of each company: lowest confidence first, newest first, id as tie-break."""
    df = c.classified.filter(F.col("c_validation") != "approved")
    return (WN.top_k_per_group(df, ["company_id"], 100, [F.col("c_confidence").asc(), F.col("invoice_date").desc(), F.col("id").asc()])
            .select("company_id", F.concat(F.lit("task-"), F.substring(F.sha1(F.col("id")), 1, 16)).alias("id"),
                    F.col("id").alias("source_id"), F.col("c_confidence").cast("double").alias("confidence"),
                    out_money("total").alias("amount")))


@query("opening_journal", W("o_opening_lines") + """
SELECT id, CAST(line_number AS INTEGER) AS line_number, account_code, account_name,
       round(CAST(debit AS DOUBLE), 2) AS debit, round(CAST(credit AS DOUBLE), 2) AS credit, counterparty
FROM o_opening_lines""")
def q_opening_journal(c: Ctx):
    """Opening journal from the latest balance sheet, balanced to Owner equity."""
    _, ln = L.opening_journal(c.statements)
    return ln.select("id", F.col("line_number").cast("int").alias("line_number"), "account_code", "account_name",
                     out_money("debit").alias("debit"), out_money("credit").alias("credit"), "counterparty")


@query("ledger_account_balance", W("o_lines") + """
SELECT company_id, account_code, round(CAST(sum(CASE WHEN account_code = '2300' THEN credit - debit ELSE debit - credit END) AS DOUBLE), 2) AS net
FROM o_lines WHERE entry_status = 'posted' AND account_code IN ('6220', '2300', '1300', '2100')
GROUP BY company_id, account_code""")
def q_ledger_account_balance(c: Ctx):
    """Posted net movement for selected control accounts (wages, PAYG, GST)."""
    ln = L.posted_lines(c.lines).filter(F.col("account_code").isin("6220", "2300", "1300", "2100"))
    net = F.when(F.col("account_code") == "2300", F.col("credit") - F.col("debit")).otherwise(F.col("debit") - F.col("credit"))
    return ln.groupBy("company_id", "account_code").agg(out_money(F.sum(net)).alias("net"))


@query("position_from_ledger", W("o_lines", "o_coa") + """
, b AS (
  SELECT l.company_id, CASE
      WHEN c.account_type = 'asset' AND (lower(c.name) LIKE '%cash%' OR lower(c.name) LIKE '%bank%') THEN 'Cash'
      WHEN c.account_type = 'asset' AND lower(c.name) LIKE '%receivable%' THEN 'Receivables'
      WHEN c.account_type = 'asset' AND lower(c.name) LIKE '%inventory%' THEN 'Inventory'
      WHEN c.account_type = 'asset' AND lower(c.subtype) LIKE '%current%' AND lower(c.subtype) NOT LIKE '%non-current%' THEN 'Other current assets'
      WHEN c.account_type = 'asset' THEN 'Non-current assets'
      WHEN c.account_type = 'liability' AND lower(c.subtype) LIKE '%current%' AND lower(c.subtype) NOT LIKE '%non-current%' THEN 'Current liabilities'
      WHEN c.account_type = 'liability' THEN 'Non-current liabilities'
      ELSE 'Other' END AS label,
    CASE WHEN c.account_type IN ('asset', 'expense') THEN l.debit - l.credit ELSE l.credit - l.debit END AS v
  FROM o_lines l JOIN o_coa c ON c.code = l.account_code
  WHERE l.entry_status = 'posted' AND c.account_type IN ('asset', 'liability'))
SELECT company_id, label, round(abs(CAST(sum(v) AS DOUBLE)), 2) AS value FROM b GROUP BY company_id, label HAVING abs(sum(v)) > 0.005""")
def q_position_from_ledger(c: Ctx):
    """Financial position buckets from posted ledger lines (3-way join collapsed to a map lookup)."""
    return position_from_ledger(c)


def ledger_bucket(account_type, name, subtype):
    n, s = F.lower(name), F.lower(subtype)
    return (F.when((account_type == "asset") & (n.contains("cash") | n.contains("bank")), "Cash")
            .when((account_type == "asset") & n.contains("receivable"), "Receivables")
            .when((account_type == "asset") & n.contains("inventory"), "Inventory")
            .when((account_type == "asset") & s.contains("current") & ~s.contains("non-current"), "Other current assets")
            .when(account_type == "asset", "Non-current assets")
            .when((account_type == "liability") & s.contains("current") & ~s.contains("non-current"), "Current liabilities")
            .when(account_type == "liability", "Non-current liabilities")
            .otherwise("Other"))


def position_from_ledger(c: Ctx):
    agg = (L.posted_lines(c.lines).groupBy("company_id", "account_code")
           .agg(F.sum(F.col("debit") - F.col("credit")).alias("dc")))
    coa = c.coa.filter(F.col("account_type").isin("asset", "liability"))
    j = agg.join(coa, agg.account_code == coa.code)
    v = F.when(F.col("account_type").isin("asset", "expense"), F.col("dc")).otherwise(-F.col("dc"))
    return (j.groupBy("company_id", ledger_bucket(F.col("account_type"), F.col("name"), F.col("subtype")).alias("label"))
            .agg(F.sum(v).alias("v")).filter(F.abs("v") > 0.005)
            .select("company_id", "label", F.round(F.abs(F.col("v").cast("double")), 2).alias("value")))
