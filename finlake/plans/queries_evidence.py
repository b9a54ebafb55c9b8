"""Catalogue coverage, type sets, effective dates, file findings and tax schemes, five companies in each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..context import Ctx
from ..functions import rules as R
from ..functions.expr import out_money
from ..operators import evidence as E
from ..oracle.views import with_views as W
from ..registry import query

# -- upload registry: one upload for each document, its recorded types and status from the document's columns ----

STEMS = (*P.UPLOAD_FILE_STEMS, "scan", "bank_statement_20240315", "payroll March 2024", "FY2023 tax_return", "notes-june 2023-may 2024")
STORED = ("generic", "invoices", "balance_sheet", "profiling", "transactions", "mixed_business_workbook", " Payroll ", "contracts", "profit_loss", "auto")
DETECTED = ("", "assets|liabilities", "generic", "sales_invoices|bank_statements", "profiling|budgets")
DECLARED = ("auto", "auto", "auto", "chart_of_accounts", "auto", "auto", "Budgets")
PERIOD_END = ("", "n/a", "2023-06-30T00:00:00")


def _case(key: str, values) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _registry_sql(table: str) -> str:
    return (f"SELECT 'co-' || CAST(doc_id % 5 AS STRING) AS company_id, doc_id AS upload_id, {_case('doc_id', STEMS)} || '_' || CAST(doc_id AS STRING) || '.csv' AS filename, "
            f"CASE WHEN n_chars % 3 = 0 THEN {_case('n_chars', STORED)} END AS document_type, {_case('n_chars', DETECTED)} AS detected, "
            f"CASE WHEN n_chars % 11 = 0 THEN 'cash_flow_statement' END AS analysed_type, {_case('n_chars', DECLARED)} AS declared_type, "
            f"{_case('(doc_id + n_chars)', (*P.UPLOAD_STATUSES, 'processing'))} AS processing_status, "
            f"CASE WHEN n_chars % 13 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'setup' ELSE 'recurring' END AS intake_category, "
            f"{_case('n_chars', PERIOD_END)} AS period_end, DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS processed FROM {table}")


def registry(c: Ctx) -> DataFrame:
    rows = c.spark.sql(_registry_sql("{documents}"), documents=c.t.documents)
    return rows.withColumn("detected_types", F.split("detected", r"\|"))


def _types_sql() -> str:
    canon = lambda x: f"CASE lower(trim({x})) " + " ".join(f"WHEN '{a}' THEN '{t}'" for a, t in E.TYPE_ALIASES.items()) + f" ELSE lower(trim({x})) END"
    words = lambda ws: "(" + ", ".join(f"'{w}'" for w in ("", *ws)) + ")"
    hints = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(sig, '{w}')" for w in ws) + f" THEN '{t}'" for t, ws in R.FILENAME_HINT_RULES) + " END"
    return f"""up AS (SELECT *, regexp_replace(lower(filename), '[^a-z0-9]+', '_', 'g') AS sig FROM ({_registry_sql('documents')})),
told AS (
  SELECT upload_id, {canon('document_type')} AS t FROM up WHERE {canon('document_type')} NOT IN {words(E.STORED_VAGUE)}
  UNION SELECT upload_id, {canon('d')} FROM (SELECT upload_id, unnest(string_split(detected, '|')) AS d FROM up) WHERE {canon('d')} NOT IN {words(E.DETECTED_VAGUE)}
  UNION SELECT upload_id, {canon('analysed_type')} FROM up WHERE {canon('analysed_type')} NOT IN {words(E.DETECTED_VAGUE)}
  UNION SELECT upload_id, {canon('declared_type')} FROM up WHERE {canon('declared_type')} NOT IN {words(E.DECLARED_VAGUE)}),
hinted AS (SELECT upload_id, {hints} AS t FROM up WHERE upload_id NOT IN (SELECT upload_id FROM told)),
ty AS (SELECT upload_id, t, true AS told FROM told UNION ALL SELECT upload_id, t, false FROM hinted WHERE t IS NOT NULL)"""


@query("upload_type_set", "WITH " + _types_sql() + """
SELECT company_id, upload_id, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM told WHERE told.upload_id = up.upload_id), '') AS types,
       coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM ty WHERE ty.upload_id = up.upload_id), '') AS intended FROM up""")
def q_upload_type_set(c: Ctx):
    """Every type an upload is known under, and the type its name hints at where there is none."""
    return E.with_types(registry(c)).select("company_id", "upload_id", F.array_join("types", ",").alias("types"), F.array_join("intended", ",").alias("intended"))


_DONE = "(" + ", ".join(f"'{s}'" for s in R.COMPLETE_UPLOAD_STATUSES) + ")"


@query("coverage_by_catalogue", "WITH " + _types_sql() + f""",
cat AS (SELECT * FROM (VALUES {", ".join(f"('{i}', '{k}', '{t}')" for i, k, t in E.CATALOGUE)}) v(id, intake_category, tier)),
n AS (SELECT co.company_id, cat.*,
        (SELECT count(*) FROM up JOIN ty USING (upload_id) WHERE up.company_id = co.company_id AND coalesce(up.intake_category, 'recurring') = cat.intake_category AND ty.t = cat.id) AS attempt_count,
        (SELECT count(*) FROM up JOIN ty USING (upload_id) WHERE up.company_id = co.company_id AND coalesce(up.intake_category, 'recurring') = cat.intake_category AND ty.t = cat.id AND processing_status IN {_DONE}) AS file_count,
        (SELECT count(*) FROM up JOIN ty USING (upload_id) WHERE up.company_id = co.company_id AND coalesce(up.intake_category, 'recurring') = cat.intake_category AND ty.t = cat.id AND processing_status IN {_DONE} AND told) AS known
      FROM (SELECT DISTINCT company_id FROM up) co CROSS JOIN cat)
SELECT company_id, id, intake_category, tier, file_count > 0 AS received, file_count, attempt_count, attempt_count - file_count AS retry_count,
       CASE WHEN file_count > 0 THEN 'received' WHEN attempt_count > 0 THEN 'needs_retry' ELSE 'missing' END AS state, known > 0 AS covered FROM n""")
def q_coverage(c: Ctx):
    """Received, to be retried or missing: every document of the catalogue for every company."""
    return E.coverage_by_catalogue(registry(c))


def _month_sql() -> str:
    said = lambda m: f"regexp_extract(translate(filename, '_-', '  '), '\\b{m}\\s+(20[0-9]{{2}})\\b', 1, 'i')"
    return ", ".join(f"nullif({said(m)}, '') || '-{i:02d}-01'" for i, m in enumerate(E.MONTHS, 1))


@query("effective_date_infer", f"""
WITH up AS ({_registry_sql('documents')}),
p AS (SELECT *, regexp_extract(trim(period_end), '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS given,
             regexp_extract(filename, '(20[0-9]{{2}})[ _.-]?(0[1-9]|1[0-2])[ _.-]?([0-3][0-9])', ['y', 'm', 'd']) AS s,
             regexp_extract(translate(filename, '_-', '  '), 'FY\\s?(20[0-9]{{2}})', 1, 'i') AS fy FROM up)
SELECT company_id, upload_id, coalesce(nullif(given, ''), CASE WHEN s.y <> '' THEN s.y || '-' || s.m || '-' || s.d END, {_month_sql()},
       nullif(fy, '') || '-06-30', strftime(processed, '%Y-%m-%d')) AS effective_date FROM p""")
def q_effective_date(c: Ctx):
    """The date each upload speaks for, from its metadata, its name or the day it was processed."""
    return registry(c).select("company_id", "upload_id", E.effective_date(F.col("filename"), [F.col("period_end")], F.col("processed")).alias("effective_date"))


# -- typed tables with five companies, by the last character of the row's key ------------------------------------

def _tenant(key: str) -> str:
    return f"'co-' || CAST(ascii(right({key}, 1)) % 5 AS STRING)"


def _typed(tables: dict[str, str]) -> str:
    """Rows of four kinds of file; Spark and DuckDB read the same text."""
    return f"""SELECT {_tenant('id')} AS company_id, source_file AS file_id, CASE WHEN invoice_kind = 'sales' THEN 'sales_invoices' ELSE 'supplier_invoices' END AS document_type,
        invoice_number AS name, supplier AS party, amount, CAST(NULL AS DECIMAL(18,2)) AS tax FROM {tables['invoices']}
  UNION ALL SELECT {_tenant('id')}, source_file, 'bank_statements', CAST(NULL AS STRING), CAST(NULL AS STRING), amount, CAST(NULL AS DECIMAL(18,2)) FROM {tables['bank']}
  UNION ALL SELECT {_tenant('id')}, source_file, 'payroll', pay_period, employee, gross_pay, payg_withholding FROM {tables['payroll']}
  UNION ALL SELECT {_tenant('id')}, source_file, 'assets', name, CAST(NULL AS STRING), total_value, CAST(NULL AS DECIMAL(18,2)) FROM {tables['inventory']}"""


@query("file_findings", W("v_invoices", "v_bank", "v_payroll", "v_inventory") + f"""
, t AS ({_typed({'invoices': 'v_invoices', 'bank': 'v_bank', 'payroll': 'v_payroll', 'inventory': 'v_inventory'})}),
a AS (SELECT company_id, file_id, document_type, count(*) AS rows, round(CAST(sum(amount) AS DOUBLE), 2) AS total, round(CAST(coalesce(sum(tax), 0) AS DOUBLE), 2) AS tax,
             round(CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE), 2) AS inflow, round(CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DOUBLE), 2) AS outflow
      FROM t GROUP BY ALL),
pd AS (SELECT DISTINCT company_id, file_id, document_type, trim(party) AS party FROM t WHERE trim(party) <> ''),
pr AS (SELECT *, row_number() OVER (PARTITION BY company_id, file_id, document_type ORDER BY party) AS k FROM pd),
pn AS (SELECT company_id, file_id, document_type, count(*) AS parties, string_agg(party, ', ' ORDER BY k) FILTER (k <= {E.NAMED}) AS counterparties FROM pr GROUP BY ALL),
ir AS (SELECT *, row_number() OVER (PARTITION BY company_id, file_id, document_type ORDER BY abs(amount) DESC, name) AS k FROM t WHERE trim(name) <> ''),
i AS (SELECT company_id, file_id, document_type, string_agg(name || '=' || CAST(CAST(abs(amount) AS DECIMAL(18,2)) AS STRING), ', ' ORDER BY k) AS positions FROM ir WHERE k <= {E.NAMED} GROUP BY ALL)
SELECT a.*, coalesce(parties, 0) AS parties, counterparties, positions FROM a LEFT JOIN pn USING (company_id, file_id, document_type) LEFT JOIN i USING (company_id, file_id, document_type)""")
def q_file_findings(c: Ctx):
    """Findings of every file of invoices, bank rows, payroll and stock."""
    tables = {"invoices": c.raw_invoices, "bank": c.bank, "payroll": c.payroll, "inventory": c.inventory}
    found = E.file_findings(c.spark.sql(_typed({n: f"{{{n}}}" for n in tables}), **tables))
    return found.withColumns({m: out_money(m) for m in ("total", "tax", "inflow", "outflow")})


@query("tax_scheme_evidence", W("o_classified", "v_inventory", "v_payroll") + f"""
, s AS (SELECT company_id, CAST(sum(capital) AS BIGINT) AS capital, CAST(sum(gst_review) AS BIGINT) AS gst_review, CAST(sum(software) AS DECIMAL(18,2)) AS software,
               CAST(sum(stock) AS DECIMAL(18,2)) AS stock, CAST(sum(payroll) AS BIGINT) AS payroll FROM (
  SELECT {_tenant('id')} AS company_id, CAST(c_account_code = '1500' AS INTEGER) AS capital, CAST(c_tax_code = 'REVIEW' AS INTEGER) AS gst_review,
         CASE WHEN contains(lower(c_account_name), 'software') THEN amount ELSE 0 END AS software, 0 AS stock, 0 AS payroll FROM o_classified
  UNION ALL SELECT {_tenant('id')}, 0, 0, 0, total_value, 0 FROM v_inventory
  UNION ALL SELECT {_tenant('id')}, 0, 0, 0, 0, 1 FROM v_payroll) GROUP BY 1),
sch AS (SELECT * FROM (VALUES {", ".join(f"('{i}', '{t}', '{g}')" for i, t, g in E.SCHEMES)}) v(scheme, title, category))
SELECT company_id, scheme, title, category,
       CASE scheme WHEN 'employee_costs' THEN CASE WHEN payroll > 0 THEN 'evidence present' ELSE 'missing payroll' END WHEN 'cgt_concessions' THEN 'event dependent'
                   WHEN 'gst_credits' THEN CASE WHEN gst_review > 0 THEN 'review now' ELSE 'evidence present' END ELSE 'eligibility review' END AS status,
       CASE scheme WHEN 'instant_asset_write_off' THEN CAST(capital AS STRING) WHEN 'trading_stock' THEN CAST(stock AS STRING) WHEN 'rdti' THEN CAST(software AS STRING)
                   WHEN 'employee_costs' THEN CAST(payroll AS STRING) WHEN 'gst_credits' THEN CAST(gst_review AS STRING) END AS evidence
FROM s CROSS JOIN sch""")
def q_tax_schemes(c: Ctx):
    """Nine tax schemes for every company: status and the figure behind it."""
    by_key = lambda df: df.withColumn("company_id", F.expr(_tenant("id")))
    return E.scheme_evidence(E.scheme_signals(by_key(c.classified), by_key(c.inventory), by_key(c.payroll)))
