"""Catalogue, lifecycle and summary products: table catalog, entity counts, management summary,
coverage / lifecycle phase, staged-file dedupe, history windows, rule usage, diagonal concat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..context import Ctx
from ..functions import rules as R
from ..functions.expr import out_money, visible_name
from ..oracle.views import with_views as W
from ..registry import query
from .queries_intake import ROUTED_SQL, routed_uploads
from .queries_matching import VALIDATIONS_SQL, validations_run


def _tables(c: Ctx) -> dict[str, DataFrame]:
    return {
        "invoices": c.raw_invoices, "transactions": c.transactions, "bank_transactions": c.bank,
        "assets_liabilities": c.assets_liabilities, "inventory": c.inventory, "payroll_records": c.payroll,
        "employee_profiles": c.profiles, "market_signals": c.signals, "statement_snapshots": c.statements,
    }


_DOMAIN = {"invoices": "finance", "transactions": "finance", "bank_transactions": "finance", "assets_liabilities": "finance",
           "statement_snapshots": "finance", "inventory": "operations", "payroll_records": "people",
           "employee_profiles": "people", "market_signals": "market"}

_CATALOG_VIEWS = {"invoices": "v_invoices", "transactions": "v_transactions", "bank_transactions": "v_bank",
                  "assets_liabilities": "v_assets_liabilities", "inventory": "v_inventory", "payroll_records": "v_payroll",
                  "employee_profiles": "v_profiles", "market_signals": "v_market_signals", "statement_snapshots": "v_statements"}


def table_catalog(c: Ctx) -> DataFrame:
    """Per table: domain, row count, column count and distinct source files (one aggregate each)."""
    parts = []
    for name, df in _tables(c).items():
        files = F.countDistinct("source_file") if "source_file" in df.columns else F.lit(0)
        parts.append(df.agg(F.count("*").cast("bigint").alias("row_count"), files.cast("bigint").alias("source_files"))
                     .select(F.lit(name).alias("table_name"), F.lit(_DOMAIN[name]).alias("business_domain"), "row_count",
                             F.lit(len(df.columns)).cast("bigint").alias("column_count"), "source_files"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _catalog_sql() -> str:
    # column counts follow the Spark canonical schemas (the same views in both engines)
    cols = {"invoices": 19, "transactions": 8, "bank_transactions": 10, "assets_liabilities": 8, "inventory": 10,
            "payroll_records": 12, "employee_profiles": 7, "market_signals": 16, "statement_snapshots": 9}
    parts = []
    for name, view in _CATALOG_VIEWS.items():
        files = "count(DISTINCT source_file)" if name != "employee_profiles" else "0"
        parts.append(f"SELECT '{name}' AS table_name, '{_DOMAIN[name]}' AS business_domain, CAST(count(*) AS BIGINT) AS row_count, "
                     f"CAST({cols[name]} AS BIGINT) AS column_count, CAST({files} AS BIGINT) AS source_files FROM {view}")
    return W(*_CATALOG_VIEWS.values()) + "\nUNION ALL ".join(parts)


@query("table_catalog", _catalog_sql())
def q_table_catalog(c: Ctx):
    """Catalogue of the canonical business tables: rows, columns, distinct source files, domain."""
    return table_catalog(c)


@query("entity_counts", W(*_CATALOG_VIEWS.values()) + "\nUNION ALL ".join(
    f"SELECT '{n}' AS table_name, CAST(count(*) AS BIGINT) AS count FROM {v}" for n, v in _CATALOG_VIEWS.items()))
def q_entity_counts(c: Ctx):
    """Row count per canonical table."""
    return table_catalog(c).select("table_name", F.col("row_count").alias("count"))


@query("management_summary", VALIDATIONS_SQL + """
, tk AS (SELECT company_id, count(CASE WHEN c_validation <> 'approved' THEN 1 END) AS n FROM o_classified GROUP BY 1),
vn AS (SELECT company_id, count(*) AS n FROM vi GROUP BY 1),
ms AS (SELECT o.*, CAST(coalesce(tk.n, 0) + coalesce(vn.n, 0) AS DOUBLE) AS critical_alerts
      FROM o_snapshot o LEFT JOIN tk USING (company_id) LEFT JOIN vn USING (company_id))
SELECT company_id, metric, value FROM (
  SELECT company_id, 1 AS k, 'Available cash' AS metric, cash AS value FROM ms
  UNION ALL SELECT company_id, 2, 'Current assets', current_assets FROM ms
  UNION ALL SELECT company_id, 3, 'Current liabilities', current_liabilities FROM ms
  UNION ALL SELECT company_id, 4, 'Current ratio', current_ratio FROM ms
  UNION ALL SELECT company_id, 5, 'Working capital', working_capital FROM ms
  UNION ALL SELECT company_id, 6, 'Monthly revenue', revenue_month FROM ms
  UNION ALL SELECT company_id, 7, 'Monthly expenses', expenses_month FROM ms
  UNION ALL SELECT company_id, 8, 'Cash runway (days)', CAST(cash_runway_days AS DOUBLE) FROM ms
  UNION ALL SELECT company_id, 9, 'Open invoices', open_invoice_total FROM ms
  UNION ALL SELECT company_id, 10, 'Overdue invoices', overdue_invoice_total FROM ms
  UNION ALL SELECT company_id, 11, 'Critical alerts', critical_alerts FROM ms)""".replace(
    "WITH ", "WITH ", 1).replace(VALIDATIONS_SQL.split("\n", 1)[0], VALIDATIONS_SQL.split("\n", 1)[0], 1))
def q_management_summary(c: Ctx):
    """The 11-row management summary (cash, position, revenue, runway, invoices, critical alerts)."""
    tasks = c.classified.groupBy("company_id").agg(F.count(F.when(F.col("c_validation") != "approved", 1)).alias("nt"))
    vals = validations_run(c).groupBy("company_id").agg(F.count("*").alias("nv"))
    s = (c.snapshot.join(tasks, "company_id", "left").join(vals, "company_id", "left")
         .withColumn("critical_alerts", (F.coalesce("nt", F.lit(0)) + F.coalesce("nv", F.lit(0))).cast("double")))
    d = lambda x: F.col(x).cast("double")
    return s.select("company_id", F.stack(
        F.lit(11),
        F.lit("Available cash"), d("cash"), F.lit("Current assets"), d("current_assets"),
        F.lit("Current liabilities"), d("current_liabilities"), F.lit("Current ratio"), d("current_ratio"),
        F.lit("Working capital"), d("working_capital"), F.lit("Monthly revenue"), d("revenue_month"),
        F.lit("Monthly expenses"), d("expenses_month"), F.lit("Cash runway (days)"), d("cash_runway_days"),
        F.lit("Open invoices"), d("open_invoice_total"), F.lit("Overdue invoices"), d("overdue_invoice_total"),
        F.lit("Critical alerts"), d("critical_alerts")).alias("metric", "value"))


def received_types(c: Ctx) -> DataFrame:
    r = routed_uploads(c).filter(F.col("processing_status").isin(*R.COMPLETE_UPLOAD_STATUSES))
    return r.select("company_id", "document_type").filter(F.col("document_type").isNotNull()).distinct()


CORE_SQL = "(" + ", ".join(f"'{t}'" for t in R.CORE_SETUP_TYPES) + ")"
COVERAGE_SQL = W("v_uploads") + ROUTED_SQL + f""",
rec AS (SELECT DISTINCT company_id, document_type FROM routed WHERE processing_status IN ('committed', 'stored_source', 'pending_mapping') AND document_type IS NOT NULL),
core AS (SELECT unnest([{", ".join(f"'{t}'" for t in R.CORE_SETUP_TYPES)}]) AS document_type),
comp AS (SELECT DISTINCT company_id FROM v_uploads),
cov AS (SELECT comp.company_id, core.document_type,
               CASE WHEN rec.document_type IS NULL THEN 'missing' ELSE 'received' END AS state
        FROM comp CROSS JOIN core LEFT JOIN rec ON rec.company_id = comp.company_id AND rec.document_type = core.document_type)"""


def set_coverage(c: Ctx) -> DataFrame:
    """Core setup types received vs missing (required set is a fixed 5-element literal exploded
    per company; a left join against received types)."""
    comp = c.uploads.select("company_id").distinct()
    core = comp.select("company_id", F.explode(F.array(*[F.lit(t) for t in R.CORE_SETUP_TYPES])).alias("document_type"))
    rec = received_types(c).withColumn("r", F.lit(True))
    return core.join(rec, ["company_id", "document_type"], "left").select(
        "company_id", "document_type", F.when(F.col("r"), "received").otherwise("missing").alias("state"))


@query("set_coverage", COVERAGE_SQL + " SELECT * FROM cov")
def q_set_coverage(c: Ctx):
    """Core setup document types received vs missing."""
    return set_coverage(c)


@query("lifecycle_phase", COVERAGE_SQL + """
SELECT company_id, CASE WHEN count(CASE WHEN state = 'missing' THEN 1 END) = 0 THEN 'recurring_intake' ELSE 'initial_setup' END AS phase,
       coalesce(string_agg(CASE WHEN state = 'missing' THEN document_type END, ',' ORDER BY document_type), '') AS missing
FROM cov GROUP BY company_id""")
def q_lifecycle_phase(c: Ctx):
    """recurring_intake once every core setup type is received, else initial_setup (+ missing list)."""
    cov = set_coverage(c)
    miss = F.when(F.col("state") == "missing", F.col("document_type"))
    return cov.groupBy("company_id").agg(
        F.when(F.count(miss) == 0, "recurring_intake").otherwise("initial_setup").alias("phase"),
        F.array_join(F.array_sort(F.collect_list(miss)), ",").alias("missing"))


STAGED_STATUS = ("CASE WHEN processing_status = 'pending_mapping' THEN 'staged_source' WHEN processing_status IN ('committed', 'stored_source') THEN 'processed_source' "
                 "ELSE 'archived_source' END")


@query("staged_file_dedupe", W("v_uploads") + f"""
, s AS (SELECT *, {STAGED_STATUS} AS source_status,
               lower(trim(regexp_replace(filename, '^.*?__', ''))) || '|' || file_size AS fingerprint FROM v_uploads),
r AS (SELECT *, CASE source_status WHEN 'staged_source' THEN 3 WHEN 'archived_source' THEN 2 ELSE 1 END AS rnk FROM s)
SELECT company_id, fingerprint, arg_max(upload_id, CAST(rnk AS BIGINT) * 1000000000 - CAST(regexp_replace(upload_id, '[^0-9]', '', 'g') AS BIGINT)) AS upload_id,
       max(rnk) AS status_rank FROM r GROUP BY company_id, fingerprint""")
def q_staged_file_dedupe(c: Ctx):
    """One source per company, visible name and size: the best-ranked status (staged > archived > processed),
    first upload on ties."""
    st = F.when(F.col("processing_status") == "pending_mapping", "staged_source") \
        .when(F.col("processing_status").isin(*R.COMPLETE_UPLOAD_STATUSES), "processed_source").otherwise("archived_source")
    rank = F.create_map(*[x for k, v in R.STAGED_STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])[st]
    num = F.regexp_replace("upload_id", "[^0-9]", "").cast("bigint")
    u = c.uploads.select("company_id", "upload_id", rank.alias("rnk"), num.alias("n"), F.concat(
        F.lower(F.trim(visible_name(F.col("filename")))), F.lit("|"), F.col("file_size").cast("string")).alias("fingerprint"))
    return u.groupBy("company_id", "fingerprint").agg(F.max_by("upload_id", F.struct(F.col("rnk"), -F.col("n"))).alias("upload_id"),
                                        F.max("rnk").alias("status_rank"))


@query("upload_history_window", W("v_uploads") + """
SELECT company_id, upload_id, filename, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, upload_id DESC) AS rn FROM v_uploads) WHERE rn <= 60""")
def q_upload_history_window(c: Ctx):
    """Newest 60 uploads per company (history kept in the company context)."""
    w = Window.partitionBy("company_id").orderBy(F.col("created_at").desc(), F.col("upload_id").desc())
    return (c.uploads.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 60)
            .select("company_id", "upload_id", "filename", "created_at"))


@query("completed_upload_count", W("v_uploads") + """
SELECT company_id, CAST(count(*) AS BIGINT) AS completed_uploads FROM v_uploads WHERE processing_status IN ('committed', 'stored_source', 'pending_mapping') GROUP BY 1""")
def q_completed_upload_count(c: Ctx):
    """Uploads in a complete status."""
    return (c.uploads.filter(F.col("processing_status").isin(*R.COMPLETE_UPLOAD_STATUSES))
            .groupBy("company_id").agg(F.count("*").cast("bigint").alias("completed_uploads")))


@query("rule_use_counts", W("o_classified") + """
SELECT company_id, c_rule_id AS rule_id, c_keyword AS keyword, CAST(count(*) AS BIGINT) AS use_count, max(invoice_date) AS last_used
FROM o_classified WHERE c_rule_id IS NOT NULL GROUP BY 1, 2, 3""")
def q_rule_use_counts(c: Ctx):
    """How often each categorisation rule matched a company's invoices, and its latest invoice date."""
    cl = c.classified.filter(F.col("rule_id").isNotNull())
    return cl.groupBy("company_id", "rule_id", "keyword").agg(F.count("*").cast("bigint").alias("use_count"),
                                                F.max("invoice_date").alias("last_used"))


@query("diagonal_concat", W("v_transactions", "v_bank") + """
SELECT id, transaction_date, description, category, CAST(NULL AS VARCHAR) AS account_name, round(CAST(amount AS DOUBLE), 2) AS amount
FROM v_transactions
UNION ALL SELECT id, transaction_date, description, NULL, account_name, round(CAST(amount AS DOUBLE), 2) FROM v_bank""")
def q_diagonal_concat(c: Ctx):
    """Union by column name with missing columns filled with NULL (schema-relaxed append)."""
    t = c.transactions.select("id", "transaction_date", "description", "category", "amount")
    b = c.bank.select("id", "transaction_date", "description", "account_name", "amount")
    return t.unionByName(b, allowMissingColumns=True).select(
        "id", "transaction_date", "description", "category", "account_name", out_money("amount").alias("amount"))
