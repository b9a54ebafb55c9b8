"""Data-trust score, dashboard integrity and readiness.

Each check is a one-row-per-company DataFrame; the checks are unioned into one table and the score
is a single aggregate over it (100 minus severity weights of failing checks)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..context import Ctx
from ..operators.filters import marketing_invoices
from ..oracle.views import with_views as W
from ..registry import query
from . import ledger as L
from .queries_catalog import COVERAGE_SQL, set_coverage
from .queries_domains import CHANNEL_SQL
from .queries_intake import _repair_sql, classification_repair_plan
from .queries_matching import VALIDATIONS_SQL, validations_run

SEVERITY_WEIGHT = {"critical": 28, "high": 16, "medium": 8, "low": 3, "info": 0}


def _tb_code(c: Ctx, code: str, name: str) -> DataFrame:
    return c.trial_balance.filter(F.col("code") == code).select("company_id", F.col("balance").alias(name))


def quality_checks(c: Ctx) -> DataFrame:
    cl = c.classified
    review = cl.groupBy("company_id").agg(
        F.count(F.when(F.col("c_validation") != "approved", 1)).alias("open_tasks"))
    drafts = c.entries.groupBy("company_id").agg(F.count(F.when(F.col("status") == "draft", 1)).alias("drafts"))
    snap = c.snapshot.select("company_id", "cash")
    ar_stmt = c.assets_liabilities.groupBy("company_id").agg(
        F.sum(F.when((F.col("category") == "asset") & F.lower("name").contains("receiv"), F.col("amount")).otherwise(0))
        .cast("double").alias("stmt_ar"))
    mk = marketing_invoices(cl).groupBy("company_id").agg(F.sum(F.abs("amount")).cast("double").alias("inv_spend"))
    val = validations_run(c).groupBy("company_id").agg(
        F.count("*").alias("open_validations"), F.count(F.when(F.col("severity") == "critical", 1)).alias("critical"))
    missing = set_coverage(c).groupBy("company_id").agg(F.count(F.when(F.col("state") == "missing", 1)).alias("core_missing"))
    repairs = (classification_repair_plan(c).select("upload_id").join(c.uploads.select("company_id", "upload_id"), "upload_id")
               .groupBy("company_id").agg(F.count("*").alias("repairs")))
    base = (review.join(missing, "company_id", "left").join(repairs, "company_id", "left").join(drafts, "company_id", "left").join(snap, "company_id", "left")
            .join(_tb_code(c, "1000", "ledger_cash"), "company_id", "left")
            .join(_tb_code(c, "1100", "ledger_ar"), "company_id", "left")
            .join(_tb_code(c, "6150", "ledger_mk"), "company_id", "left")
            .join(ar_stmt, "company_id", "left").join(mk, "company_id", "left").join(val, "company_id", "left")
            .na.fill(0))
    ot, dj = F.col("open_tasks"), F.col("drafts")
    cash_diff = F.round(F.col("ledger_cash") - F.col("cash"), 2)
    cash_ok = F.abs(cash_diff) <= F.greatest(F.lit(1.0), F.abs("cash") * 0.005)
    ar_diff = F.round(F.col("ledger_ar") - F.col("stmt_ar"), 2)
    ar_ok = F.abs(ar_diff) <= F.greatest(F.lit(1.0), F.abs("stmt_ar") * 0.01)
    actual = (F.col("ledger_mk") > 0.01) | (F.col("inv_spend") > 0.01)
    nv = F.col("open_validations")
    checks = F.array(
        F.struct(F.lit("core-document-coverage").alias("id"), F.lit("Core document coverage").alias("label"),
                 F.when(F.col("core_missing") == 0, "pass").otherwise("fail").alias("status"),
                 F.when(F.col("core_missing") > 0, "critical").otherwise("info").alias("severity")),
        F.struct(F.lit("classification-integrity").alias("id"), F.lit("Classification integrity").alias("label"),
                 F.when(F.col("repairs") == 0, "pass").otherwise("fail").alias("status"),
                 F.when(F.col("repairs") > 0, "high").otherwise("info").alias("severity")),
        F.struct(F.lit("account-review-queue").alias("id"), F.lit("Account review queue").alias("label"),
                 F.when((ot == 0) & (dj == 0), "pass").otherwise("warning").alias("status"),
                 F.when(ot >= 5, "high").when((ot > 0) | (dj > 0), "medium").otherwise("info").alias("severity")),
        F.struct(F.lit("cash-reconciliation").alias("id"), F.lit("Cash reconciliation").alias("label"),
                 F.when(cash_ok, "pass").otherwise("warning").alias("status"),
                 F.when(cash_ok, "info").otherwise("high").alias("severity")),
        F.struct(F.lit("receivables-reconciliation").alias("id"), F.lit("Receivables reconciliation").alias("label"),
                 F.when(ar_ok, "pass").otherwise("warning").alias("status"),
                 F.when(ar_ok, "info").otherwise("medium").alias("severity")),
        F.struct(F.lit("tax-readiness").alias("id"), F.lit("Tax evidence readiness").alias("label"),
                 F.when(ot == 0, "pass").otherwise("warning").alias("status"),
                 F.when(ot > 0, "medium").otherwise("info").alias("severity")),
        F.struct(F.lit("marketing-attribution").alias("id"), F.lit("Marketing attribution source").alias("label"),
                 F.when(actual, "pass").otherwise("warning").alias("status"), F.lit("low").alias("severity")),
        F.struct(F.lit("business-validation-queue").alias("id"), F.lit("Business validation queue").alias("label"),
                 F.when(nv == 0, "pass").otherwise("warning").alias("status"),
                 F.when(F.col("critical") > 0, "high").when(nv > 0, "medium").otherwise("info").alias("severity")),
    )
    return base.select("company_id", F.explode(checks).alias("k"), cash_diff.alias("cash_difference"),
                       ar_diff.alias("receivables_difference")).select("company_id", "k.*", "cash_difference",
                                                                         "receivables_difference")


def quality_score(checks: DataFrame) -> DataFrame:
    w = F.create_map(*[x for k, v in SEVERITY_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    failing = F.col("status").isin("fail", "warning")
    agg = checks.groupBy("company_id").agg(
        F.sum(F.when(failing, F.coalesce(w[F.col("severity")], F.lit(5))).otherwise(0)).alias("deduction"),
        *[F.count(F.when(failing & (F.col("severity") == s), 1)).cast("bigint").alias(f"{s}_issues")
          for s in ("critical", "high", "medium", "low")])
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("deduction"))).cast("bigint")
    return agg.select("company_id", score.alias("score"),
                      F.when(score >= 85, "trusted").when(score >= 65, "review").otherwise("not_ready").alias("status"),
                      "critical_issues", "high_issues", "medium_issues", "low_issues")


QUALITY_SQL = VALIDATIONS_SQL + CHANNEL_SQL.replace(", mk AS", ", mkq AS").replace("FROM mk", "FROM mkq") + """,
rv AS (SELECT company_id, count(CASE WHEN c_validation <> 'approved' THEN 1 END) AS open_tasks,
              count(CASE WHEN c_validation <> 'approved' THEN 1 END) AS drafts FROM o_classified GROUP BY 1),
tbv AS (SELECT sum(CASE WHEN code = '1000' THEN round(CAST(balance AS DOUBLE), 2) ELSE 0 END) AS ledger_cash,
               sum(CASE WHEN code = '1100' THEN round(CAST(balance AS DOUBLE), 2) ELSE 0 END) AS ledger_ar,
               sum(CASE WHEN code = '6150' THEN round(CAST(balance AS DOUBLE), 2) ELSE 0 END) AS ledger_mk FROM o_trial_balance),
ars AS (SELECT company_id, CAST(sum(CASE WHEN category = 'asset' AND contains(lower(name), 'receiv') THEN amount ELSE 0 END) AS DOUBLE) AS stmt_ar
        FROM v_assets_liabilities GROUP BY 1),
mks AS (SELECT company_id, CAST(sum(abs(amount)) AS DOUBLE) AS inv_spend FROM mkq GROUP BY 1),
vv AS (SELECT company_id, count(*) AS nv, count(CASE WHEN severity = 'critical' THEN 1 END) AS crit FROM vi GROUP BY 1),
cmv AS (SELECT company_id, count(CASE WHEN state = 'missing' THEN 1 END) AS core_missing FROM (""" + COVERAGE_SQL + """
        SELECT * FROM cov) GROUP BY 1),
rpv AS (SELECT u.company_id, count(*) AS repairs FROM (""" + _repair_sql() + """) r JOIN v_uploads u USING (upload_id) GROUP BY 1),
b AS (SELECT rv.company_id, open_tasks, drafts, coalesce(core_missing, 0) AS core_missing, coalesce(repairs, 0) AS repairs, coalesce(s.cash, 0) AS cash, coalesce(ledger_cash, 0) AS ledger_cash,
             coalesce(ledger_ar, 0) AS ledger_ar, coalesce(ledger_mk, 0) AS ledger_mk, coalesce(stmt_ar, 0) AS stmt_ar,
             coalesce(inv_spend, 0) AS inv_spend, coalesce(nv, 0) AS nv, coalesce(crit, 0) AS crit,
             round(coalesce(ledger_cash, 0) - coalesce(s.cash, 0), 2) AS cash_difference,
             round(coalesce(ledger_ar, 0) - coalesce(stmt_ar, 0), 2) AS receivables_difference
      FROM rv LEFT JOIN o_snapshot s USING (company_id) CROSS JOIN tbv LEFT JOIN ars USING (company_id)
      LEFT JOIN mks USING (company_id) LEFT JOIN vv USING (company_id) LEFT JOIN cmv USING (company_id) LEFT JOIN rpv USING (company_id)),
qc AS (
  SELECT company_id, 'core-document-coverage' AS id, 'Core document coverage' AS label,
         CASE WHEN core_missing = 0 THEN 'pass' ELSE 'fail' END AS status,
         CASE WHEN core_missing > 0 THEN 'critical' ELSE 'info' END AS severity, cash_difference, receivables_difference FROM b
  UNION ALL SELECT company_id, 'classification-integrity', 'Classification integrity',
         CASE WHEN repairs = 0 THEN 'pass' ELSE 'fail' END,
         CASE WHEN repairs > 0 THEN 'high' ELSE 'info' END, cash_difference, receivables_difference FROM b
  UNION ALL SELECT company_id, 'account-review-queue' AS id, 'Account review queue' AS label,
         CASE WHEN open_tasks = 0 AND drafts = 0 THEN 'pass' ELSE 'warning' END AS status,
         CASE WHEN open_tasks >= 5 THEN 'high' WHEN open_tasks > 0 OR drafts > 0 THEN 'medium' ELSE 'info' END AS severity,
         cash_difference, receivables_difference FROM b
  UNION ALL SELECT company_id, 'cash-reconciliation', 'Cash reconciliation',
         CASE WHEN abs(cash_difference) <= greatest(1.0, abs(cash) * 0.005) THEN 'pass' ELSE 'warning' END,
         CASE WHEN abs(cash_difference) <= greatest(1.0, abs(cash) * 0.005) THEN 'info' ELSE 'high' END,
         cash_difference, receivables_difference FROM b
  UNION ALL SELECT company_id, 'receivables-reconciliation', 'Receivables reconciliation',
         CASE WHEN abs(receivables_difference) <= greatest(1.0, abs(stmt_ar) * 0.01) THEN 'pass' ELSE 'warning' END,
         CASE WHEN abs(receivables_difference) <= greatest(1.0, abs(stmt_ar) * 0.01) THEN 'info' ELSE 'medium' END,
         cash_difference, receivables_difference FROM b
  UNION ALL SELECT company_id, 'tax-readiness', 'Tax evidence readiness', CASE WHEN open_tasks = 0 THEN 'pass' ELSE 'warning' END,
         CASE WHEN open_tasks > 0 THEN 'medium' ELSE 'info' END, cash_difference, receivables_difference FROM b
  UNION ALL SELECT company_id, 'marketing-attribution', 'Marketing attribution source',
         CASE WHEN ledger_mk > 0.01 OR inv_spend > 0.01 THEN 'pass' ELSE 'warning' END, 'low',
         cash_difference, receivables_difference FROM b
  UNION ALL SELECT company_id, 'business-validation-queue', 'Business validation queue', CASE WHEN nv = 0 THEN 'pass' ELSE 'warning' END,
         CASE WHEN crit > 0 THEN 'high' WHEN nv > 0 THEN 'medium' ELSE 'info' END, cash_difference, receivables_difference FROM b)"""

QUALITY_VIEWS = W("v_uploads", "o_snapshot", "v_invoices", "v_transactions", "o_classified", "o_trial_balance", "v_assets_liabilities")


@query("data_quality_checks", QUALITY_VIEWS + QUALITY_SQL[QUALITY_SQL.index("\n, t AS"):] + " SELECT * FROM qc")
def q_data_quality_checks(c: Ctx):
    """Data-trust checks: core documents, classification, review queue, cash and receivables reconciliation (tolerances max(1, 0.5 %)
    and max(1, 1 %)), tax readiness, marketing evidence mode and the validation queue."""
    return quality_checks(c)


@query("data_quality_score", QUALITY_VIEWS + QUALITY_SQL[QUALITY_SQL.index("\n, t AS"):] + """
, d AS (SELECT company_id, sum(CASE WHEN status IN ('fail', 'warning') THEN CASE severity WHEN 'critical' THEN 28 WHEN 'high' THEN 16
               WHEN 'medium' THEN 8 WHEN 'low' THEN 3 WHEN 'info' THEN 0 ELSE 5 END ELSE 0 END) AS ded,
               count(CASE WHEN status IN ('fail', 'warning') AND severity = 'critical' THEN 1 END) AS c1,
               count(CASE WHEN status IN ('fail', 'warning') AND severity = 'high' THEN 1 END) AS c2,
               count(CASE WHEN status IN ('fail', 'warning') AND severity = 'medium' THEN 1 END) AS c3,
               count(CASE WHEN status IN ('fail', 'warning') AND severity = 'low' THEN 1 END) AS c4 FROM qc GROUP BY 1)
SELECT company_id, CAST(greatest(0, least(100, 100 - ded)) AS BIGINT) AS score,
       CASE WHEN greatest(0, least(100, 100 - ded)) >= 85 THEN 'trusted' WHEN greatest(0, least(100, 100 - ded)) >= 65 THEN 'review'
            ELSE 'not_ready' END AS status,
       CAST(c1 AS BIGINT) AS critical_issues, CAST(c2 AS BIGINT) AS high_issues, CAST(c3 AS BIGINT) AS medium_issues,
       CAST(c4 AS BIGINT) AS low_issues FROM d""")
def q_data_quality_score(c: Ctx):
    """Trust score = 100 - severity weights (28/16/8/3) of failing checks; trusted >= 85, review >= 65."""
    return quality_score(quality_checks(c))


INTEGRITY_TOLERANCE = 0.02


@query("dashboard_integrity", W("o_snapshot", "o_trial_balance", "o_lines", "o_coa") + f"""
, led AS (
  SELECT k.company_id, c.name, c.account_type AS t, lower(c.subtype) AS s, lower(c.name) AS n,
         CAST(coalesce(sum(CASE WHEN c.account_type IN ('asset', 'expense') THEN l.debit - l.credit ELSE l.credit - l.debit END), 0) AS DOUBLE) AS b
  FROM o_coa c CROSS JOIN (SELECT DISTINCT company_id FROM o_lines) k
  LEFT JOIN o_lines l ON l.company_id = k.company_id AND l.account_code = c.code AND l.entry_status = 'posted'
  WHERE c.active GROUP BY k.company_id, c.code, c.name, c.account_type, c.subtype),
v AS (
  SELECT company_id,
    sum(CASE WHEN t = 'asset' AND (contains(n, 'cash') OR contains(n, 'bank')) THEN b ELSE 0 END) AS cash,
    sum(CASE WHEN t = 'asset' AND contains(s, 'current') AND NOT contains(s, 'non-current') THEN b ELSE 0 END) AS ca,
    sum(CASE WHEN t = 'liability' AND contains(s, 'current') AND NOT contains(s, 'non-current') THEN b ELSE 0 END) AS cl,
    sum(abs(b)) AS accounts, abs(sum(CASE WHEN t = 'asset' THEN b ELSE 0 END)) + abs(sum(CASE WHEN t = 'liability' THEN b ELSE 0 END)) AS position
  FROM led GROUP BY 1),
shown AS (SELECT company_id, sum(abs(round(CAST(balance AS DOUBLE), 2))) AS accounts FROM o_trial_balance GROUP BY 1),
m AS (
  SELECT company_id, 'Cash' AS metric, o.cash AS d, v.cash AS x FROM v JOIN o_snapshot o USING (company_id)
  UNION ALL SELECT company_id, 'Current assets', o.current_assets, v.ca FROM v JOIN o_snapshot o USING (company_id)
  UNION ALL SELECT company_id, 'Current liabilities', o.current_liabilities, v.cl FROM v JOIN o_snapshot o USING (company_id)
  UNION ALL SELECT company_id, 'Current ratio', o.current_ratio, CASE WHEN v.cl <> 0 THEN v.ca / v.cl END FROM v JOIN o_snapshot o USING (company_id)
  UNION ALL SELECT company_id, 'Account register', shown.accounts, v.accounts FROM v JOIN shown USING (company_id)
  UNION ALL SELECT company_id, 'Financial-position chart', abs(o.total_assets) + abs(o.total_liabilities), v.position
            FROM v JOIN o_snapshot o USING (company_id))
SELECT company_id, metric, round(coalesce(d, 0), 2) AS displayed_value, round(coalesce(x, 0), 2) AS database_value,
       round(coalesce(d, 0) - coalesce(x, 0), 2) + 0.0 AS difference,
       CASE WHEN abs(coalesce(d, 0) - coalesce(x, 0)) <= {INTEGRITY_TOLERANCE} THEN 'reconciled' ELSE 'mismatch' END AS status FROM m""")
def q_dashboard_integrity(c: Ctx):
    """What the dashboard shows (snapshot, account register, position chart) against balances recomputed
    from the posted journal lines."""
    return dashboard_integrity(c.snapshot, c.trial_balance, c.coa, c.lines)


def dashboard_integrity(snapshot: DataFrame, register: DataFrame, coa: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per company and metric: displayed value, value from the journal, difference, status."""
    led = L.trial_balance(coa, lines).select("company_id", F.col("account_type").alias("t"), F.lower("subtype").alias("s"),
                                             F.lower("name").alias("n"), F.col("balance").cast("double").alias("b"))
    current = F.col("s").contains("current") & ~F.col("s").contains("non-current")

    def total(cond):
        return F.sum(F.when(cond, F.col("b")).otherwise(F.lit(0.0)))

    asset, liability = F.col("t") == "asset", F.col("t") == "liability"
    v = led.groupBy("company_id").agg(
        total(asset & (F.col("n").contains("cash") | F.col("n").contains("bank"))).alias("x_cash"),
        total(asset & current).alias("x_ca"), total(liability & current).alias("x_cl"),
        F.sum(F.abs("b")).alias("x_accounts"), (F.abs(total(asset)) + F.abs(total(liability))).alias("x_position"))
    shown = register.groupBy("company_id").agg(F.sum(F.abs(F.col("balance").cast("double"))).alias("accounts"))
    j = v.join(snapshot, "company_id").join(shown, "company_id")

    def row(name, displayed, database):
        return F.struct(F.lit(name).alias("metric"), displayed.cast("double").alias("d"), database.alias("x"))

    rows = j.select("company_id", F.explode(F.array(
        row("Cash", F.col("cash"), F.col("x_cash")), row("Current assets", F.col("current_assets"), F.col("x_ca")),
        row("Current liabilities", F.col("current_liabilities"), F.col("x_cl")),
        row("Current ratio", F.col("current_ratio"), F.try_divide("x_ca", "x_cl")),
        row("Account register", F.col("accounts"), F.col("x_accounts")),
        row("Financial-position chart", F.abs("total_assets") + F.abs("total_liabilities"), F.col("x_position")),
    )).alias("m")).select("company_id", "m.*").na.fill(0.0, ["d", "x"])
    return rows.select("company_id", "metric", F.round("d", 2).alias("displayed_value"), F.round("x", 2).alias("database_value"),
                       (F.round(F.col("d") - F.col("x"), 2) + F.lit(0.0)).alias("difference"),
                       F.when(F.abs(F.col("d") - F.col("x")) <= INTEGRITY_TOLERANCE, "reconciled").otherwise("mismatch").alias("status"))
