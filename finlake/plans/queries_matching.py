"""Matching joins (bank reconciliation, duplicate payments) and the validation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..context import Ctx
from ..functions import rules as R
from ..functions.expr import out_money, severity_rank, slug
from ..operators import aggregates as AG
from ..operators import joins as J
from ..operators import windows as WN
from ..oracle.views import with_views as W
from ..registry import query
from . import snapshot as SN

BANK_SQL = """, b AS (SELECT company_id, id AS txn_id, lower(coalesce(description, '')) AS d, CAST(abs(amount) * 100 AS BIGINT) AS c FROM v_bank),
i AS (SELECT company_id, id AS invoice_id, invoice_number, lower(coalesce(invoice_number, '')) AS num,
             lower(coalesce(supplier, '')) AS sup, CAST(abs(amount) * 100 AS BIGINT) AS c FROM v_invoices),
h AS (
  SELECT b.company_id, txn_id, invoice_id, invoice_number,
         row_number() OVER (PARTITION BY b.company_id, txn_id ORDER BY invoice_id) AS rn
  FROM b JOIN i ON i.company_id = b.company_id AND i.c BETWEEN b.c - 1 AND b.c + 1
  WHERE b.c > 0 AND ((num <> '' AND contains(d, num)) OR (length(sup) >= 4 AND contains(d, sup)))),
bm AS (SELECT company_id, txn_id, invoice_id, invoice_number FROM h WHERE rn = 1)"""


@query("bank_invoice_match", W("v_bank", "v_invoices") + BANK_SQL + " SELECT * FROM bm")
def q_bank_invoice_match(c: Ctx):
    """First invoice per bank row with amount within 1 cent and its number or party named in the text."""
    return J.bank_invoice_match(c.bank, c.invoices)


@query("bank_reconciliation_counts", W("v_bank", "v_invoices") + BANK_SQL + """
, nb AS (SELECT company_id, count(*) AS n FROM v_bank GROUP BY 1),
ni AS (SELECT company_id, count(*) AS n FROM v_invoices GROUP BY 1),
mt AS (SELECT company_id, count(*) AS matched, count(DISTINCT invoice_number) AS mi FROM bm GROUP BY 1)
SELECT nb.company_id, CAST(coalesce(matched, 0) AS BIGINT) AS matched_bank_transactions,
       CAST(coalesce(mi, 0) AS BIGINT) AS matched_invoices,
       CAST(greatest(0, nb.n - coalesce(matched, 0)) AS BIGINT) AS unmatched_bank_transactions,
       CAST(coalesce(ni.n, 0) AS BIGINT) AS invoice_records_considered
FROM nb LEFT JOIN ni USING (company_id) LEFT JOIN mt USING (company_id)""")
def q_bank_reconciliation_counts(c: Ctx):
    """Matched / unmatched bank rows and matched invoice numbers."""
    return J.bank_reconciliation_counts(c.bank, c.invoices, J.bank_invoice_match(c.bank, c.invoices))


KEY_SQL = ("coalesce(nullif(lower(regexp_extract(coalesce(description, ''), "
           "'\\b(?:invoice|inv)\\b[-\\s#:]*([a-z0-9-]*\\d[a-z0-9-]*)', 1, 'i')), ''), "
           "trim(regexp_replace(lower(coalesce(description, '')), '[^\\p{L}\\p{N}_]+', ' ', 'g')))")

DUP_SQL = f""", t AS (
  SELECT company_id, id, transaction_date AS d, {KEY_SQL} AS k, CAST(abs(amount) * 100 AS BIGINT) AS c FROM v_transactions),
t2 AS (SELECT * FROM t WHERE k <> '' AND c > 0),
p AS (
  SELECT cur.company_id, cur.k, cur.id AS cur_id, cur.c AS cur_c, e.id AS e_id, e.c AS e_c,
         row_number() OVER (PARTITION BY cur.company_id, cur.id ORDER BY e.d, e.id) AS rn
  FROM t2 cur JOIN t2 e ON e.company_id = cur.company_id AND e.k = cur.k AND (e.d < cur.d OR (e.d = cur.d AND e.id < cur.id))
  WHERE least(cur.c, e.c) * 10 >= greatest(cur.c, e.c, 100) * 9),
dp AS (
  SELECT company_id, k AS reference_key, e_id AS earlier_id, round(e_c / 100.0, 2) AS earlier_amount,
         cur_id AS current_id, round(cur_c / 100.0, 2) AS current_amount FROM p WHERE rn = 1)"""


@query("duplicate_payment_pairs", W("v_transactions") + DUP_SQL + " SELECT * FROM dp")
def q_duplicate_payment_pairs(c: Ctx):
    """Earliest earlier payment with the same invoice reference and an amount within 10 %."""
    return J.duplicate_payment_pairs(c.transactions, R.DUPLICATE_PAYMENT_RATIO)


@query("forecast_due_in_step", W("v_invoices") + f"""
SELECT company_id, CAST(ceil(date_diff('day', DATE '{P.AS_OF}', due_date) / 7) AS INTEGER) AS step,
       round(CAST(sum(amount) AS DOUBLE), 2) AS due_amount
FROM v_invoices WHERE status NOT IN ('paid', 'cancelled') AND due_date BETWEEN DATE '{P.AS_OF}' AND DATE '{P.AS_OF}' + 90
  AND ceil(date_diff('day', DATE '{P.AS_OF}', due_date) / 7) BETWEEN 1 AND {P.FORECAST_DAYS // 7}
GROUP BY 1, 2""")
def q_forecast_due_in_step(c: Ctx):
    """Open invoice amounts per forecast week, mapped arithmetically (no range join)."""
    from ..operators.filters import due_within

    asof = F.lit(P.AS_OF).cast("date")
    return (due_within(c.invoices, P.AS_OF, 90)
            .withColumn("step", F.ceil(F.datediff(F.col("due_date"), asof) / 7).cast("int"))
            .filter(F.col("step").between(1, P.FORECAST_DAYS // 7))
            .groupBy("company_id", "step").agg(out_money(F.sum("amount")).alias("due_amount")))


# ----------------------------------------------------------------------------- validations

def validations_run(c: Ctx, previous: DataFrame | None = None) -> DataFrame:
    """Six checks as issue rows; status carried from ``previous`` issues (else 'open')."""
    s = c.snapshot
    ratio, runway = F.col("current_ratio"), F.col("cash_runway_days")
    overdue, rdays = F.col("overdue_invoice_total"), F.col("receivable_days")
    cols = ["company_id", "id", "severity", "check_name", "target_id"]
    checks = [
        s.filter(ratio.isNotNull() & (ratio < R.CURRENT_RATIO_TARGET)).select(
            "company_id", F.lit("val-current-ratio").alias("id"),
            F.when(ratio < 1, "critical").otherwise("high").alias("severity"),
            F.lit("low_current_ratio").alias("check_name"), F.lit("current-ratio-card").alias("target_id")),
        s.filter((runway != 0) & (runway < R.CASH_RUNWAY_TARGET_DAYS)).select(
            "company_id", F.lit("val-cash-runway").alias("id"),
            F.when(runway < 21, "critical").otherwise("high").alias("severity"),
            F.lit("low_cash_runway").alias("check_name"), F.lit("cash-card").alias("target_id")),
        s.filter(overdue > 0).select(
            "company_id", F.lit("val-overdue-invoices").alias("id"),
            F.when(overdue > F.greatest(F.col("cash"), F.lit(1.0)), "high").otherwise("medium").alias("severity"),
            F.lit("overdue_invoices").alias("check_name"), F.lit("asset-receivables").alias("target_id")),
        c.invoices.groupBy("company_id", "invoice_number").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))
        .filter(F.col("n") > 1).select(
            "company_id", F.concat(F.lit("val-invoice-"), slug(F.col("invoice_number"))).alias("id"),
            F.lit("critical").alias("severity"), F.lit("duplicate_invoice_number").alias("check_name"),
            F.col("last_id").alias("target_id")),
        J.duplicate_payment_pairs(c.transactions, R.DUPLICATE_PAYMENT_RATIO).select(
            "company_id", F.concat(F.lit("val-txn-"), slug(F.col("reference_key")), F.lit("-"), F.col("current_id")).alias("id"),
            F.lit("critical").alias("severity"), F.lit("possible_duplicate_payment").alias("check_name"),
            F.col("current_id").alias("target_id")),
        s.filter(rdays > 60).select(
            "company_id", F.lit("val-receivable-days").alias("id"),
            F.when(rdays > 75, "high").otherwise("medium").alias("severity"),
            F.lit("slow_receivables").alias("check_name"), F.lit("asset-receivables").alias("target_id")),
    ]
    issues = checks[0].select(*cols)
    for ch in checks[1:]:
        issues = issues.unionByName(ch.select(*cols))
    if previous is None:
        return issues.withColumn("status", F.lit("open"))
    prev = previous.select("company_id", "id", F.col("status").alias("prev_status"))
    return (issues.join(prev, ["company_id", "id"], "left")
            .withColumn("status", F.coalesce("prev_status", F.lit("open"))).drop("prev_status"))


VALIDATIONS_SQL = W("o_snapshot", "v_invoices", "v_transactions") + DUP_SQL + f""",
vi AS (
  SELECT company_id, 'val-current-ratio' AS id, CASE WHEN current_ratio < 1 THEN 'critical' ELSE 'high' END AS severity,
         'low_current_ratio' AS check_name, 'current-ratio-card' AS target_id FROM o_snapshot
  WHERE current_ratio IS NOT NULL AND current_ratio < {R.CURRENT_RATIO_TARGET}
  UNION ALL
  SELECT company_id, 'val-cash-runway', CASE WHEN cash_runway_days < 21 THEN 'critical' ELSE 'high' END,
         'low_cash_runway', 'cash-card' FROM o_snapshot WHERE cash_runway_days <> 0 AND cash_runway_days < {R.CASH_RUNWAY_TARGET_DAYS}
  UNION ALL
  SELECT company_id, 'val-overdue-invoices', CASE WHEN overdue_invoice_total > greatest(cash, 1.0) THEN 'high' ELSE 'medium' END,
         'overdue_invoices', 'asset-receivables' FROM o_snapshot WHERE overdue_invoice_total > 0
  UNION ALL
  SELECT company_id, 'val-invoice-' || regexp_replace(regexp_replace(lower(invoice_number), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'),
         'critical', 'duplicate_invoice_number', max(id) FROM v_invoices GROUP BY company_id, invoice_number HAVING count(*) > 1
  UNION ALL
  SELECT company_id, 'val-txn-' || regexp_replace(regexp_replace(lower(reference_key), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || current_id,
         'critical', 'possible_duplicate_payment', current_id FROM dp
  UNION ALL
  SELECT company_id, 'val-receivable-days', CASE WHEN receivable_days > 75 THEN 'high' ELSE 'medium' END,
         'slow_receivables', 'asset-receivables' FROM o_snapshot WHERE receivable_days > 60)"""


@query("validations_run", VALIDATIONS_SQL + " SELECT *, 'open' AS status FROM vi")
def q_validations_run(c: Ctx):
    """Six business checks (ratio, runway, overdue, duplicate invoices/payments, receivable days)."""
    return validations_run(c)


@query("validation_counts", VALIDATIONS_SQL + " SELECT company_id, severity, CAST(count(*) AS BIGINT) AS count FROM vi GROUP BY 1, 2")
def q_validation_counts(c: Ctx):
    """Open issues of a company per severity."""
    return validations_run(c).filter(F.col("status") == "open").groupBy("company_id", "severity").agg(F.count("*").cast("bigint").alias("count"))


@query("validation_queue", VALIDATIONS_SQL + """ SELECT company_id, id, severity, check_name, target_id FROM vi
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, id) <= 15""")
def q_validation_queue(c: Ctx):
    """Top 15 open issues of each company by severity rank (id as tie-break)."""
    v = validations_run(c).filter(F.col("status") == "open")
    return WN.top_k_per_group(v, ["company_id"], 15, [severity_rank(F.col("severity")), F.col("id")]).select("company_id", "id", "severity", "check_name", "target_id")
