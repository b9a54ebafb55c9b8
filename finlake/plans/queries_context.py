"""Context products: semantic metric readiness and question-to-file matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..context import Ctx
from ..functions import rules as R
from ..oracle.views import with_views as W
from ..registry import query
from .queries_catalog import received_types
from .queries_domains import BAS_SQL, REVIEW_SQL
from .queries_intake import ROUTED_SQL, routed_uploads

# FIXED VALUES: semantic metric definitions (metric id, required document types)
METRIC_REQUIREMENTS = (
    ("cash_balance", ("balance_sheet",)),
    ("working_capital", ("balance_sheet",)),
    ("current_ratio", ("balance_sheet",)),
    ("net_profit", ("profit_loss",)),
    ("monthly_inflows", ("bank_statements",)),
    ("monthly_outflows", ("bank_statements",)),
    ("overdue_invoice_total", ("supplier_invoices", "sales_invoices")),
    ("taxable_profit", ("profit_loss",)),
    ("marketing_roas", ("marketing_data",)),
    ("data_trust_score", ()),
)


def metric_readiness(c: Ctx) -> DataFrame:
    """Per metric: missing = required documents not received (anti-join after explode); status
    blocked / ready (taxable profit provisional while the tax basis is the P&L statement; ROAS
    provisional without verified marketing evidence)."""
    from ..plans.domains import tax_position

    comp = c.uploads.select("company_id").distinct()
    defs = comp.select("company_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric_id"), F.array(*[F.lit(d) for d in req]).cast("array<string>").alias("req"))
        for m, req in METRIC_REQUIREMENTS])).alias("m")).select("company_id", "m.*")
    req = defs.select("company_id", "metric_id", F.explode("req").alias("document_type"))
    missing = (req.join(received_types(c), ["company_id", "document_type"], "left_anti")
               .groupBy("company_id", "metric_id").agg(F.array_join(F.array_sort(F.collect_list("document_type")), ",")
                                                        .alias("missing_documents")))
    basis = tax_position(c).select("company_id", "profit_basis")
    j = defs.join(missing, ["company_id", "metric_id"], "left").join(basis, "company_id", "left")
    miss = F.coalesce("missing_documents", F.lit(""))
    status = (F.when(miss != "", "blocked")
              .when((F.col("metric_id") == "taxable_profit") & (F.col("profit_basis") == "latest_profit_loss"), "provisional")
              .otherwise("ready"))
    return j.select("company_id", "metric_id", status.alias("status"), miss.alias("missing_documents"))


METRIC_SQL = W("v_uploads", "o_classified", "v_payroll", "o_trial_balance", "v_statements") + ROUTED_SQL + """
, rec AS (SELECT DISTINCT company_id, document_type FROM routed WHERE processing_status IN ('committed', 'stored_source', 'pending_mapping') AND document_type IS NOT NULL),
defs AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{m}', [{', '.join(repr(d) for d in req)}]::VARCHAR[])" for m, req in METRIC_REQUIREMENTS) + """) t(metric_id, req)),
comp AS (SELECT DISTINCT company_id FROM v_uploads),
md AS (SELECT comp.company_id, defs.* FROM comp CROSS JOIN defs),
rq AS (SELECT company_id, metric_id, unnest(req) AS document_type FROM md),
ms AS (SELECT rq.company_id, metric_id, string_agg(rq.document_type, ',' ORDER BY rq.document_type) AS missing_documents
       FROM rq LEFT JOIN rec ON rec.company_id = rq.company_id AND rec.document_type = rq.document_type
       WHERE rec.document_type IS NULL GROUP BY 1, 2)"""


def _tax_basis_sql() -> str:
    from .queries_domains import TAX_POSITION_SQL

    return TAX_POSITION_SQL


@query("metric_readiness", METRIC_SQL + _tax_basis_sql() + """,
mr AS (
  SELECT md.company_id, md.metric_id, CASE
      WHEN coalesce(ms.missing_documents, '') <> '' THEN 'blocked'
      WHEN md.metric_id = 'taxable_profit' AND tx.use_stmt THEN 'provisional' ELSE 'ready' END AS status,
    coalesce(ms.missing_documents, '') AS missing_documents
  FROM md LEFT JOIN ms USING (company_id, metric_id) LEFT JOIN tx USING (company_id))
SELECT * FROM mr""")
def q_metric_readiness(c: Ctx):
    """Semantic metrics: ready / provisional / blocked with their missing documents."""
    return metric_readiness(c)


@query("metric_state_counts", METRIC_SQL + _tax_basis_sql() + """,
mr AS (
  SELECT md.company_id, md.metric_id, CASE
      WHEN coalesce(ms.missing_documents, '') <> '' THEN 'blocked'
      WHEN md.metric_id = 'taxable_profit' AND tx.use_stmt THEN 'provisional' ELSE 'ready' END AS status
  FROM md LEFT JOIN ms USING (company_id, metric_id) LEFT JOIN tx USING (company_id))
SELECT company_id, status, CAST(count(*) AS BIGINT) AS metrics FROM mr GROUP BY 1, 2""")
def q_metric_state_counts(c: Ctx):
    """Number of semantic metrics of a company per readiness state."""
    return metric_readiness(c).groupBy("company_id", "status").agg(F.count("*").cast("bigint").alias("metrics"))


# ----------------------------------------------------------------------------- question -> files

def _substrings(col: str, min_len: int = 3) -> F.Column:
    """All distinct substrings of length >= min_len (an n-gram index of a short name)."""
    return F.expr(
        f"filter(array_distinct(flatten(transform(sequence(1, greatest(length({col}), 1)), "
        f"i -> transform(sequence(i, greatest(length({col}), i)), j -> substring({col}, i, j - i + 1))))), "
        f"x -> length(x) >= {min_len})")


def file_token_match(questions: DataFrame, uploads: DataFrame, k: int = 8) -> DataFrame:
    """Files whose name or document type contains question tokens ([a-z0-9_-]{3,}); score = number
    of distinct tokens found; top k per question, else the k newest files of the company.

    Substring containment is turned into an equi-join: each file name / type explodes into its
    distinct substrings (bounded by the name length), tokens join on equality. Files with the same tokens
    score alike for every question, so only the first k of them can count; questions with the same
    tokens are answered once. No question meets all files of a frequent token."""
    company, tokens = "company_id", lambda name: F.array_sort(F.collect_set("token")).alias(name)
    toks = questions.select(company, "question_id", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_-]{3,})"), F.lit(1)))).alias("token"))
    names = uploads.select(company, "upload_id", F.lower("filename").alias("fn"),
                           F.lower(F.coalesce("document_type", F.lit(""))).alias("dt"))
    grams = names.select(company, "upload_id", F.explode(F.array_distinct(F.concat(_substrings("fn"), _substrings("dt"))))
                         .alias("token"))
    files = grams.join(toks.select(company, "token").distinct(), [company, "token"]).groupBy(company, "upload_id").agg(tokens("named"))
    fw = Window.partitionBy(company, "named").orderBy("upload_id")
    first = files.withColumn("_n", F.row_number().over(fw)).filter(F.col("_n") <= k).groupBy(company, "named").agg(F.collect_list("upload_id").alias("files"))
    named = first.select(company, "named", "files", F.explode("named").alias("token"))
    known = toks.join(named.select(company, "token").distinct(), [company, "token"], "left_semi").groupBy(company, "question_id").agg(tokens("asked"))
    asked = known.select(company, "asked").distinct().select(company, "asked", F.explode("asked").alias("token"))
    score = F.count("*").cast("bigint").alias("score")
    hits = asked.join(named, [company, "token"]).groupBy(company, "asked", "named", "files").agg(score).select(company, "asked", "score", F.explode("files").alias("upload_id"))
    w = Window.partitionBy(company, "asked").orderBy(F.col("score").desc(), F.col("upload_id"))
    best = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    top = known.join(best, [company, "asked"])
    nw = Window.partitionBy("company_id").orderBy(F.col("created_at").desc(), F.col("upload_id").desc())
    newest = (uploads.withColumn("rank", F.row_number().over(nw)).filter(F.col("rank") <= k)
              .select("company_id", "upload_id", "rank"))
    unmatched = questions.select("company_id", "question_id").join(top.select("company_id", "question_id").distinct(),
                                                                    ["company_id", "question_id"], "left_anti")
    fallback = unmatched.join(newest, "company_id").withColumn("score", F.lit(0).cast("bigint"))
    cols = ["company_id", "question_id", "upload_id", "score", "rank"]
    return top.select(*cols).unionByName(fallback.select(*cols)).withColumn("rank", F.col("rank").cast("int"))


@query("file_token_match", W("v_uploads") + ROUTED_SQL + """
, q AS (SELECT 'default' AS company_id, conv_id || '-' || turn AS question_id, text FROM conversations WHERE role = 'user'),
tk AS (SELECT DISTINCT company_id, question_id, unnest(regexp_extract_all(lower(text), '([a-z0-9_-]{3,})', 1)) AS token FROM q),
h AS (SELECT tk.company_id, question_id, r.upload_id, CAST(count(DISTINCT token) AS BIGINT) AS score
      FROM tk JOIN routed r ON r.company_id = tk.company_id
       AND (contains(lower(r.filename), token) OR contains(lower(coalesce(r.document_type, '')), token))
      GROUP BY 1, 2, 3),
top AS (SELECT *, row_number() OVER (PARTITION BY company_id, question_id ORDER BY score DESC, upload_id) AS rank FROM h),
newest AS (SELECT company_id, upload_id, row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, upload_id DESC) AS rank
           FROM v_uploads),
un AS (SELECT company_id, question_id FROM q WHERE question_id NOT IN (SELECT question_id FROM h))
SELECT company_id, question_id, upload_id, score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 8
UNION ALL SELECT un.company_id, question_id, upload_id, CAST(0 AS BIGINT), CAST(rank AS INTEGER) FROM un JOIN newest
  ON newest.company_id = un.company_id WHERE rank <= 8""")
def q_file_token_match(c: Ctx):
    """For each user message: the uploaded files whose name or type contains its tokens (top 8)."""
    from .. import params as P

    qs = c.t.conversations.filter(F.col("role") == "user").select(
        F.lit(P.COMPANY).alias("company_id"),
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("question_id"), "text")
    return file_token_match(qs, routed_uploads(c))


# FIXED VALUES: information request definitions (key, information, priority, satisfying datasets)
INFORMATION_REQUESTS = (
    ("supplier_master", "Supplier list with countries and currencies", "high", ("suppliers",)),
    ("customer_master", "Customer list with locations or segments", "medium", ("customers",)),
    ("bank_statements", "Recent bank statement or transaction export", "high", ("bank_statements", "transactions")),
    ("budget", "Current budget or forecast", "medium", ("budgets",)),
    ("inventory", "Inventory or product catalogue", "medium", ("inventory",)),
    ("competitors", "Competitor names and operating markets", "medium", ("market_context",)),
    ("business_goals", "Business goals and KPI targets", "medium", ()),
)


def information_requests(c: Ctx, objective_given: bool = False) -> DataFrame:
    """Open / resolved requests: resolved when any satisfying dataset has completed uploads
    (definitions exploded, semi-join against received types); goals need a stated objective."""
    comp = c.uploads.select("company_id").distinct()
    defs = comp.select("company_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("request_key"), F.lit(i).alias("information"), F.lit(p).alias("priority"),
                 F.array(*[F.lit(d) for d in s]).cast("array<string>").alias("sat"))
        for k, i, p, s in INFORMATION_REQUESTS])).alias("d")).select("company_id", "d.*")
    sat = defs.select("company_id", "request_key", F.explode("sat").alias("document_type"))
    covered = sat.join(received_types(c), ["company_id", "document_type"], "left_semi").select(
        "company_id", "request_key").distinct().withColumn("cov", F.lit(True))
    j = defs.join(covered, ["company_id", "request_key"], "left")
    cov = F.when(F.col("request_key") == "business_goals", F.lit(objective_given)).otherwise(F.coalesce("cov", F.lit(False)))
    return j.select("company_id", "request_key", "information", "priority",
                    F.when(cov, "resolved").otherwise("open").alias("status"))


@query("information_requests", W("v_uploads") + ROUTED_SQL + """
, rec AS (SELECT DISTINCT company_id, document_type FROM routed WHERE processing_status IN ('committed', 'stored_source', 'pending_mapping') AND document_type IS NOT NULL),
defs AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{k}', '{i}', '{p}', [{', '.join(repr(d) for d in s)}]::VARCHAR[])" for k, i, p, s in INFORMATION_REQUESTS) + """)
         t(request_key, information, priority, sat)),
comp AS (SELECT DISTINCT company_id FROM v_uploads),
d AS (SELECT comp.company_id, defs.* FROM comp CROSS JOIN defs),
cov AS (SELECT DISTINCT d.company_id, request_key FROM (SELECT company_id, request_key, unnest(sat) AS document_type FROM d) d
        JOIN rec ON rec.company_id = d.company_id AND rec.document_type = d.document_type)
SELECT d.company_id, d.request_key, information, priority,
       CASE WHEN d.request_key = 'business_goals' THEN 'open' WHEN cov.request_key IS NOT NULL THEN 'resolved' ELSE 'open' END AS status
FROM d LEFT JOIN cov ON cov.company_id = d.company_id AND cov.request_key = d.request_key""")
def q_information_requests(c: Ctx):
    """The seven information requests with their status from received document types."""
    return information_requests(c)


def working_context_events(events: DataFrame, keep: int = 36, summary_lines: int = 12, max_chars: int = 2000) -> DataFrame:
    """Per user: the newest ``keep`` events and a continuity summary of the last ``summary_lines``
    (chronological), tail-capped at ``max_chars``. The window only ranks within a user; collected
    lists hold at most ``summary_lines`` entries."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    r = events.withColumn("rd", F.row_number().over(w)).filter(F.col("rd") <= keep)
    line = F.concat(F.lit("- "), F.col("ts").cast("string"), F.lit(": ["), F.col("event_type"), F.lit("] "),
                    F.coalesce(F.col("props"), F.lit("")))
    s = r.filter(F.col("rd") <= summary_lines).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("l")))).alias("xs"))
    cnt = r.groupBy("user_id").agg(F.count("*").cast("bigint").alias("kept_events"), F.min("ts").alias("oldest_kept"))
    summary = F.concat(F.lit("Recent continuity:\n"), F.array_join(F.col("xs.l"), "\n"))
    return cnt.join(s, "user_id").select("user_id", "kept_events", "oldest_kept",
                                         F.substring(summary, -max_chars, max_chars).alias("summary"))


@query("working_context_events", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rd FROM events),
k AS (SELECT * FROM r WHERE rd <= 36),
s AS (SELECT user_id, string_agg('- ' || CAST(ts AS VARCHAR) || ': [' || event_type || '] ' || coalesce(props, ''), chr(10)
                                 ORDER BY ts, event_id) AS body FROM k WHERE rd <= 12 GROUP BY 1)
SELECT user_id, CAST(count(*) AS BIGINT) AS kept_events, min(ts) AS oldest_kept,
       right('Recent continuity:' || chr(10) || any_value(s.body), 2000) AS summary
FROM k JOIN s USING (user_id) GROUP BY user_id""")
def q_working_context_events(c: Ctx):
    """Working context per user over the whole event table: newest 36 events, last-12 summary."""
    return working_context_events(c.t.events)


# FIXED VALUES: tax obligation rows (key, name, frequency)
OBLIGATIONS = {
    "bas": ("Business Activity Statement", "Quarterly"),
    "gst_registration": ("GST registration monitoring", "Ongoing"),
    "income_tax": ("Income tax return workpaper", "Annual"),
    "records": ("Tax and accounting record retention", "Continuous"),
    "stp": ("Single Touch Payroll reporting", "Each pay event"),
    "super": ("Payday Super", "Each payday from 1 July 2026"),
    "fbt": ("Fringe benefits review", "Annual and transaction review"),
}


def tax_obligations(c: Ctx, gst_registered: bool = True) -> DataFrame:
    """Obligation rows from the tax profile and the data: BAS (review while tasks are open or net
    GST is non-zero), income tax, record retention, and payroll obligations when payroll exists."""
    from ..plans.domains import bas_labels, tax_review_counts

    base = (bas_labels(c).select("company_id", "net_gst")
            .join(tax_review_counts(c).select("company_id", "unresolved"), "company_id")
            .join(c.payroll.groupBy("company_id").agg(F.count("*").alias("pay_rows")), "company_id", "left"))

    def ob(key, status, when=None):
        name, freq = OBLIGATIONS[key]
        s = F.struct(F.lit(key).alias("key"), F.lit(name).alias("name"), F.lit(freq).alias("frequency"),
                     F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"))
        return s if when is None else F.when(when, s)

    review = F.col("unresolved") > 0
    employees = F.coalesce("pay_rows", F.lit(0)) > 0
    rows = F.array(
        ob("bas", F.when(review | (F.col("net_gst") != 0), "review").otherwise("ready"), F.lit(gst_registered)),
        ob("gst_registration", "information", F.lit(not gst_registered)),
        ob("income_tax", "review"),
        ob("records", F.when(review, "review").otherwise("ready")),
        ob("stp", "review", employees), ob("super", "review", employees), ob("fbt", "information", employees))
    return base.select("company_id", F.explode(rows).alias("o")).filter(F.col("o").isNotNull()).select("company_id", "o.*")


@query("tax_obligations", W("o_classified", "v_payroll") + BAS_SQL + REVIEW_SQL + """,
pc AS (SELECT company_id, count(*) AS n FROM v_payroll GROUP BY 1),
b AS (SELECT bas.company_id, bas.net_gst, rc.unresolved, coalesce(pc.n, 0) AS pay_rows
      FROM bas JOIN rc USING (company_id) LEFT JOIN pc USING (company_id))
SELECT company_id, 'bas' AS key, 'Business Activity Statement' AS name, 'Quarterly' AS frequency,
       CASE WHEN unresolved > 0 OR net_gst <> 0 THEN 'review' ELSE 'ready' END AS status FROM b
UNION ALL SELECT company_id, 'income_tax', 'Income tax return workpaper', 'Annual', 'review' FROM b
UNION ALL SELECT company_id, 'records', 'Tax and accounting record retention', 'Continuous',
       CASE WHEN unresolved > 0 THEN 'review' ELSE 'ready' END FROM b
UNION ALL SELECT company_id, 'stp', 'Single Touch Payroll reporting', 'Each pay event', 'review' FROM b WHERE pay_rows > 0
UNION ALL SELECT company_id, 'super', 'Payday Super', 'Each payday from 1 July 2026', 'review' FROM b WHERE pay_rows > 0
UNION ALL SELECT company_id, 'fbt', 'Fringe benefits review', 'Annual and transaction review', 'information' FROM b WHERE pay_rows > 0""")
def q_tax_obligations(c: Ctx):
    """Tax obligations for a GST-registered employer, with review status from the data."""
    return tax_obligations(c)


@query("top_contributors", W("v_assets_liabilities") + """
SELECT company_id, category, classification, id, name, round(CAST(amount AS DOUBLE), 2) AS amount, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, category, classification ORDER BY amount DESC, id) AS rk FROM v_assets_liabilities)
WHERE rk <= 4""")
def q_top_contributors(c: Ctx):
    """Top 4 positions of a company per (category, classification)."""
    from ..functions.expr import out_money
    from ..operators.windows import top_k_per_group

    r = top_k_per_group(c.assets_liabilities, ["company_id", "category", "classification"], 4, [F.col("amount").desc(), F.col("id")])
    return r.select("company_id", "category", "classification", "id", "name", out_money("amount").alias("amount"),
                    F.col("rank").cast("int").alias("rank"))


@query("unreconciled_staged_files", W("v_uploads") + """
SELECT company_id, upload_id, filename FROM v_uploads s WHERE (company_id, lower(trim(regexp_replace(filename, '^.*?__', '')))) NOT IN (
  SELECT (company_id, lower(trim(regexp_replace(filename, '^.*?__', '')))) FROM v_uploads WHERE processing_status IN ('committed', 'stored_source', 'pending_mapping'))""")
def q_unreconciled_staged_files(c: Ctx):
    """Staged files whose visible name is not among the company's completed uploads (anti-join)."""
    from ..functions.expr import visible_name

    key = F.lower(F.trim(visible_name(F.col("filename"))))
    staged = c.uploads.select("company_id", "upload_id", "filename", key.alias("k"))
    done = c.uploads.filter(F.col("processing_status").isin(*R.COMPLETE_UPLOAD_STATUSES)).select("company_id", key.alias("k")).distinct()
    return staged.join(done, ["company_id", "k"], "left_anti").select("company_id", "upload_id", "filename")


@query("kpi_snapshot_append", W("o_snapshot") + """
SELECT company_id, v AS data_version, cash, current_ratio, revenue_month, open_invoice_total
FROM o_snapshot, (VALUES (1), (2)) t(v)""")
def q_kpi_snapshot_append(c: Ctx):
    """The snapshot appended twice to the KPI history (schema-relaxed, newest 5000 per company shown),
    read back from shared storage: both versions are there."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources.sinks import kpi_snapshot_append

    hist = f"{checkpoint_dir(c.spark).rstrip('/')}/finlake-kpi/{uuid.uuid4().hex}"
    kpi_snapshot_append(c.spark, hist, c.snapshot, "1998-06-30 00:00:00", 1)
    out = kpi_snapshot_append(c.spark, hist, c.snapshot, "1998-07-01 00:00:00", 2)
    return out.select("company_id", F.col("data_version").cast("int").alias("data_version"), "cash", "current_ratio",
                      "revenue_month", "open_invoice_total")


# FIXED VALUES: decision definitions (decision id, label, required types, supporting types)
DECISIONS = (
    ("liquidity_cash", "Liquidity and cash", ("balance_sheet", "cash_flow_statement"),
     ("bank_statements", "aged_debtors_creditors", "sales_invoices", "supplier_invoices")),
    ("profit_margin", "Profit and margin", ("profit_loss",), ("sales_invoices", "supplier_invoices", "sales_forecast")),
    ("tax_compliance", "Tax and compliance", ("chart_of_accounts",),
     ("supplier_invoices", "sales_invoices", "payroll", "bank_statements", "historical_tax_returns")),
    ("growth_marketing", "Growth and marketing", ("sales_invoices",),
     ("supplier_invoices", "sales_forecast", "market_context", "business_requirements")),
    ("competitor_market", "Competitor and market", ("market_context",),
     ("balance_sheet", "profit_loss", "sales_forecast", "business_requirements", "material_contracts")),
)


def _decision_types(spark) -> DataFrame:
    rows = [(d, t, "required") for d, _l, req, _s in DECISIONS for t in req] + \
           [(d, t, "supporting") for d, _l, _r, sup in DECISIONS for t in sup]
    return spark.createDataFrame(rows, "decision_id string, document_type string, connection_role string")


def source_decision_links(c: Ctx) -> DataFrame:
    """Each routed source linked to every decision whose required or supporting types include it
    (the 30-row definition table is joined on document type; AQE broadcasts it)."""
    src = routed_uploads(c).filter(F.col("document_type").isNotNull())
    return src.join(_decision_types(c.spark), "document_type").select(
        "company_id", "decision_id", F.col("upload_id").alias("source_key"), "connection_role")


def decision_readiness(c: Ctx) -> DataFrame:
    links = source_decision_links(c)
    done = routed_uploads(c).filter(F.col("processing_status").isin(*R.COMPLETE_UPLOAD_STATUSES)).select("company_id", "document_type").distinct()
    required = F.array(*[F.struct(F.lit(d).alias("decision_id"), F.lit(t).alias("document_type"))
                         for d, _l, req, _s in DECISIONS for t in req])
    need = c.uploads.select("company_id").distinct().select("company_id", F.explode(required).alias("r")).select(
        "company_id", "r.decision_id", "r.document_type")
    have = need.join(done, ["company_id", "document_type"], "left_semi").groupBy("company_id", "decision_id") \
        .agg(F.count("*").alias("present"))
    missing = need.join(done, ["company_id", "document_type"], "left_anti").groupBy("company_id", "decision_id") \
        .agg(F.array_join(F.array_sort(F.collect_list("document_type")), ",").alias("missing_required"))
    conn = links.groupBy("company_id", "decision_id").agg(F.count("*").cast("bigint").alias("source_count"))
    base = need.groupBy("company_id", "decision_id").agg(F.count("*").alias("required"))
    j = base.join(have, ["company_id", "decision_id"], "left").join(missing, ["company_id", "decision_id"], "left") \
        .join(conn, ["company_id", "decision_id"], "left")
    present, cnt = F.coalesce("present", F.lit(0)), F.coalesce("source_count", F.lit(0)).cast("bigint")
    readiness = F.when(present == F.col("required"), "ready").when((present > 0) | (cnt > 0), "provisional").otherwise("blocked")
    return j.select("company_id", "decision_id", readiness.alias("readiness"), cnt.alias("source_count"),
                    F.coalesce("missing_required", F.lit("")).alias("missing_required"))


DECISION_SQL = W("v_uploads") + ROUTED_SQL + """,
dt AS (SELECT * FROM (VALUES """ + ", ".join(
    [f"('{d}', '{t}', 'required')" for d, _l, req, _s in DECISIONS for t in req] +
    [f"('{d}', '{t}', 'supporting')" for d, _l, _r, sup in DECISIONS for t in sup]) + """) t(decision_id, document_type, connection_role)),
links AS (SELECT r.company_id, dt.decision_id, r.upload_id AS source_key, dt.connection_role
          FROM routed r JOIN dt ON dt.document_type = r.document_type)"""


@query("source_decision_links", DECISION_SQL + " SELECT * FROM links")
def q_source_decision_links(c: Ctx):
    """Sources connected to each decision as required or supporting evidence."""
    return source_decision_links(c)


@query("decision_readiness", DECISION_SQL + """,
done AS (SELECT DISTINCT company_id, document_type FROM routed WHERE processing_status IN ('committed', 'stored_source', 'pending_mapping') AND document_type IS NOT NULL),
comp AS (SELECT DISTINCT company_id FROM v_uploads),
need AS (SELECT comp.company_id, dt.decision_id, dt.document_type FROM comp, dt WHERE dt.connection_role = 'required'),
agg AS (SELECT need.company_id, need.decision_id, count(*) AS required, count(done.document_type) AS present,
               coalesce(string_agg(CASE WHEN done.document_type IS NULL THEN need.document_type END, ','
                                   ORDER BY need.document_type), '') AS missing_required
        FROM need LEFT JOIN done ON done.company_id = need.company_id AND done.document_type = need.document_type
        GROUP BY 1, 2),
conn AS (SELECT company_id, decision_id, count(*) AS n FROM links GROUP BY 1, 2)
SELECT agg.company_id, agg.decision_id,
       CASE WHEN present = required THEN 'ready' WHEN present > 0 OR coalesce(n, 0) > 0 THEN 'provisional' ELSE 'blocked' END AS readiness,
       CAST(coalesce(n, 0) AS BIGINT) AS source_count, missing_required
FROM agg LEFT JOIN conn ON conn.company_id = agg.company_id AND conn.decision_id = agg.decision_id""")
def q_decision_readiness(c: Ctx):
    """Decision readiness: ready when all required types are received, provisional with partial
    or supporting evidence, else blocked."""
    return decision_readiness(c)


def page_readiness(c: Ctx) -> DataFrame:
    """Five pages (overview, accounts, tax, marketing, data management): record counts and
    ready / provisional / blocked from the products each page shows (one row per company each,
    joined on company_id)."""
    from ..operators import aggregates as AG
    from ..operators import windows as WN
    from .domains import bas_labels, channel_spend, tax_position
    from .queries_catalog import set_coverage
    from .queries_core import account_type_summary

    s = c.snapshot
    months = WN.last_n_months(AG.monthly_flow(c.transactions), 6).groupBy("company_id").agg(F.count("*").alias("months"))
    missing = set_coverage(c).groupBy("company_id").agg(F.count(F.when(F.col("state") == "missing", 1)).alias("core_missing"))
    tasks = c.classified.groupBy("company_id").agg(F.count(F.when(F.col("c_validation") != "approved", 1)).alias("open_tasks"))
    accounts = c.trial_balance.groupBy("company_id").agg(F.count("*").alias("accounts"))
    tax = tax_position(c).select("company_id", "accounting_profit", "estimated_taxable_income") \
        .join(bas_labels(c).select("company_id", "net_gst"), "company_id")
    obligations = tax_obligations(c).groupBy("company_id").agg(F.count("*").alias("obligations"))
    ch = channel_spend(c).groupBy("company_id").agg(F.count("*").alias("channels"), F.sum("spend").alias("spend"))
    revenue = account_type_summary(c).select("company_id", F.col("revenue").alias("ledger_revenue"))
    ups = c.uploads.groupBy("company_id").agg(F.count("*").alias("uploads"))
    j = (s.join(months, "company_id", "left").join(missing, "company_id", "left").join(tasks, "company_id", "left")
         .join(accounts, "company_id", "left").join(tax, "company_id", "left").join(obligations, "company_id", "left")
         .join(ch, "company_id", "left").join(revenue, "company_id", "left").join(ups, "company_id", "left").na.fill(0))
    over = (F.abs("total_assets") > 0) | (F.abs("total_liabilities") > 0) | (F.abs("revenue_month") > 0) | \
        (F.abs("expenses_month") > 0) | (F.abs("cash") > 0)
    tax_data = (F.abs("accounting_profit") > 0) | (F.abs("estimated_taxable_income") > 0) | (F.abs("net_gst") > 0)
    mk_rev = F.when(F.col("ledger_revenue") != 0, F.col("ledger_revenue")).otherwise(F.col("revenue_month"))
    mk_data = (F.abs(mk_rev) > 0) | (F.abs("spend") > 0)
    actual = F.col("spend") > 0.01

    def pg(pid, label, count, status):
        return F.struct(F.lit(pid).alias("id"), F.lit(label).alias("label"), count.cast("bigint").alias("record_count"),
                        status.alias("status"))

    rows = F.array(
        pg("overview", "Overview", F.col("months"),
           F.when(over & (F.col("core_missing") == 0), "ready").when(over, "provisional").otherwise("blocked")),
        pg("accounts", "Accounts", F.col("accounts"),
           F.when((F.col("accounts") > 0) & (F.col("open_tasks") == 0), "ready").when(F.col("accounts") > 0, "provisional")
           .otherwise("blocked")),
        pg("tax", "Tax", F.col("obligations"),
           F.when(tax_data & (F.col("open_tasks") == 0), "ready").when(tax_data, "provisional").otherwise("blocked")),
        pg("marketing", "Marketing", F.col("channels"),
           F.when(mk_data & actual, "ready").when(mk_data, "provisional").otherwise("blocked")),
        pg("operations", "Data management", F.col("uploads"), F.when(F.col("uploads") > 0, "ready").otherwise("blocked")),
    )
    return j.select("company_id", F.explode(rows).alias("p")).select("company_id", "p.*")


def _page_sql() -> str:
    from .queries_catalog import COVERAGE_SQL
    from .queries_domains import CHANNEL_SQL, TAX_POSITION_SQL

    views = W("v_uploads", "o_snapshot", "o_classified", "v_payroll", "o_trial_balance", "v_statements", "o_monthly")
    cov = COVERAGE_SQL[len(W("v_uploads") + ROUTED_SQL):]
    return views + ROUTED_SQL + cov + TAX_POSITION_SQL + CHANNEL_SQL + f""",
mo AS (SELECT company_id, count(*) AS months FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS rn
       FROM o_monthly) WHERE rn <= 6 GROUP BY 1),
cm AS (SELECT company_id, count(CASE WHEN state = 'missing' THEN 1 END) AS core_missing FROM cov GROUP BY 1),
tk AS (SELECT company_id, count(CASE WHEN c_validation <> 'approved' THEN 1 END) AS open_tasks FROM o_classified GROUP BY 1),
ac AS (SELECT company_id, count(*) AS accounts FROM o_trial_balance GROUP BY 1),
tq AS (SELECT company_id, profit AS accounting_profit, greatest(0.0, profit) AS taxable, net_gst, unresolved FROM tx),
ob AS (SELECT tq.company_id, 3 + CASE WHEN pc.n > 0 THEN 3 ELSE 0 END AS obligations FROM tq
       LEFT JOIN (SELECT company_id, count(*) AS n FROM v_payroll GROUP BY 1) pc USING (company_id)),
chx AS (SELECT company_id, count(*) AS channels, sum(spend) AS spend FROM cs GROUP BY 1),
lr AS (SELECT round(CAST(sum(CASE WHEN account_type = 'revenue' THEN balance ELSE 0 END) AS DOUBLE), 2) AS ledger_revenue FROM o_trial_balance),
up AS (SELECT company_id, count(*) AS uploads FROM v_uploads GROUP BY 1),
j AS (
  SELECT s.company_id, s.total_assets, s.total_liabilities, s.revenue_month, s.expenses_month, s.cash,
         coalesce(mo.months, 0) AS months, coalesce(cm.core_missing, 0) AS core_missing, coalesce(tk.open_tasks, 0) AS open_tasks,
         coalesce(ac.accounts, 0) AS accounts, coalesce(tq.accounting_profit, 0) AS accounting_profit,
         coalesce(tq.taxable, 0) AS taxable, coalesce(tq.net_gst, 0) AS net_gst, coalesce(ob.obligations, 0) AS obligations,
         coalesce(chx.channels, 0) AS channels, coalesce(chx.spend, 0) AS spend, coalesce(lr.ledger_revenue, 0) AS ledger_revenue,
         coalesce(up.uploads, 0) AS uploads
  FROM o_snapshot s LEFT JOIN mo USING (company_id) LEFT JOIN cm USING (company_id) LEFT JOIN tk USING (company_id)
  LEFT JOIN ac USING (company_id) LEFT JOIN tq USING (company_id) LEFT JOIN ob USING (company_id)
  LEFT JOIN chx USING (company_id) CROSS JOIN lr LEFT JOIN up USING (company_id)),
f AS (
  SELECT *, abs(total_assets) > 0 OR abs(total_liabilities) > 0 OR abs(revenue_month) > 0 OR abs(expenses_month) > 0 OR abs(cash) > 0 AS over,
         abs(accounting_profit) > 0 OR abs(taxable) > 0 OR abs(net_gst) > 0 AS tax_data,
         abs(CASE WHEN ledger_revenue <> 0 THEN ledger_revenue ELSE revenue_month END) > 0 OR abs(spend) > 0 AS mk_data,
         spend > 0.01 AS actual FROM j)
SELECT company_id, 'overview' AS id, 'Overview' AS label, CAST(months AS BIGINT) AS record_count,
       CASE WHEN over AND core_missing = 0 THEN 'ready' WHEN over THEN 'provisional' ELSE 'blocked' END AS status FROM f
UNION ALL SELECT company_id, 'accounts', 'Accounts', CAST(accounts AS BIGINT),
       CASE WHEN accounts > 0 AND open_tasks = 0 THEN 'ready' WHEN accounts > 0 THEN 'provisional' ELSE 'blocked' END FROM f
UNION ALL SELECT company_id, 'tax', 'Tax', CAST(obligations AS BIGINT),
       CASE WHEN tax_data AND open_tasks = 0 THEN 'ready' WHEN tax_data THEN 'provisional' ELSE 'blocked' END FROM f
UNION ALL SELECT company_id, 'marketing', 'Marketing', CAST(channels AS BIGINT),
       CASE WHEN mk_data AND actual THEN 'ready' WHEN mk_data THEN 'provisional' ELSE 'blocked' END FROM f
UNION ALL SELECT company_id, 'operations', 'Data management', CAST(uploads AS BIGINT),
       CASE WHEN uploads > 0 THEN 'ready' ELSE 'blocked' END FROM f"""


@query("page_readiness", _page_sql())
def q_page_readiness(c: Ctx):
    """Readiness of the five user-facing pages from the data behind each of them."""
    return page_readiness(c)


def freshness_counts(c: Ctx, as_of: str | None = None) -> DataFrame:
    """Sources per freshness state at ``as_of`` and the data cut-off (latest processed source)."""
    from .. import params as P
    from ..functions.expr import freshness_state

    as_of = as_of or P.REGISTRY_AS_OF
    src = routed_uploads(c)
    age = F.datediff(F.lit(as_of).cast("date"), F.col("created_at"))
    state = freshness_state(F.col("document_type"), F.col("intake_category"), age)
    cutoff = src.groupBy("company_id").agg(F.max("created_at").alias("data_cutoff"))
    return (src.groupBy("company_id", state.alias("freshness_state")).agg(F.count("*").cast("bigint").alias("sources"))
            .join(cutoff, "company_id"))


@query("freshness_counts", W("v_uploads") + ROUTED_SQL + """
, st AS (SELECT company_id, created_at, CASE
      WHEN document_type = 'market_context' THEN CASE WHEN date_diff('day', created_at, DATE '2025-01-01') <= 31 THEN 'fresh'
           WHEN date_diff('day', created_at, DATE '2025-01-01') <= 62 THEN 'watch' ELSE 'stale' END
      WHEN intake_category = 'recurring' THEN CASE WHEN date_diff('day', created_at, DATE '2025-01-01') <= 45 THEN 'fresh'
           WHEN date_diff('day', created_at, DATE '2025-01-01') <= 90 THEN 'watch' ELSE 'stale' END
      ELSE 'reference' END AS freshness_state FROM routed),
cut AS (SELECT company_id, max(created_at) AS data_cutoff FROM routed GROUP BY 1)
SELECT st.company_id, freshness_state, CAST(count(*) AS BIGINT) AS sources, any_value(cut.data_cutoff) AS data_cutoff
FROM st JOIN cut USING (company_id) GROUP BY 1, 2""")
def q_freshness_counts(c: Ctx):
    """Uploaded sources per freshness state (market 31/62 days, recurring 45/90, else reference)."""
    return freshness_counts(c)
