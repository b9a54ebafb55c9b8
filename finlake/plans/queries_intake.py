"""Intake, versioning and lifecycle queries plus conversation memory."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..context import Ctx
from ..functions import rules as R
from ..functions.expr import file_stem, first_keyword_class, out_money, route_token, sha1_prefix, token_estimate
from ..operators import incremental as INC
from ..oracle.views import with_views as W
from ..registry import query

HASH_COLS = ("code", "name", "country", "segment", "balance")


def _keyed(df):
    return df.withColumns({"business_key": F.lower(F.trim("code")), "row_hash": INC.text_hash(HASH_COLS)})


def fingerprint_state(c: Ctx):
    """Current fingerprints of the stored customer master (version 1)."""
    o = _keyed(c.batch_old)
    return o.select("company_id", "document_type", "business_key", "row_hash", F.lit(1).alias("record_version"),
                    F.concat(F.lit("lf-customers-"), sha1_prefix(F.col("business_key"))).alias("record_id"))


def classified_batch(c: Ctx):
    return INC.fingerprint_versions(_keyed(c.batch_new), fingerprint_state(c), scope=["company_id"])


CHANGE_SQL = """, st AS (
  SELECT company_id, document_type, lower(trim(code)) AS business_key, name, country, segment, balance, 1 AS s_ver,
         'lf-customers-' || substr(sha1(lower(trim(code))), 1, 16) AS s_id FROM v_batch_old),
nb AS (SELECT *, lower(trim(code)) AS business_key FROM v_batch_new),
j AS (
  SELECT nb.*, st.s_ver, st.s_id, st.business_key IS NOT NULL AS has_state,
         lag(nb.name) OVER w AS p_name, lag(nb.country) OVER w AS p_country, lag(nb.segment) OVER w AS p_segment,
         lag(nb.balance) OVER w AS p_balance, row_number() OVER w AS rn,
         st.name AS s_name, st.country AS s_country, st.segment AS s_segment, st.balance AS s_balance
  FROM nb LEFT JOIN st ON st.company_id = nb.company_id AND st.document_type = nb.document_type AND st.business_key = nb.business_key
  WINDOW w AS (PARTITION BY nb.company_id, nb.document_type, nb.business_key ORDER BY nb.seq)),
d AS (
  SELECT *, CASE
      WHEN NOT has_state AND rn = 1 THEN 'new'
      WHEN rn > 1 AND name = p_name AND country = p_country AND segment = p_segment AND balance = p_balance THEN 'unchanged'
      WHEN rn = 1 AND name = s_name AND country = s_country AND segment = s_segment AND balance = s_balance THEN 'unchanged'
      ELSE 'changed' END AS decision
  FROM j),
v AS (
  SELECT *, CAST(coalesce(s_ver, 0) + sum(CASE WHEN decision <> 'unchanged' THEN 1 ELSE 0 END)
            OVER (PARTITION BY company_id, document_type, business_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS record_version,
         coalesce(s_id, 'lf-' || document_type || '-' || substr(sha1(business_key), 1, 16)) AS record_id
  FROM d)"""


@query("row_change_classify", W("v_batch_old", "v_batch_new") + CHANGE_SQL + """
SELECT company_id, code, seq, decision, record_version, record_id FROM v""")
def q_row_change_classify(c: Ctx):
    """New / unchanged / changed per batch row against stored fingerprints and earlier rows of the
    same key in the batch; record versions and stable record ids."""
    return classified_batch(c).select("company_id", "code", "seq", "decision", "record_version", "record_id")


@query("row_change_counts", W("v_batch_old", "v_batch_new") + CHANGE_SQL + """
SELECT company_id, decision, CAST(count(*) AS BIGINT) AS rows FROM v GROUP BY 1, 2""")
def q_row_change_counts(c: Ctx):
    """Rows per change decision for one customer upload."""
    return INC.change_counts(classified_batch(c), ["company_id"])


@query("incremental_upsert", W("v_batch_old", "v_batch_new") + """
, u AS (SELECT company_id, code, name, country, segment, balance, -1 AS seq FROM v_batch_old
        UNION ALL SELECT company_id, code, name, country, segment, balance, seq FROM v_batch_new)
SELECT company_id, code, arg_max(name, seq) AS name, arg_max(country, seq) AS country, arg_max(segment, seq) AS segment,
       round(CAST(arg_max(balance, seq) AS DOUBLE), 2) AS balance
FROM u GROUP BY company_id, code""")
def q_incremental_upsert(c: Ctx):
    """Customer master after the upload: latest row per code wins, absent codes keep their row."""
    cols = ["company_id", "code", "name", "country", "segment", "balance"]
    up = INC.incremental_upsert(c.batch_old.select(*cols), c.batch_new.select(*cols, "seq"), ["company_id", "code"], "seq")
    return up.withColumn("balance", out_money("balance"))


@query("latest_wins", W("v_batch_new") + """
SELECT company_id, code, arg_max(seq, seq) AS seq, round(CAST(arg_max(balance, seq) AS DOUBLE), 2) AS balance FROM v_batch_new GROUP BY company_id, code""")
def q_latest_wins(c: Ctx):
    """Replace-by-id within one batch: the last row per code (max_by, partial aggregation)."""
    return INC.latest_wins(c.batch_new.select("company_id", "code", "seq", "balance"), ["company_id", "code"], "seq").withColumn(
        "balance", out_money("balance"))


@query("file_dedupe_decision", W("v_uploads") + """
, f AS (SELECT company_id, sha256, arg_min(upload_id, upload_id) AS fid, arg_min(processing_status, upload_id) AS fst,
               arg_min(intake_category, upload_id) AS fcat FROM v_uploads GROUP BY 1, 2)
SELECT u.company_id, u.upload_id, u.sha256, f.fid AS first_upload_id, CASE
    WHEN u.upload_id = f.fid THEN 'new'
    WHEN f.fst NOT IN ('committed', 'stored_source', 'pending_mapping') AND f.fst <> 'processing' THEN 'reprocess'
    WHEN u.intake_category <> f.fcat THEN 'moved' ELSE 'duplicate' END AS decision
FROM v_uploads u JOIN f ON f.company_id = u.company_id AND f.sha256 = u.sha256""")
def q_file_dedupe_decision(c: Ctx):
    """Content-hash duplicate decision per uploaded file: new / duplicate / moved / reprocess."""
    return INC.file_dedupe_decision(c.uploads)


def filename_route(filename: F.Column) -> F.Column:
    stem = route_token(file_stem(filename))
    rules = [(t, [R.route_token_py(tok) for tok in toks]) for t, toks in R.FILENAME_RULES]
    return first_keyword_class(stem, rules, None)


def _route_sql(col: str) -> str:
    stem = (f"regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_extract({col}, '([^/\\\\]*)$', 1), "
            f"'\\.[^.]*$', ''))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')")
    whens = " ".join("WHEN " + " OR ".join(f"contains(s, '{R.route_token_py(tok)}')" for tok in toks) + f" THEN '{t}'"
                     for t, toks in R.FILENAME_RULES)
    return f"(SELECT CASE {whens} END FROM (SELECT {stem} AS s))"


ROUTED_SQL = f""", routed AS (SELECT *, {_route_sql('filename')} AS document_type FROM v_uploads)"""


@query("filename_type_route", W("v_uploads") + ROUTED_SQL + " SELECT upload_id, filename, document_type FROM routed")
def q_filename_type_route(c: Ctx):
    """Document type from the file name (17 ordered token rules on the normalised stem)."""
    return c.uploads.select("upload_id", "filename", filename_route(F.col("filename")).alias("document_type"))


def routed_uploads(c: Ctx):
    return c.uploads.withColumn("document_type", filename_route(F.col("filename")))


@query("document_coverage", W("v_uploads") + ROUTED_SQL + """
SELECT company_id, coalesce(document_type, 'generic') AS document_type, CAST(count(*) AS BIGINT) AS files,
       CAST(sum(file_size) AS BIGINT) AS bytes FROM routed GROUP BY 1, 2""")
def q_document_coverage(c: Ctx):
    """Files and bytes per routed document type."""
    return (routed_uploads(c).groupBy("company_id", F.coalesce("document_type", F.lit("generic")).alias("document_type"))
            .agg(F.count("*").cast("bigint").alias("files"), F.sum("file_size").cast("bigint").alias("bytes")))


@query("upload_totals", W("v_uploads") + """
SELECT company_id, CAST(count(*) AS BIGINT) AS uploads,
       CAST(count(CASE WHEN processing_status IN ('committed', 'stored_source', 'pending_mapping') THEN 1 END) AS BIGINT) AS completed,
       CAST(count(CASE WHEN processing_status IN ('failed', 'stale') THEN 1 END) AS BIGINT) AS needs_retry,
       CAST(count(CASE WHEN processing_status = 'pending_mapping' THEN 1 END) AS BIGINT) AS awaiting_mapping,
       CAST(count(DISTINCT sha256) AS BIGINT) AS distinct_contents
FROM v_uploads GROUP BY 1""")
def q_upload_totals(c: Ctx):
    """Upload counts by lifecycle status and distinct contents."""
    s = F.col("processing_status")
    return c.uploads.groupBy("company_id").agg(
        F.count("*").cast("bigint").alias("uploads"), F.count(F.when(s.isin(*R.COMPLETE_UPLOAD_STATUSES), 1)).cast("bigint").alias("completed"),
        F.count(F.when(s.isin("failed", "stale"), 1)).cast("bigint").alias("needs_retry"),
        F.count(F.when(s == "pending_mapping", 1)).cast("bigint").alias("awaiting_mapping"),
        F.countDistinct("sha256").cast("bigint").alias("distinct_contents"))


@query("affected_metrics", W("v_uploads") + ROUTED_SQL + ", m AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{v}')" for k, vs in R.DEPENDENCIES.items() for v in vs) + """) t(dataset, metric))
SELECT DISTINCT r.document_type AS dataset, coalesce(m.metric, 'dashboard') AS metric
FROM (SELECT DISTINCT coalesce(document_type, 'generic') AS document_type FROM routed) r
LEFT JOIN m ON m.dataset = r.document_type""")
def q_affected_metrics(c: Ctx):
    """Metrics to refresh for the uploaded datasets (dependency map; default 'dashboard')."""
    d = routed_uploads(c).select(F.coalesce("document_type", F.lit("generic")).alias("document_type")).distinct()
    return INC.affected_metrics(d)


@query("lineage_backfill", W("v_uploads") + """
, s AS (SELECT * FROM (VALUES (1, 'source', 'Source file registered'), (2, 'raw', 'Immutable source preserved'),
        (3, 'clean', 'Rows cleaned, mapped and versioned'), (4, 'store', 'Business records and detailed context committed'),
        (5, 'serve', 'Metrics and compact context refreshed')) t(stage_order, stage, operation))
SELECT company_id, 'registry_' || upload_id || '_0_' || stage_order AS event_id, 'registry_' || upload_id || '_0' AS run_id,
       upload_id, stage_order, stage, operation, filename AS source_name FROM v_uploads, s""")
def q_lineage_backfill(c: Ctx):
    """Five ordered lineage events for every upload without lineage."""
    return INC.lineage_backfill(c.uploads)


@query("source_delete", W("v_invoices") + """
SELECT id, source_file FROM v_invoices WHERE source_file NOT IN ('supplier_invoices_1995.csv', 'sales_invoices_1995.csv')""")
def q_source_delete(c: Ctx):
    """Invoices remaining after deleting the 1995 source files (anti-join on source_file)."""
    gone = c.spark.createDataFrame([("supplier_invoices_1995.csv",), ("sales_invoices_1995.csv",)], "source_file string")
    return INC.source_delete(c.invoices, gone).select("id", "source_file")


@query("transactions_union", W("v_transactions", "v_bank") + """
SELECT id, transaction_date, round(CAST(amount AS DOUBLE), 2) AS amount, 'transaction' AS source_kind FROM v_transactions
UNION ALL SELECT id, transaction_date, round(CAST(amount AS DOUBLE), 2), 'bank' FROM v_bank""")
def q_transactions_union(c: Ctx):
    """Native transactions and bank rows in one table with their source kind."""
    cols = ["id", "transaction_date", "amount"]
    t = c.transactions.select(*cols).withColumn("source_kind", F.lit("transaction"))
    b = c.bank.select(*cols).withColumn("source_kind", F.lit("bank"))
    return t.unionByName(b).withColumn("amount", out_money("amount"))


@query("token_estimate", "SELECT doc_id, CAST((length(text) + 3) // 4 AS BIGINT) AS tokens FROM documents")
def q_token_estimate(c: Ctx):
    """Token estimate (len + 3) // 4 over whole document texts."""
    return c.t.documents.select("doc_id", token_estimate(F.col("text")).cast("bigint").alias("tokens"))


SESSION_CONVERSATIONS = 20  # a chat session of the adapter: that many consecutive conversations
LATEST = 20  # messages since the session's stored summary


def _compaction_sql(name: str, source: str, threshold: int = 40) -> str:
    return f"""
{name}_n AS (SELECT s, count(*) AS cnt FROM {source} GROUP BY 1),
{name}_r AS (SELECT m.*, row_number() OVER (PARTITION BY s ORDER BY o DESC) AS rd FROM {source} m),
{name}_l AS (SELECT r.* FROM {name}_r r JOIN {name}_n n USING (s) WHERE n.cnt >= {threshold} AND rd <= 30),
{name}_u AS (SELECT s, substr(text, 1, 180) AS t, o, row_number() OVER (PARTITION BY s ORDER BY o DESC) AS k FROM {name}_l WHERE role = 'user'),
{name}_a AS (SELECT s, substr(text, 1, 220) AS t, o, row_number() OVER (PARTITION BY s ORDER BY o DESC) AS k FROM {name}_l WHERE role = 'assistant'),
{name}_us AS (SELECT s, string_agg(t, ' | ' ORDER BY o) AS x FROM {name}_u WHERE k <= 8 GROUP BY 1),
{name}_as AS (SELECT s, string_agg(t, ' | ' ORDER BY o) AS x FROM {name}_a WHERE k <= 6 GROUP BY 1),
{name} AS (
  SELECT n.s, n.cnt, substr('Recent user objectives: ' || coalesce(u.x, '') || chr(10) || 'Recent assistant findings: ' || coalesce(a.x, ''), 1, 5000) AS summary
  FROM {name}_n n LEFT JOIN {name}_us u USING (s) LEFT JOIN {name}_as a USING (s) WHERE n.cnt >= {threshold})"""


@query("memory_compaction", f"""
WITH m AS (SELECT conv_id // {SESSION_CONVERSATIONS} AS s, conv_id * 1000000 + turn AS o, role, text FROM conversations),
old AS (SELECT s, o, role, text FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o DESC) AS back FROM m) WHERE back > {LATEST}),
{_compaction_sql('p', 'old')}, {_compaction_sql('c', 'm')}
SELECT c.s AS session_id, CAST(c.cnt AS BIGINT) AS message_count,
       CASE WHEN p.summary IS NULL THEN c.summary ELSE right(right(p.summary, 2500) || chr(10) || c.summary, 5000) END AS summary
FROM c LEFT JOIN p USING (s)""")
def q_memory_compaction(c: Ctx):
    """Sessions with 40 or more messages: the last 8 user and 6 assistant messages among the last 30,
    after the end of the summary stored before the latest messages."""
    m = c.t.conversations.select(F.expr(f"conv_id div {SESSION_CONVERSATIONS}").alias("session_id"),
                                 (F.col("conv_id") * 1000000 + F.col("turn")).alias("o"), "role", "text")
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("o").desc()))
    stored = memory_compaction(m.withColumn("back", back).filter(F.col("back") > LATEST).drop("back"))
    return memory_compaction(m, stored)


def memory_compaction(messages, previous=None, threshold: int = 40, last: int = 30, users: int = 8, assistants: int = 6,
                      user_chars: int = 180, assistant_chars: int = 220, kept_chars: int = 2500, max_chars: int = 5000):
    """Summary per session_id of messages (session_id, o, role, text). ``previous`` (session_id, summary)
    is carried: its last ``kept_chars`` characters come first, and the whole keeps its last ``max_chars``.
    The windows keep at most ``last`` messages of a session, so each collected list is bounded."""
    n = messages.groupBy("session_id").agg(F.count("*").alias("cnt")).filter(F.col("cnt") >= threshold)
    w = Window.partitionBy("session_id").orderBy(F.col("o").desc())
    recent = (messages.join(n.select("session_id"), "session_id", "left_semi").withColumn("rd", F.row_number().over(w))
              .filter(F.col("rd") <= last))

    def side(role, width, keep):
        r = recent.filter(F.col("role") == role).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= keep)
        return r.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("o", F.substring("text", 1, width).alias("t"))))
                                           .alias("xs")).select("session_id", F.array_join(F.col("xs.t"), " | ").alias(role))

    j = (n.join(side("user", user_chars, users), "session_id", "left")
         .join(side("assistant", assistant_chars, assistants), "session_id", "left"))
    summary = F.substring(F.concat(F.lit("Recent user objectives: "), F.coalesce("user", F.lit("")), F.lit("\n"),
                                   F.lit("Recent assistant findings: "), F.coalesce("assistant", F.lit(""))), 1, max_chars)
    if previous is not None:
        j = j.join(previous.select("session_id", F.col("summary").alias("stored")), "session_id", "left")
        summary = F.when(F.col("stored").isNull(), summary).otherwise(
            F.right(F.concat(F.right("stored", F.lit(kept_chars)), F.lit("\n"), summary), F.lit(max_chars)))
    return j.select("session_id", F.col("cnt").cast("bigint").alias("message_count"), summary.alias("summary"))


@query("text_invoice_extract", W("v_sales_invoices") + """
SELECT id AS doc_id, 'sales_invoices' AS kind, invoice_number, '51824753556' AS supplier_abn, supplier, invoice_date, due_date,
       round(CAST(amount AS DOUBLE), 2) AS amount, round(CAST(round(amount / 11, 2) AS DOUBLE), 2) AS gst_amount,
       round(CAST(amount AS DOUBLE) - round(CAST(amount AS DOUBLE) / 11, 2), 2) AS subtotal,
       substr('Finlake Trading Co · ' || supplier || ' · Goods supplied under order ' || regexp_replace(invoice_number, '^INV-', '')
              || ' (' || description || ')', 1, 500) AS description, 0.92 AS confidence
FROM v_sales_invoices""")
def q_text_invoice_extract(c: Ctx):
    """Round trip: every sales invoice rendered as a document and extracted back (number, ABN,
    Bill-To party, dates, total/GST/subtotal by label, description lines, confidence)."""
    from ..operators.recognition import render_invoice_text, text_invoice_extract

    docs = render_invoice_text(c.sales_invoices)
    out = text_invoice_extract(docs)
    return out.select("doc_id", "kind", "invoice_number", "supplier_abn", "supplier", "invoice_date", "due_date",
                      F.round("amount", 2).alias("amount"), F.round("gst_amount", 2).alias("gst_amount"),
                      F.round("subtotal", 2).alias("subtotal"), "description", "confidence")


BS_CLASS_SQL = """CASE line_item WHEN 'Cash at bank' THEN 'current_asset' WHEN 'Accounts receivable' THEN 'current_asset'
  WHEN 'Inventory' THEN 'current_asset' WHEN 'Plant and equipment' THEN 'non_current_asset'
  WHEN 'Loans payable' THEN 'non_current_liability' ELSE 'current_liability' END"""


@query("balance_sheet_unpivot", W("v_statements") + f"""
SELECT 'balance_sheet_' || company_id || '.xlsx' AS file_id, 'Balance Sheet' AS sheet, period_start, period_end, line_item,
       round(CAST(amount AS DOUBLE), 2) AS amount, 'AUD' AS currency, {BS_CLASS_SQL} AS classification
FROM v_statements WHERE statement_type = 'balance_sheet'""")
def q_balance_sheet_unpivot(c: Ctx):
    """Round trip: balance sheets rendered as a wide workbook sheet (cells) and unpivoted back to
    long statement rows (label column / header row detection, section fill, totals skipped)."""
    from ..operators.recognition import balance_sheet_unpivot
    from ..sources.adapters import balance_sheet_cells

    out = balance_sheet_unpivot(balance_sheet_cells(c.t))
    return out.withColumn("amount", F.round("amount", 2))


@query("sheet_header_detect", W("v_statements") + """
SELECT DISTINCT 'balance_sheet_' || company_id || '.xlsx' AS file_id, 'Balance Sheet' AS sheet, 2 AS header_row
FROM v_statements WHERE statement_type = 'balance_sheet'""")
def q_sheet_header_detect(c: Ctx):
    """Header row of each rendered sheet: first of the first 10 rows with >= 2 non-blank cells."""
    from ..operators.recognition import sheet_header_detect
    from ..sources.adapters import balance_sheet_cells

    return sheet_header_detect(balance_sheet_cells(c.t)).withColumn("header_row", F.col("header_row").cast("int"))


@query("column_name_normalise", W("v_statements") + """
, h AS (SELECT DISTINCT company_id, period_end FROM v_statements WHERE statement_type = 'balance_sheet'),
cols AS (SELECT company_id, 0 AS col, 'line_item' AS name FROM (SELECT DISTINCT company_id FROM h)
         UNION ALL SELECT company_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY period_end) AS INTEGER),
                          strftime(period_end, '%Y_%m_%d') FROM h)
SELECT 'balance_sheet_' || company_id || '.xlsx' AS file_id, 'Balance Sheet' AS sheet, col, name FROM cols""")
def q_column_name_normalise(c: Ctx):
    """Header cells of each rendered sheet -> unique normalised column names."""
    from ..operators.recognition import column_name_normalise, sheet_header_detect
    from ..sources.adapters import balance_sheet_cells

    cells = balance_sheet_cells(c.t)
    hdr = sheet_header_detect(cells)
    header_cells = cells.join(hdr, ["file_id", "sheet"]).filter(F.col("row") == F.col("header_row"))
    return column_name_normalise(header_cells).withColumn("col", F.col("col").cast("int"))


# FIXED VALUES: stored types accepted as compatible with an expected type
COMPATIBLE_TYPES = {
    "balance_sheet": ("balance_sheet", "assets_liabilities", "assets", "liabilities"),
    "supplier_invoices": ("supplier_invoices", "invoices"),
    "sales_invoices": ("sales_invoices", "invoices"),
    "aged_debtors_creditors": ("aged_debtors_creditors",),
}


def classification_repair_plan(c: Ctx) -> "DataFrame":
    """Uploads whose filename route disagrees with the stored type or intake category, or whose
    processing did not complete: action move (category only) or reprocess, with the reason.
    Stored type on the test registry: the filename route for English documents, 'generic' for the
    rest."""
    from pyspark.sql import DataFrame  # noqa: F401

    u = routed_uploads(c).withColumn("stored_type", F.when(F.col("lang") == "en", F.col("document_type")).otherwise("generic"))
    expected = F.col("document_type")
    setup = F.array(*[F.lit(t) for t in R.SETUP_DOCUMENT_TYPES])
    recurring = F.array(*[F.lit(t) for t in R.RECURRING_DOCUMENT_TYPES])
    exp_cat = (F.when(F.array_contains(setup, expected), "setup").when(F.array_contains(recurring, expected), "recurring")
               .otherwise(F.when(F.col("intake_category").isin("setup", "recurring"), F.col("intake_category"))
                          .otherwise("recurring")))
    compat = F.create_map(*[x for k, v in COMPATIBLE_TYPES.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    accepted = F.coalesce(compat[expected], F.array(expected))
    type_mismatch = ~F.array_contains(accepted, F.col("stored_type"))
    cat_mismatch = F.col("intake_category") != exp_cat
    failed = ~F.col("processing_status").isin(*R.COMPLETE_UPLOAD_STATUSES)
    plan = u.filter(expected.isNotNull()).withColumns({"tm": type_mismatch, "cm": cat_mismatch, "fs": failed, "ec": exp_cat})
    plan = plan.filter(F.col("tm") | F.col("cm") | F.col("fs"))
    return plan.select(
        "upload_id", "filename", F.col("stored_type").alias("current_document_type"),
        F.col("document_type").alias("expected_document_type"), F.col("intake_category").alias("current_intake_category"),
        F.col("ec").alias("expected_intake_category"), "processing_status",
        F.when(F.col("cm") & ~F.col("tm") & ~F.col("fs"), "move").otherwise("reprocess").alias("action"),
        F.when(F.col("tm"), "The filename identifies a different document category than the stored classification.")
        .when(F.col("cm"), "The file belongs in the other evidence library.")
        .otherwise("The previous processing attempt did not complete.").alias("reason"))


def _repair_sql() -> str:
    setup = ", ".join(f"'{t}'" for t in R.SETUP_DOCUMENT_TYPES)
    rec = ", ".join(f"'{t}'" for t in R.RECURRING_DOCUMENT_TYPES)
    compat = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(i) for i in v)}]" for k, v in COMPATIBLE_TYPES.items())
    return W("v_uploads") + ROUTED_SQL + f""",
x AS (
  SELECT *, CASE WHEN lang = 'en' THEN document_type ELSE 'generic' END AS stored_type,
         CASE WHEN document_type IN ({setup}) THEN 'setup' WHEN document_type IN ({rec}) THEN 'recurring'
              WHEN intake_category IN ('setup', 'recurring') THEN intake_category ELSE 'recurring' END AS ec
  FROM routed WHERE document_type IS NOT NULL),
y AS (
  SELECT *, NOT list_contains(coalesce(CASE document_type {compat} END, [document_type]), stored_type) AS tm,
         intake_category <> ec AS cm, processing_status NOT IN ('committed', 'stored_source', 'pending_mapping') AS fs FROM x)
SELECT upload_id, filename, stored_type AS current_document_type, document_type AS expected_document_type,
       intake_category AS current_intake_category, ec AS expected_intake_category, processing_status,
       CASE WHEN cm AND NOT tm AND NOT fs THEN 'move' ELSE 'reprocess' END AS action,
       CASE WHEN tm THEN 'The filename identifies a different document category than the stored classification.'
            WHEN cm THEN 'The file belongs in the other evidence library.'
            ELSE 'The previous processing attempt did not complete.' END AS reason
FROM y WHERE tm OR cm OR fs"""


@query("classification_repair_plan", _repair_sql())
def q_classification_repair_plan(c: Ctx):
    """Repair plan for misfiled or incomplete uploads (move vs reprocess, with the reason)."""
    return classification_repair_plan(c)


def source_discovery_counts(c: Ctx) -> "DataFrame":
    """Supported (.csv/.xlsx/.xlsm/.pdf), non-hidden files per intake root, and how many are still
    pending (not completed)."""
    name = F.regexp_extract(F.col("filename"), r"([^/]*)$", 1)
    ok = F.lower(name).rlike(r"\.(csv|xlsx|xlsm|pdf)$") & ~name.rlike(r"^(\.|~\$)")
    return (c.uploads.filter(ok).groupBy("company_id", F.col("intake_category").alias("root"))
            .agg(F.count("*").cast("bigint").alias("files"),
                 F.count(F.when(~F.col("processing_status").isin(*R.COMPLETE_UPLOAD_STATUSES), 1)).cast("bigint").alias("pending")))


@query("source_discovery_counts", W("v_uploads") + """
SELECT company_id, intake_category AS root, CAST(count(*) AS BIGINT) AS files,
       CAST(count(CASE WHEN processing_status NOT IN ('committed', 'stored_source', 'pending_mapping') THEN 1 END) AS BIGINT) AS pending
FROM v_uploads
WHERE regexp_matches(lower(regexp_extract(filename, '([^/]*)$', 1)), '\\.(csv|xlsx|xlsm|pdf)$')
  AND NOT regexp_matches(regexp_extract(filename, '([^/]*)$', 1), '^(\\.|~\\$)')
GROUP BY 1, 2""")
def q_source_discovery_counts(c: Ctx):
    """Discovered source files per intake root and the pending total."""
    return source_discovery_counts(c)


def context_only_gate(c: Ctx) -> "DataFrame":
    """Per intake batch (the uploads of one day): True when every dataset in it is context-only
    (market context, requirements, contracts, use cases, generic), so the financial Gold refresh is
    skipped for that batch."""
    u = routed_uploads(c).withColumn("dataset", F.coalesce("document_type", F.lit("generic")))
    ctx_only = F.col("dataset").isin(*R.CONTEXT_ONLY_DATASETS)
    return u.groupBy("company_id", F.col("created_at").alias("batch_date")).agg(
        F.countDistinct("dataset").cast("bigint").alias("datasets"),
        F.bool_and(ctx_only).alias("context_only"))


@query("context_only_gate", W("v_uploads") + ROUTED_SQL + """
SELECT company_id, created_at AS batch_date, CAST(count(DISTINCT coalesce(document_type, 'generic')) AS BIGINT) AS datasets,
       bool_and(coalesce(document_type, 'generic') IN (""" + ", ".join(f"'{d}'" for d in R.CONTEXT_ONLY_DATASETS) + """)) AS context_only
FROM routed GROUP BY 1, 2""")
def q_context_only_gate(c: Ctx):
    """Whether each day's intake batch holds only context datasets (skip financial refresh)."""
    return context_only_gate(c)


def filename_type_hint(filename: F.Column) -> F.Column:
    """Looser filename hint (coverage intent): first rule whose token occurs in the lower-cased
    name with non-alphanumeric runs turned into '_'; '' when none matches."""
    signal = F.regexp_replace(F.lower(F.coalesce(filename, F.lit(""))), "[^a-z0-9]+", "_")
    return first_keyword_class(signal, R.FILENAME_HINT_RULES, "")


@query("filename_type_hint", W("v_uploads") + """
SELECT upload_id, filename, CASE """ + " ".join(
    "WHEN " + " OR ".join(f"contains(sig, '{t}')" for t in toks) + f" THEN '{ty}'" for ty, toks in R.FILENAME_HINT_RULES)
    + """ ELSE '' END AS document_type_hint
FROM (SELECT *, regexp_replace(lower(coalesce(filename, '')), '[^a-z0-9]+', '_', 'g') AS sig FROM v_uploads)""")
def q_filename_type_hint(c: Ctx):
    """Coverage-intent document type hint from each uploaded file name."""
    return c.uploads.select("upload_id", "filename", filename_type_hint(F.col("filename")).alias("document_type_hint"))


def upload_lifecycle(c: Ctx) -> "DataFrame":
    """Lifecycle label per upload: category_corrected (duplicate moved to the other library),
    duplicate_ignored, awaiting_mapping, else initial_setup when no completed upload precedes it
    (order: created date, upload number) or incremental_update. "Precedes a completed upload" is a
    comparison with the company's first completed upload (one aggregate), not a running window."""
    num = F.regexp_replace("upload_id", "[^0-9]", "").cast("bigint")
    u = c.uploads.withColumn("o", F.struct(F.col("created_at"), num.alias("n")))
    first_done = (u.filter(F.col("processing_status").isin(*R.COMPLETE_UPLOAD_STATUSES))
                  .groupBy("company_id").agg(F.min("o").alias("fd")))
    d = INC.file_dedupe_decision(c.uploads).select("upload_id", "decision")
    j = u.join(d, "upload_id").join(first_done, "company_id", "left")
    initial = F.col("fd").isNull() | (F.col("o") <= F.col("fd"))
    life = (F.when(F.col("decision") == "moved", "category_corrected")
            .when(F.col("decision") == "duplicate", "duplicate_ignored")
            .when(F.col("processing_status") == "pending_mapping", "awaiting_mapping")
            .when(initial, "initial_setup").otherwise("incremental_update"))
    return j.select("upload_id", "decision", life.alias("lifecycle"))


@query("upload_lifecycle", W("v_uploads") + """
, f AS (SELECT company_id, sha256, arg_min(upload_id, upload_id) AS fid, arg_min(processing_status, upload_id) AS fst,
               arg_min(intake_category, upload_id) AS fcat FROM v_uploads GROUP BY 1, 2),
d AS (SELECT u.*, CASE WHEN u.upload_id = f.fid THEN 'new'
                       WHEN f.fst NOT IN ('committed', 'stored_source', 'pending_mapping') AND f.fst <> 'processing' THEN 'reprocess'
                       WHEN u.intake_category <> f.fcat THEN 'moved' ELSE 'duplicate' END AS decision,
             CAST(regexp_replace(u.upload_id, '[^0-9]', '', 'g') AS BIGINT) AS n
      FROM v_uploads u JOIN f ON f.company_id = u.company_id AND f.sha256 = u.sha256),
fd AS (SELECT company_id, min((created_at, n)) AS fd FROM d WHERE processing_status IN ('committed', 'stored_source', 'pending_mapping') GROUP BY 1)
SELECT upload_id, decision, CASE WHEN decision = 'moved' THEN 'category_corrected'
         WHEN decision = 'duplicate' THEN 'duplicate_ignored'
         WHEN processing_status = 'pending_mapping' THEN 'awaiting_mapping'
         WHEN fd.fd IS NULL OR (created_at, n) <= fd.fd THEN 'initial_setup' ELSE 'incremental_update' END AS lifecycle
FROM d LEFT JOIN fd USING (company_id)""")
def q_upload_lifecycle(c: Ctx):
    """Lifecycle label of every upload (duplicate / moved / awaiting mapping / initial / incremental)."""
    return upload_lifecycle(c)


@query("schema_signature", W("v_statements") + """
, h AS (SELECT DISTINCT company_id, period_end FROM v_statements WHERE statement_type = 'balance_sheet'),
cols AS (SELECT company_id, 'line_item' AS name FROM (SELECT DISTINCT company_id FROM h)
         UNION ALL SELECT company_id, strftime(period_end, '%Y_%m_%d') FROM h)
SELECT 'balance_sheet_' || company_id || '.xlsx' AS file_id, 'Balance Sheet' AS sheet,
       sha256(string_agg(name, '|' ORDER BY name)) AS schema_signature, CAST(count(*) AS BIGINT) AS columns
FROM cols GROUP BY company_id""")
def q_schema_signature(c: Ctx):
    """Schema signature of each rendered sheet: sha256 of its sorted normalised column names (the
    key for reusing an approved column mapping)."""
    from ..functions.expr import schema_signature
    from ..operators.recognition import column_name_normalise, sheet_header_detect
    from ..sources.adapters import balance_sheet_cells

    cells = balance_sheet_cells(c.t)
    hdr = sheet_header_detect(cells)
    names = column_name_normalise(cells.join(hdr, ["file_id", "sheet"]).filter(F.col("row") == F.col("header_row")))
    return names.groupBy("file_id", "sheet").agg(schema_signature(F.collect_list("name")).alias("schema_signature"),
                                                 F.count("*").cast("bigint").alias("columns"))
