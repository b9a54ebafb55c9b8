"""Detection, stored mappings, streaming upserts, learned rules, lineage and budget packing over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import Ctx
from ..functions import rules as R

from ..operators import budget as B
from ..operators import detection as D
from ..operators import learning as LR
from ..operators import lineage as LN
from ..operators import targets as T
from ..operators.mapping import REQUIRED
from ..oracle.views import with_views as W
from ..registry import query
from ..sources.sheets import sheet
from ..streaming import streams as S
from .queries_store import new_store, newest, SHOWN

# -- manifest: one sheet for each customer, its header drawn from a pool of dirty names --------------

POOL = ("Customer ID", "Client Name", "Country ", "Segment", "Invoice No.", "Total (AUD)", "Due Date", "GST", "Vendor", "SKU", "Qty", "Unit Cost",
        "Narration", "Withdrawal", "Deposit", "Balance", "Employee", "Gross Pay", "PAYG", "Topic", "Relevance Score", "Estimated Impact", "Budget", "Notes")
NAMES = ("export", "bank_statement_export", "clients", "ledger dump", "sheet1", "payroll_report", "bills", "items", "report", "data", "upload", "misc")


def _manifest_sql(upload: int, table: str) -> str:
    """``header`` is the raw header, joined by bars: customers share schemas, uploads differ a little."""
    key = f"((c_custkey + {upload} * (c_custkey % 2)) % 40)"
    chosen = " || ".join(f"CASE WHEN ({key} * {i + 3} + {i * i}) % 7 < 2 THEN '{n}|' ELSE '' END" for i, n in enumerate(POOL))
    name = "CASE c_custkey % " + str(len(NAMES)) + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
    return (f"SELECT 'co-' || CAST(c_nationkey % 5 AS STRING) AS company_id, c_custkey AS file_id, {name} || '.csv' AS filename, 'Sheet1' AS sheet, "
            f"{chosen} || 'Ref' AS header, CASE WHEN c_custkey % 23 = 4 THEN 'customers' ELSE 'auto' END AS declared_type FROM {table}")


def manifest(c: Ctx, upload: int) -> DataFrame:
    rows = c.spark.sql(_manifest_sql(upload, "{customer}"), customer=c.t.customer)
    return rows.withColumn("columns", D.normalised_header(F.split("header", r"\|"))).drop("header")


def _as_text(mapping):
    return F.concat_ws(",", F.transform(F.array_sort(F.map_entries(mapping)), lambda e: F.concat_ws("=", e["key"], e["value"])))


# the same for DuckDB, from the same fixed values

def _sql_find(names) -> str:
    listed = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    within = " OR ".join(f"contains(c, '{n}')" for n in names)
    return f"coalesce(list_filter({listed}, lambda n: list_contains(columns, n))[1], list_filter(columns, lambda c: {within})[1])"


def _sql_map(t: str) -> str:
    """List of field=column texts in order of the fields."""
    names = D.names_of(t)
    if not names:
        return "[]::VARCHAR[]"
    return "list_filter([" + ", ".join(f"'{f}=' || {_sql_find(n)}" for f, n in sorted(names.items())) + "], lambda e: e IS NOT NULL)"


def _sql_has(t: str, fields) -> str:
    return "(" + (" AND ".join(f"len(list_filter({_col(t)}, lambda e: starts_with(e, '{f}='))) > 0" for f in fields) or "true") + ")"


def _col(t: str) -> str:
    return f"m_{t}"


def _words(words) -> str:
    return "(" + " OR ".join(f"contains(joined, '{w}')" for w in words) + ")"


def _detect_sql(source: str) -> str:
    types = list(dict.fromkeys([*D.HINTS, "invoices", "sales_invoices", "supplier_invoices", "assets_liabilities"]))
    norm = lambda x: f"coalesce(nullif(trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'column')"
    token = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"
    named = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(stem, '{R.route_token_py(w)}')" for w in ws) + f" THEN '{t}'" for t, ws in R.FILENAME_RULES) + " END"
    scores = []
    for t, ws in D.HINTS.items():
        tokens = " + ".join(f"CAST(contains(joined, '{w}') AS INTEGER)" for w in ws)
        need = " + ".join(f"CAST({_sql_has(t, [f])} AS INTEGER)" for f in REQUIRED.get(t, ())) or "0"
        scores.append((t, f"1.5::DOUBLE * ({tokens}) + 2.0::DOUBLE * ({need}) + 0.15::DOUBLE * len({_col(t)})", _sql_has(t, REQUIRED.get(t, ()))))
    scores.append(("invoices", f"CASE WHEN contains(joined, 'invoice') OR list_contains(columns, 'due_date') THEN 4 + len({_col('invoices')}) * 0.2::DOUBLE ELSE -1 END", _sql_has("invoices", REQUIRED["invoices"])))
    scores.append(("assets_liabilities", f"CASE WHEN contains(joined, 'asset') AND contains(joined, 'liabil') THEN 6 + len({_col('assets_liabilities')}) * 0.2::DOUBLE ELSE -1 END", "false"))
    listed = "[" + ", ".join(f"{{'score': CAST({s} AS DOUBLE), 'place': {-i}, 'type': '{t}', 'ok': {ok}}}" for i, (t, s, ok) in enumerate(scores)) + "]"
    in_all = lambda *n: "(" + " AND ".join(f"list_contains(columns, '{x}')" for x in n) + ")"
    pay = lambda f: _sql_has("payroll", [f])
    inv = lambda f: _sql_has("invoices", [f])
    rich = lambda t: " + ".join(f"CAST({_sql_has(t, [f])} AS INTEGER)" for f in D.RICH_FIELDS)
    pick = "CASE kind " + " ".join(f"WHEN '{t}' THEN {_col(t)}" for t in ("sales_invoices", "supplier_invoices", "invoices")) + " END"
    by_type = lambda x: f"CASE {x} " + " ".join(f"WHEN '{t}' THEN {_col(t)}" for t in types) + " ELSE [] END"
    richness = "CASE kind " + " ".join(f"WHEN '{t}' THEN {rich(t)}" for t in ("sales_invoices", "supplier_invoices", "invoices")) + " END"
    percent = lambda x: f"floor(({x}) * 100 + 0.5::DOUBLE) / 100"
    return f"""
raw AS (SELECT *, list_transform(string_split(header, '|'), lambda x: {norm('x')}) AS columns, {token("regexp_replace(filename, '[.][^.]*$', '')")} AS stem FROM ({source})),
n AS (SELECT *, array_to_string(columns, ' ') || ' ' || {norm('filename')} || ' ' || {norm('sheet')} AS joined FROM raw),
m AS (SELECT *, {", ".join(f"{_sql_map(t)} AS {_col(t)}" for t in types)} FROM n),
k AS (SELECT *, {named} AS named, CASE WHEN {_words(D.SALES_WORDS)} AND NOT {_words(D.SUPPLIER_WORDS)} THEN 'sales_invoices'
        WHEN {_words(D.SUPPLIER_WORDS)} AND NOT {_words(D.SALES_WORDS)} THEN 'supplier_invoices' ELSE 'invoices' END AS kind, list_max({listed}) AS best FROM m),
r AS (SELECT *, CASE WHEN named IS NOT NULL THEN 'named'
        WHEN contains(joined, 'bank_statement') OR {in_all('debit', 'credit', 'balance')} OR {in_all('withdrawal', 'deposit', 'balance')} THEN 'bank'
        WHEN contains(joined, 'market_context') OR {in_all('topic', 'relevance_score', 'estimated_impact')} THEN 'market'
        WHEN {pay('gross_pay')} AND ({pay('employee')} OR {pay('pay_period')}) AND ({pay('payg_withholding')} OR {pay('superannuation')} OR {pay('net_pay')}) THEN 'payroll'
        WHEN {inv('invoice_number')} AND {inv('amount')} AND ({inv('supplier')} OR {inv('invoice_date')} OR {inv('due_date')} OR {_words(D.INVOICE_WORDS)}) THEN 'invoice'
        WHEN best.score < 2.2 THEN 'generic' ELSE 'best' END AS rule FROM k),
found AS (SELECT *,
  CASE rule WHEN 'named' THEN named WHEN 'bank' THEN 'bank_statements' WHEN 'market' THEN 'market_context' WHEN 'payroll' THEN 'payroll' WHEN 'invoice' THEN kind
            WHEN 'generic' THEN 'generic' ELSE best.type END AS t,
  CASE rule WHEN 'named' THEN 0.99::DOUBLE WHEN 'bank' THEN 0.96::DOUBLE WHEN 'market' THEN 0.96::DOUBLE WHEN 'payroll' THEN 0.96::DOUBLE
            WHEN 'invoice' THEN {percent(f"least(0.99::DOUBLE, 0.93::DOUBLE + ({richness}) * 0.008::DOUBLE)")} WHEN 'generic' THEN 0.2::DOUBLE
            ELSE {percent("CASE WHEN best.ok THEN least(0.99::DOUBLE, 0.35::DOUBLE + best.score / 12) ELSE least(0.69::DOUBLE, best.score / 12) END")} END AS confidence,
  CASE rule WHEN 'named' THEN {by_type('named')} WHEN 'bank' THEN {_col('bank_statements')} WHEN 'market' THEN {_col('market_context')} WHEN 'payroll' THEN {_col('payroll')}
            WHEN 'invoice' THEN {pick} WHEN 'generic' THEN [] ELSE {by_type('best.type')} END AS mapped FROM r),
declared AS (SELECT company_id, file_id, columns, declared_type <> 'auto' AND declared_type <> t AS other,
  CASE WHEN declared_type <> 'auto' THEN declared_type ELSE t END AS document_type, CASE WHEN declared_type <> 'auto' AND declared_type <> t THEN greatest(confidence, 0.99::DOUBLE) ELSE confidence END AS confidence,
  CASE WHEN declared_type <> 'auto' AND declared_type <> t AND len({_col('customers')}) > 0 THEN {_col('customers')} ELSE mapped END AS mapped FROM found)"""


@query("document_type_detect", "WITH " + _detect_sql(_manifest_sql(1, "customer")) + """
SELECT company_id, file_id, t AS document_type, confidence, array_to_string(mapped, ',') AS mapping FROM found""")
def q_detect(c: Ctx):
    """Type, confidence and field mapping of every uploaded sheet, from file name and header."""
    return D.detect(manifest(c, 1)).select("company_id", "file_id", "document_type", "confidence", _as_text(F.col("mapping")).alias("mapping"))


@query("declared_type_override", "WITH " + _detect_sql(_manifest_sql(1, "customer")) + """
SELECT company_id, file_id, document_type, confidence, array_to_string(mapped, ',') AS mapping FROM declared""")
def q_declared(c: Ctx):
    """The same where the uploader declared a type."""
    found = D.declared(D.detect(manifest(c, 1)))
    return found.select("company_id", "file_id", "document_type", "confidence", _as_text(F.col("mapping")).alias("mapping"))


def _profile_sql() -> str:
    parts = []
    for b in (1, 2):
        rows = f"(WITH {_detect_sql(_manifest_sql(b, 'customer'))} SELECT *, array_to_string(list_sort(columns), '|') AS signature FROM declared)"
        need = " AND ".join(f"(document_type <> '{t}' OR len(list_filter(mapped, lambda e: {' OR '.join(f'starts_with(e, {chr(39)}{x}={chr(39)})' for x in fs)})) = {len(fs)})" for t, fs in REQUIRED.items())
        parts.append(f"SELECT {b} AS b, company_id, document_type, signature, confidence FROM {rows} WHERE document_type <> 'generic' AND {need}")
    return f"""WITH d AS ({" UNION ALL ".join(parts)}),
first AS (SELECT company_id, document_type, signature, min(b) AS b FROM d WHERE confidence >= 0.82::DOUBLE GROUP BY ALL)
SELECT d.company_id, d.document_type, sha256(d.signature) AS signature, count(*) AS use_count
FROM d JOIN first f ON f.company_id = d.company_id AND f.document_type = d.document_type AND f.signature = d.signature
WHERE d.b > f.b OR (d.b = f.b AND d.confidence >= 0.82::DOUBLE) GROUP BY ALL"""


@query("mapping_profile_upsert", _profile_sql())
def q_profiles(c: Ctx):
    """Stored mappings after two uploads and a replay of the second, with how often each was used."""
    store = new_store(c, "profiles")
    for upload in (1, 2, 2):
        D.use_profiles(store, f"upload-{upload}", D.declared(D.detect(manifest(c, upload))))
    return D.profiles(store).select(*D.PROFILE_KEYS, "use_count")


# -- streams ---------------------------------------------------------------------------------------

@query("stream_incremental_upsert", newest("customers", SHOWN["customers"]["customers"]))
def q_stream_upsert(c: Ctx):
    """Customers after two uploads came in as a stream of files, which was then started again from nothing."""
    store = new_store(c, "stream")
    landing = f"{store.root}/landing"
    for upload in (1, 2):
        rows = sheet(c.t, "customers", upload).withColumn("upload", F.lit(upload))
        rows.coalesce(1).write.parquet(f"{landing}/{upload}")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    for run in (1, 2):
        S.upsert_stream(c.spark, landing, kind, store, "customers", "customers", f"{store.root}/checkpoint-{run}", c.as_of).awaitTermination()
    return store.read("customers").drop("record_id")


@query("stream_monthly_flow", """SELECT 'co-' || CAST(user_id % 5 AS STRING) AS company_id, strftime(ts, '%Y-%m') AS month,
round(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) / 100, 2)::DOUBLE AS inflow,
round(sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END) / 100, 2)::DOUBLE AS outflow FROM events GROUP BY 1, 2""")
def q_stream_monthly(c: Ctx):
    """Inflow and outflow by company and month from the event stream, with late rows brought in at the end."""
    store = new_store(c, "flow")
    S.daily_flow_stream(c.spark, c.sf_dir, c.t.events.schema, store, f"{store.root}/checkpoint", "events.parquet").awaitTermination()
    S.reconcile_flow(store, c.t.events, "reconcile-1")
    return S.monthly(store.read(S.FLOW_DAYS))


# -- learned rules ---------------------------------------------------------------------------------

ACCOUNTS = ("6100", "1500", "6200")


def approvals(c: Ctx) -> DataFrame:
    """For every supplier with an invoice that no rule matched, a person approves the first of them."""
    inv = c.invoices.filter("invoice_kind = 'supplier' and c_status = 'needs_review'")
    first = inv.groupBy("company_id", "supplier").agg(F.min("id").alias("invoice_id"))
    n = F.pmod(F.regexp_extract("supplier", r"(\d+)$", 1).cast("bigint"), F.lit(len(ACCOUNTS)))
    return first.select("company_id", "invoice_id", "supplier", F.get(F.array(*[F.lit(a) for a in ACCOUNTS]), n.cast("int")).alias("account_code"),
                        F.lit("GST").alias("tax_code"), F.lit(1).alias("approved_at"))


@query("rule_learning", W("o_classified") + f"""
, a AS (SELECT company_id, supplier, min(id) AS invoice_id, ['{"', '".join(ACCOUNTS)}'][(CAST(regexp_extract(supplier, '(\\d+)$', 1) AS BIGINT) % 3) + 1] AS code
  FROM o_classified WHERE invoice_kind = 'supplier' AND c_status = 'needs_review' GROUP BY company_id, supplier)
SELECT o.company_id, o.id, a.code AS c_account_code, 'GST' AS c_tax_code,
  CASE WHEN o.id = a.invoice_id THEN 1.0 WHEN abs(o.amount) >= 1000 AND a.code = '1500' THEN 0.9 ELSE {R.rule_confidence(LR.LEARNED_PRIORITY)} END::DOUBLE AS c_confidence,
  CASE WHEN o.id = a.invoice_id THEN 'approved' WHEN abs(o.amount) >= 1000 AND a.code = '1500' THEN 'suggested' ELSE 'auto_approved' END AS c_status
FROM o_classified o JOIN a ON a.company_id = o.company_id AND a.supplier = o.supplier WHERE o.invoice_kind = 'supplier'""")
def q_rule_learning(c: Ctx):
    """Invoices that one approval for each unmatched supplier decides anew."""
    done = approvals(c)
    again = LR.affected(c.invoices, LR.learned_rules(done), done)
    return again.select("company_id", "id", "c_account_code", "c_tax_code", "c_confidence", "c_status")


# -- lineage ---------------------------------------------------------------------------------------

def sources(c: Ctx) -> DataFrame:
    """Uploaded files as source nodes, their type by file name, companies by source."""
    from .queries_intake import filename_route

    company = F.concat(F.lit("co-"), F.pmod(F.regexp_extract("source", r"(\d+)$", 1).cast("bigint"), F.lit(5)).cast("string"))
    return c.uploads.select(F.coalesce(company, F.lit("co-none")).alias("company_id"), F.concat(F.lit("upload:"), F.col("upload_id")).alias("node_id"),
                            F.coalesce(filename_route(F.col("filename")), F.lit("generic")).alias("document_type"), (F.col("processing_status") != "failed").alias("enabled"))


_SOURCES_SQL = W("v_uploads") + """, s AS (SELECT coalesce('co-' || CAST(CAST(nullif(regexp_extract(source, '(\\d+)$', 1), '') AS BIGINT) % 5 AS STRING), 'co-none') AS company_id,
  'upload:' || upload_id AS node_id, processing_status <> 'failed' AS enabled, CASE """ + " ".join(
    "WHEN " + " OR ".join(f"contains(stem, '{R.route_token_py(w)}')" for w in ws) + f" THEN '{t}'" for t, ws in R.FILENAME_RULES) + """ ELSE 'generic' END AS document_type
  FROM (SELECT *, trim(regexp_replace(lower(regexp_replace(filename, '[.][^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '_') AS stem FROM v_uploads)),
tp(document_type, process) AS (VALUES """ + ", ".join(f"('{t}', '{p}')" for t, ps in LN.TYPE_PROCESSES.items() for p in ps) + """),
ps(process, section) AS (VALUES """ + ", ".join(f"('{p}', '{x}')" for p, xs in LN.PROCESS_SECTIONS.items() for x in xs) + """),
ap(agent, process) AS (VALUES """ + ", ".join(f"('{a}', '{p}')" for a, ps in LN.AGENT_PROCESSES.items() for p in ps) + ")"
LENS = "tax"


@query("lineage_edges", _SOURCES_SQL + f"""
, shown AS (SELECT process, max(CAST(section = '{LENS}' AS INTEGER)) = 1 AS shown FROM ps GROUP BY process),
e AS (SELECT company_id, 'extract' AS edge_type, node_id AS source, 'process:' || process AS target, enabled, enabled AND shown AS active FROM s JOIN tp USING (document_type) JOIN shown USING (process)
 UNION ALL SELECT company_id, 'agent_input', 'process:' || process, 'agent:' || agent, true, shown FROM (SELECT DISTINCT company_id, process FROM s JOIN tp USING (document_type)) JOIN ap USING (process) JOIN shown USING (process)
 UNION ALL SELECT company_id, kind, replace(a, '?', agent), replace(b, '?', agent), true, true
   FROM (SELECT DISTINCT company_id, agent FROM s JOIN tp USING (document_type) JOIN ap USING (process)),
        (VALUES ('publish_dashboard', 'agent:?', 'dashboard:?'), ('agent_decision', 'agent:?', 'supervisor:ledger'), ('dashboard_evidence', 'dashboard:?', 'supervisor:ledger')) t(kind, a, b))
SELECT company_id, 'edge:' || source || ':' || target AS id, edge_type, source, target, enabled, active FROM e""")
def q_lineage_edges(c: Ctx):
    """All edges of every company's lineage graph, active under the tax lens."""
    return LN.lineage_edges(sources(c), LENS)


@query("lineage_board", _SOURCES_SQL + """
, co AS (SELECT DISTINCT company_id, agent FROM s, (SELECT DISTINCT agent FROM ap))
SELECT co.company_id, co.agent, count(DISTINCT CASE WHEN s.enabled THEN s.node_id END) AS source_count, count(DISTINCT ap.process) AS process_count
FROM co LEFT JOIN (s JOIN tp ON tp.document_type = s.document_type) ON s.company_id = co.company_id AND (co.agent, tp.process) IN (SELECT agent, process FROM ap)
LEFT JOIN ap ON ap.agent = co.agent AND ap.process = tp.process GROUP BY 1, 2""")
def q_lineage_board(c: Ctx):
    """Department agents of every company with the sources and processes that reach them."""
    return LN.lineage_board(sources(c))


# -- budget packing --------------------------------------------------------------------------------

def _budget_sql(groups: str, source: str, budget: int) -> str:
    return f"""WITH RECURSIVE s AS (SELECT {groups} AS grp, o, name, length(name) + 3 + length(value) AS cost FROM ({source})),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY o, name) AS i FROM s),
r AS (SELECT grp, 0::BIGINT AS i, 2::BIGINT AS used, false AS taken, NULL::BIGINT AS o, NULL::VARCHAR AS name FROM (SELECT DISTINCT grp FROM n)
  UNION ALL SELECT r.grp, n.i, CASE WHEN f THEN r.used + n.cost + c ELSE r.used END, f, n.o, n.name
  FROM r JOIN n ON n.grp = r.grp AND n.i = r.i + 1, LATERAL (SELECT CASE WHEN r.used > 2 THEN 1 ELSE 0 END AS c), LATERAL (SELECT r.used + n.cost + c <= {budget} AS f))
SELECT grp, o AS place, name, used FROM r WHERE taken"""


_TURNS = """SELECT conv_id, -turn AS o, 'turn_' || CAST(turn AS STRING) AS name, '"' || replace(replace(replace(replace(coalesce(text, ''), '\\', ''), '"', ''), chr(10), ' '), chr(13), ' ') || '"' AS value FROM """


@query("budget_pack", _budget_sql("conv_id", _TURNS + "conversations", 600))
def q_budget(c: Ctx):
    """The turns of every conversation, newest first, that fit 600 characters of context."""
    text = F.translate(F.translate(F.coalesce("text", F.lit("")), '\\"', ""), "\n\r", "  ")
    rows = c.t.conversations.select("conv_id", (-F.col("turn")).alias("place"), F.concat(F.lit("turn_"), F.col("turn").cast("string")).alias("name"),
                                    F.concat(F.lit('"'), text, F.lit('"')).alias("value"))
    return B.budget_pack(rows, ["conv_id"], "place", "name", "value", 600).withColumnRenamed("conv_id", "grp").withColumn("used", F.col("used").cast("long"))


@query("budget_pack_sources", _budget_sql("coalesce(source, '')", "SELECT source, doc_id AS o, 'doc_' || CAST(doc_id AS STRING) AS name, CAST(n_chars AS STRING) AS value FROM documents", 400))
def q_budget_sources(c: Ctx):
    """Which documents' sizes fit an index of 400 characters for each source, however large the source."""
    rows = c.t.documents.select(F.coalesce("source", F.lit("")).alias("grp"), F.col("doc_id").alias("place"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
                                F.col("n_chars").cast("string").alias("value"))
    return B.budget_pack(rows, ["grp"], "place", "name", "value", 400).withColumn("used", F.col("used").cast("long"))
