"""The commit path of uploads: two uploads of every sheet are versioned and merged into the operational
tables, once for all queries of a workspace."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..context import Ctx
from ..operators import targets as T
from ..operators.store import Store
from ..registry import query
from ..session import checkpoint_dir
from ..sources.sheets import SHEETS, sheet, sheet_sql, sheet_table

UPLOADS = (1, 2)


def new_store(c: Ctx, kind: str) -> Store:
    return Store(c.spark, f"{checkpoint_dir(c.spark).rstrip('/')}/finlake-store/{kind}-{uuid.uuid4().hex}", parts=8)


def upload(c: Ctx, number: int, names=tuple(SHEETS)) -> list[T.Sheet]:
    return [T.Sheet(SHEETS[n][0], sheet(c.t, n, number), f"{n}_{number}.csv", most=sheet_rows(c, n)) for n in names]


def sheet_rows(c: Ctx, name: str) -> int:
    """The rows of a sheet's table, which the sheet has at most: the files know their number."""
    table = sheet_table(name)
    known = c.__dict__.setdefault("table_rows", {})
    if table not in known:
        known[table] = getattr(c.t, table).count()
    return known[table]


def loaded(c: Ctx) -> Store:
    """Both uploads, and the second one again."""
    if "upload_store" not in c.__dict__:
        store = new_store(c, "uploads")
        for number in (*UPLOADS, UPLOADS[-1]):
            T.import_batch(store, f"upload-{number}", upload(c, number), c.as_of)
        c.__dict__["upload_store"] = store
    return c.__dict__["upload_store"]


# -- the oracle: every delivered row in order, its key and what its table shows of it -------------

def _num(column: str) -> str:
    clean = f"TRY_CAST(regexp_replace(trim({column}), '[^0-9.\\-]', '', 'g') AS DOUBLE)"
    return f"coalesce(CASE WHEN trim({column}) LIKE '(%)' THEN -abs({clean}) ELSE {clean} END, 0.0::DOUBLE)"


def _date(column: str) -> str:
    return f"coalesce(TRY_CAST(substr(trim({column}), 1, 10) AS DATE), DATE '{P.AS_OF}')"


def _fixed2(column: str) -> str:
    return f"printf('%.2f', {_num(column)})"


#: sheet -> SQL of its business key (null: the row's digest)
KEYS = {
    "customers": "lower(trim(customer_id))", "suppliers": "lower(trim(vendor_id))", "inventory": "lower(trim(sku))",
    "sales_invoices": "lower(invoice_number) || '|' || lower(customer)", "supplier_invoices": "coalesce(lower(bill_no), '') || '|' || lower(vendor)",
    "transactions": f"transaction_date || '|' || lower(description) || '|' || {_fixed2('amount')}", "bank_statements": "posted_date || '|' || lower(narration) || '|0.00'",
    "payments": f"payment_date || '|' || lower(reference) || '|' || lower(counterparty) || '|' || {_fixed2('amount')}",
    "assets": "lower(name)", "liabilities": "lower(name)", "budgets": "lower(period) || '|' || lower(account) || '|' || lower(category)",
    "payroll": "pay_period || '|' || lower(employee)", "profit_loss": "period_end || '|' || lower(line_item)",
    "market_context": "published_at || '|' || lower(topic) || '|' || lower(entity) || '|'", "web_pages": "row_number::VARCHAR || url || visits",
}
#: sheet -> required column that may be blank in it
REQUIRED = {"customers": "customer_name", "supplier_invoices": "bill_no"}
#: sheet -> table -> columns
_TERM = "CASE WHEN lower({c}) LIKE '%non%' OR lower({c}) LIKE '%long%' THEN 'non-current' ELSE 'current' END"
_INVOICE = ("{number} AS invoice_number, {party} AS supplier, {date} AS invoice_date, DATE '" + P.AS_OF + "' AS due_date, {amount} AS amount, lower({status}) AS status, "
            "'{kind}' AS invoice_kind, 'AUD' AS currency, 0.0::DOUBLE AS subtotal, 0.0::DOUBLE AS gst_amount, '' AS description, 'REVIEW' AS tax_code, "
            "'needs_review' AS validation_status, {quantity} AS quantity")
SHOWN: dict[str, dict[str, str]] = {
    "customers": {"customers": "customer_id AS code, customer_name AS name, country, segment, 'active' AS status"},
    "suppliers": {"suppliers": "vendor_id AS code, vendor_name AS name, country, supplier_category AS category, '' AS currency, 'active' AS status"},
    "inventory": {"inventory": f"sku, product_name AS name, {_num('quantity')} AS quantity, {_num('unit_cost')} AS unit_cost, "
                               f"{_num('quantity')} * {_num('unit_cost')} AS total_value, warehouse AS location, 'active' AS status"},
    "sales_invoices": {"invoices": _INVOICE.format(number="invoice_number", party="customer", date=_date("invoice_date"), amount=_num("total"), status="payment_status", kind="sales", quantity="0.0::DOUBLE")},
    "supplier_invoices": {"invoices": _INVOICE.format(number="bill_no", party="vendor", date=_date("bill_date"), amount=_num("invoice_total"), status="status", kind="supplier", quantity=_num("qty"))},
    "transactions": {"transactions": f"{_date('transaction_date')} AS transaction_date, description, category, {_num('amount')} AS amount, 'imported' AS status"},
    "bank_statements": {
        "bank_transactions": f"{_date('posted_date')} AS transaction_date, narration AS description, 'Bank account' AS account_name, "
                             f"{_num('deposit')} - {_num('withdrawal')} AS amount, 0.0::DOUBLE AS balance, '' AS currency",
        "transactions": f"{_date('posted_date')} AS transaction_date, narration AS description, 'bank transaction' AS category, {_num('deposit')} - {_num('withdrawal')} AS amount, 'imported' AS status"},
    "payments": {
        "payments": f"{_date('payment_date')} AS payment_date, reference, counterparty, {_num('amount')} AS amount, currency, status",
        "transactions": f"{_date('payment_date')} AS transaction_date, counterparty || ' ' || reference AS description, 'payment' AS category, -abs({_num('amount')}) AS amount, 'imported' AS status"},
    "assets": {"assets_liabilities": f"name, 'asset' AS category, {_TERM.format(c='classification')} AS classification, {_num('amount')} AS amount, 'imported' AS status"},
    "liabilities": {"assets_liabilities": f"name, 'liability' AS category, {_TERM.format(c='classification')} AS classification, {_num('amount')} AS amount, 'imported' AS status"},
    "budgets": {"budgets": f"period, account, category, {_num('budget_amount')} AS budget_amount, {_num('actual_amount')} AS actual_amount, {_num('actual_amount')} - {_num('budget_amount')} AS variance"},
    "payroll": {"payroll_records": f"pay_period, employee, {_num('gross_pay')} AS gross_pay, CASE WHEN {_num('ordinary_time_earnings')} <> 0 THEN {_num('ordinary_time_earnings')} "
                                   f"ELSE {_num('gross_pay')} END AS ordinary_time_earnings, {_num('payg_withholding')} AS payg_withholding, 0.0::DOUBLE AS superannuation, "
                                   "0.0::DOUBLE AS net_pay, 'AUD' AS currency, 'imported' AS status"},
    "profit_loss": {"statement_snapshots": f"'profit_loss' AS statement_type, {_date('period_start')} AS period_start, {_date('period_end')} AS period_end, line_item, {_num('amount')} AS amount, currency"},
    "market_context": {"market_signals": f"signal_type, topic, entity, '' AS geography, DATE '{P.AS_OF}' AS observed_at, published_at, {_num('value')} AS value, '' AS unit, '' AS direction, "
                                         f"'' AS source_name, CASE WHEN {_num('relevance_score')} > 1 THEN {_num('relevance_score')} / 100 ELSE {_num('relevance_score')} END AS relevance_score, '' AS estimated_impact"},
    "web_pages": {"generic_documents": "'web_pages' AS document_type, url AS title, '{\"url\":\"' || url || '\",\"visits\":\"' || visits || '\"}' AS content, row_number"},
}


def delivered(name: str) -> str:
    """All accepted rows of both uploads: company_id, upload (b), row_number, key and the sheet's columns."""
    rule = f"trim(coalesce({REQUIRED[name]}, '')) <> ''" if name in REQUIRED else "true"
    return " UNION ALL ".join(f"SELECT {b} AS b, *, {KEYS[name]} AS k FROM ({sheet_sql(name, b)}) WHERE {rule}" for b in UPLOADS)


def newest(name: str, columns: str) -> str:
    """The last delivered row of each key that changed it, as its table shows it: rows equal to the one
    before bring nothing, so the source file is that of the last change."""
    head = "md5(row_number::VARCHAR || url || visits)" if name == "web_pages" else "k"
    return f"""SELECT company_id, {columns}, '{name}_' || b || '.csv' AS source_file FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id, {head} ORDER BY b DESC, row_number DESC) AS place FROM (
        SELECT *, lag(content) OVER (PARTITION BY company_id, {head} ORDER BY b, row_number) IS NOT DISTINCT FROM content AS same FROM (
          SELECT *, {_content(name)} AS content FROM ({delivered(name)}))) WHERE NOT same) WHERE place = 1"""


def _content(name: str) -> str:
    text = SHEETS[name][1]
    columns = [c for c in re.findall(r" AS (\w+)(?=,|\s+FROM)", text) if c not in ("company_id", "row_number")]
    if name == "web_pages":
        columns = ["url", "visits"]
    return "concat_ws('|', " + ", ".join(f"coalesce({c}, '~')" for c in columns) + ")"


def table_sql(table: str) -> str:
    return " UNION ALL ".join(newest(n, shown[table]) for n, shown in SHOWN.items() if table in shown)


def _register(table: str) -> None:
    @query(f"upsert_{table}", table_sql(table))
    def run(c: Ctx) -> DataFrame:
        return loaded(c).read(table).drop("record_id")

    run.__doc__ = f"``{table}`` after two uploads of every sheet, merged part by part."


for _table in T.SOURCE_TABLES:
    _register(_table)


HISTORY_SQL = """SELECT company_id, document_type, k AS business_key, CAST(row_number() OVER w AS INTEGER) AS record_version,
       row_number() OVER (PARTITION BY company_id, document_type, k ORDER BY b DESC, row_number DESC) = 1 AS is_current, source_file, row_number
FROM (""" + " UNION ALL ".join(f"""SELECT company_id, '{SHEETS[n][0]}' AS document_type, k, b, row_number, '{n}_' || b || '.csv' AS source_file FROM (
  SELECT *, lag(content) OVER (PARTITION BY company_id, k ORDER BY b, row_number) IS NOT DISTINCT FROM content AS same FROM (
    SELECT *, {_content(n)} AS content FROM ({delivered(n)}))) WHERE NOT same""" for n in SHEETS if n != "web_pages") + """)
WINDOW w AS (PARTITION BY company_id, document_type, k ORDER BY b, row_number)"""


@query("fingerprint_history_append", HISTORY_SQL)
def q_history(c: Ctx):
    """Versions of every keyed record over two uploads and a replay; which one is current is derived."""
    history = T.with_current(loaded(c).read(T.HISTORY)).filter("document_type <> 'web_pages'")
    return history.select("company_id", "document_type", "business_key", "record_version", "is_current", "source_file", "row_number")


@query("rejected_rows", " UNION ALL ".join(
    f"SELECT company_id, '{n}_{b}.csv' AS source_file, '{SHEETS[n][0]}' AS document_type, row_number, 'Blank required fields: {f}' AS issue "
    f"FROM ({sheet_sql(n, b)}) WHERE trim(coalesce({REQUIRED[n]}, '')) = ''" for n, f in (("customers", "name"), ("supplier_invoices", "invoice_number")) for b in UPLOADS))
def q_rejects(c: Ctx):
    """Rows that could not become records, with number and message; the rows beside them went on."""
    return loaded(c).read(T.REJECTS).drop("batch")


def _left(tables: dict[str, str], rule: str) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS name, company_id, source_file, count(*) AS rows FROM ({sql}) WHERE {rule} GROUP BY 2, 3" for t, sql in tables.items())


def _counts(store: Store) -> DataFrame:
    parts = [store.read(t).groupBy("company_id", "source_file").agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "*") for t in _TABLE_SQL]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Sheets of the stores that deletions are tried on, and the tables that these sheets fill.
SOME = ("customers", "payments", "bank_statements", "market_context")


def _copy(c: Ctx, kind: str) -> Store:
    """A store of its own with both uploads of some sheets."""
    store = new_store(c, kind)
    for number in UPLOADS:
        T.import_batch(store, f"upload-{number}", upload(c, number, SOME), c.as_of)
    return store


_TABLE_SQL: dict[str, str] = {}
for _name in SOME:
    for _table, _columns in SHOWN[_name].items():
        _sql = newest(_name, "1 AS one")
        _TABLE_SQL[_table] = f"{_TABLE_SQL[_table]} UNION ALL {_sql}" if _table in _TABLE_SQL else _sql


@query("source_purge", _left(_TABLE_SQL, "NOT (company_id IN ('co-1', 'co-3') AND source_file IN ('payments_2.csv', 'bank_statements_1.csv', 'customers_2.csv'))"))
def q_source_purge(c: Ctx):
    """Rows left in all tables when three files of two companies are taken out."""
    store = _copy(c, "purge")
    files = [(co, f) for co in ("co-1", "co-3") for f in ("payments_2.csv", "bank_statements_1.csv", "customers_2.csv")]
    T.source_purge(store, "purge-1", c.spark.createDataFrame(files, "company_id string, source_file string"))
    return _counts(store)


@query("scope_clear", " UNION ALL ".join(
    f"SELECT '{t}' AS name, company_id, source_file, count(*) AS rows FROM ({sql}) WHERE company_id <> '{'co-4' if t == 'market_signals' else 'co-2'}' GROUP BY 2, 3"
    for t, sql in _TABLE_SQL.items()))
def q_scope_clear(c: Ctx):
    """Rows left when one company's business tables and another one's market signals are cleared."""
    store = _copy(c, "scope")
    one = lambda co: c.spark.createDataFrame([(co,)], "company_id string")
    T.scope_clear(store, "clear-1", one("co-2"), "company")
    T.scope_clear(store, "clear-2", one("co-4"), "market")
    return _counts(store)
