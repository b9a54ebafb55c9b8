"""Column mapping of uploaded tables: aliases to fields, the required-field gate, business
keys and typed records. A mapping depends on a table's header only, so it is made once at plan time from
the schema; the rows are then mapped by plain select expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import record_id, row_hash, safe_float

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: field aliases and required fields of the document types that the adapters load.
# Other types come in as a parameter of the same shape.
# ---------------------------------------------------------------------------------------------
ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "bank_statements": {
        "transaction_date": ("transaction_date", "date", "posted_date", "value_date"),
        "description": ("description", "narration", "details", "memo"),
        "account_name": ("account_name", "account", "bank_account"),
        "amount": ("amount", "net_amount", "transaction_amount"),
        "debit": ("debit", "withdrawal", "money_out"),
        "credit": ("credit", "deposit", "money_in"),
        "balance": ("balance", "running_balance", "closing_balance"),
        "currency": ("currency", "currency_code"),
    },
    "sales_invoices": {
        "invoice_number": ("invoice_number", "invoice_no", "invoice"),
        "supplier": ("customer", "client", "customer_name", "client_name", "supplier", "company"),
        "invoice_date": ("invoice_date", "date"),
        "due_date": ("due_date", "payment_due", "due"),
        "amount": ("amount", "total", "invoice_total", "gross_amount", "amount_due", "grand_total"),
        "subtotal": ("subtotal", "net_amount", "amount_ex_gst", "exclusive_amount"),
        "gst_amount": ("gst", "gst_amount", "tax", "tax_amount"),
        "status": ("status", "payment_status"),
        "currency": ("currency", "currency_code"),
    },
    "supplier_invoices": {
        "invoice_number": ("invoice_number", "invoice_no", "invoice", "bill_number", "bill_no"),
        "supplier": ("supplier", "vendor", "supplier_name", "vendor_name", "company"),
        "invoice_date": ("invoice_date", "bill_date", "date"),
        "due_date": ("due_date", "payment_due", "due"),
        "amount": ("amount", "total", "invoice_total", "gross_amount", "amount_due", "grand_total"),
        "subtotal": ("subtotal", "net_amount", "amount_ex_gst", "exclusive_amount"),
        "gst_amount": ("gst", "gst_amount", "tax", "tax_amount"),
        "status": ("status", "payment_status"),
        "currency": ("currency", "currency_code"),
        "quantity": ("quantity", "qty", "units"),
    },
    "invoices": {
        "invoice_number": ("invoice_number", "invoice_no", "invoice", "bill_number"),
        "supplier": ("supplier", "vendor", "customer", "client", "company"),
        "invoice_date": ("invoice_date", "date"),
        "due_date": ("due_date", "payment_due"),
        "amount": ("amount", "total", "invoice_total", "amount_due", "grand_total"),
        "subtotal": ("subtotal", "net_amount", "amount_ex_gst"),
        "gst_amount": ("gst", "gst_amount", "tax", "tax_amount"),
        "status": ("status", "payment_status"),
        "currency": ("currency", "currency_code"),
    },
    "customers": {
        "code": ("customer_code", "customer_id", "client_id", "code"),
        "name": ("customer", "customer_name", "client", "client_name", "name"),
        "country": ("country", "customer_country", "location"),
        "segment": ("segment", "customer_segment", "category"),
        "status": ("status", "active"),
    },
    "suppliers": {
        "code": ("supplier_code", "supplier_id", "vendor_id", "code"),
        "name": ("supplier", "supplier_name", "vendor", "vendor_name", "name"),
        "country": ("country", "supplier_country", "location"),
        "category": ("category", "supplier_category", "type"),
        "currency": ("currency", "currency_code"),
        "status": ("status", "active"),
    },
    "inventory": {
        "sku": ("sku", "product_code", "item_code", "stock_code"),
        "name": ("product", "product_name", "item", "description", "name"),
        "quantity": ("quantity", "qty", "stock_on_hand"),
        "unit_cost": ("unit_cost", "cost", "purchase_price"),
        "total_value": ("total_value", "inventory_value", "stock_value"),
        "location": ("location", "warehouse", "store"),
        "status": ("status", "stock_status"),
    },
}
REQUIRED: dict[str, tuple[str, ...]] = {
    "bank_statements": ("description",),
    "sales_invoices": ("invoice_number", "amount"),
    "supplier_invoices": ("invoice_number", "amount"),
    "invoices": ("invoice_number", "amount"),
    "customers": ("name",),
    "suppliers": ("name",),
    "inventory": ("name",),
    "transactions": ("description", "amount"),
    "payments": ("amount",),
    "assets": ("name", "amount"),
    "liabilities": ("name", "amount"),
    "budgets": ("period", "budget_amount"),
    "payroll": ("gross_pay",),
    "profit_loss": ("line_item", "amount"),
    "market_context": ("topic",),
}
# Types without an alias list: their columns carry the field names.
FIELDS: dict[str, tuple[str, ...]] = {
    "transactions": ("transaction_date", "description", "category", "amount"),
    "payments": ("payment_date", "reference", "counterparty", "amount", "currency", "status"),
    "assets": ("name", "category", "classification", "amount"),
    "liabilities": ("name", "category", "classification", "amount"),
    "budgets": ("period", "account", "category", "budget_amount", "actual_amount"),
    "payroll": ("pay_period", "employee", "gross_pay", "ordinary_time_earnings", "payg_withholding", "superannuation", "net_pay", "currency", "status"),
    "profit_loss": ("period_start", "period_end", "line_item", "amount", "currency"),
    "market_context": ("signal_type", "topic", "entity", "geography", "observed_at", "published_at", "value", "unit", "direction",
                       "source_name", "relevance_score", "estimated_impact"),
}
DEFAULT_STATUS = "active"


def mapping_of(columns: Sequence[str], document_type: str, aliases=ALIASES) -> dict[str, str]:
    """Field -> column: the first alias that is a column, otherwise the first column that contains any
    alias. ``columns`` are normalised names in sheet order."""
    out = {}
    known = aliases.get(document_type) or {f: (f,) for f in FIELDS.get(document_type, ())}
    for field, names in known.items():
        exact = (n for n in names if n in columns)
        within = (c for c in columns if any(n in c for n in names))
        column = next(exact, None) or next(within, None)
        if column:
            out[field] = column
    return out


def missing_fields(mapping: dict[str, str], document_type: str, required=REQUIRED) -> list[str]:
    """The required-field gate: fields without a column."""
    return [f for f in required.get(document_type, ()) if not mapping.get(f)]


def mapped_counts(rows: DataFrame, source: str, document_type: str) -> DataFrame:
    """(source, document_type, field, column_name, filled): the mapping of one table and how many of its
    rows have a value in each mapped column, in one pass."""
    mapping = mapping_of(rows.columns, document_type)
    counts = rows.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f) for f, c in mapping.items()])
    each = [F.struct(F.lit(f).alias("field"), F.lit(c).alias("column_name"), F.col(f).alias("filled")) for f, c in mapping.items()]
    nothing = F.array().cast("array<struct<field:string,column_name:string,filled:bigint>>")
    return counts.select(F.lit(source).alias("source"), F.lit(document_type).alias("document_type"),
                         F.explode(F.array(*each) if each else nothing).alias("m")).select("source", "document_type", "m.*")


def gate(rows: DataFrame, source: str, document_type: str) -> DataFrame:
    """(source, document_type, missing, accepted, rejected): a table that lacks a required field is held
    back whole, with the reason."""
    missing = missing_fields(mapping_of(rows.columns, document_type), document_type)
    n = F.count(F.lit(1)).cast("bigint")
    return rows.agg(n.alias("n")).select(
        F.lit(source).alias("source"), F.lit(document_type).alias("document_type"), F.lit(",".join(missing)).alias("missing"),
        F.when(F.lit(not missing), F.col("n")).otherwise(0).cast("bigint").alias("accepted"),
        F.when(F.lit(bool(missing)), F.col("n")).otherwise(0).cast("bigint").alias("rejected"))


def business_key(document_type: str, field) -> Column:
    """Key of a record; ``field(name)`` gives a mapped value. Null if all its parts are blank: callers then
    take the row's hash, so that rows without a key stay apart (a record keyed by blanks alone would be
    overwritten by the next one)."""
    def pick(name: str) -> Column:
        return F.lower(F.trim(F.coalesce(field(name).cast("string"), F.lit(""))))

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(pick(n), F.lit("")) for n in names])

    def parts(*names: str, amount: bool = False) -> Column:
        cents = F.format_string("%.2f", safe_float(F.coalesce(field("amount").cast("string"), F.lit("0"))))
        return F.when(F.concat(*[pick(n) for n in names]) != "", F.concat_ws("|", *[pick(n) for n in names], *[cents] * amount))

    invoice = lambda: parts("invoice_number", "supplier")
    dated = lambda: parts("transaction_date", "description", amount=True)
    statement = lambda: parts("period_end", "line_item")
    formulas = {
        "supplier_invoices": invoice, "sales_invoices": invoice, "invoices": invoice, "transactions": dated, "bank_statements": dated,
        "payments": lambda: parts("payment_date", "reference", "counterparty", amount=True),
        "assets": lambda: first("name"), "liabilities": lambda: first("name"), "assets_liabilities": lambda: first("name"),
        "customers": lambda: first("code", "name"), "suppliers": lambda: first("code", "name"), "inventory": lambda: first("sku", "name"),
        "budgets": lambda: parts("period", "account", "category"), "payroll": lambda: parts("pay_period", "employee"),
        "balance_sheet": statement, "profit_loss": statement, "cash_flow_statement": statement,
        "market_context": lambda: parts("published_at", "topic", "entity", "geography"),
    }
    return formulas.get(document_type, lambda: F.lit(None).cast("string"))()


def apply_mapping(rows: DataFrame, document_type: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rows of a table as records of its type: (document_type, record_id, business_key, row_hash, name,
    group_name, status, quantity, value). Nothing comes out of a table that the gate holds back.
    ``mapping`` is a saved or manual one; by default it is made from the header."""
    mapping = mapping or mapping_of(rows.columns, document_type)
    if missing_fields(mapping, document_type):
        rows = rows.limit(0)

    def field(name: str) -> Column:
        return F.col(mapping[name]) if name in mapping else F.lit(None).cast("string")

    key = business_key(document_type, field)
    number = lambda name: F.coalesce(safe_float(field(name).cast("string")), F.lit(0.0))
    digest = row_hash(*rows.columns)
    group = {"customers": "segment", "suppliers": "category", "inventory": "location"}.get(document_type, "account_name")
    return rows.select(
        F.lit(document_type).alias("document_type"), F.coalesce(key, digest).alias("business_key"), digest.alias("row_hash"),
        F.coalesce(field("name").cast("string"), F.lit("")).alias("name"), F.coalesce(field(group).cast("string"), F.lit("")).alias("group_name"),
        F.coalesce(field("status").cast("string"), F.lit(DEFAULT_STATUS)).alias("status"), number("quantity").alias("quantity"),
        F.when(number("total_value") != 0, number("total_value")).otherwise(number("quantity") * number("unit_cost")).alias("value"),
    ).withColumn("record_id", record_id(F.col("document_type"), F.col("business_key")))
