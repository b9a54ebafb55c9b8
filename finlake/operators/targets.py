"""Uploaded rows into the operational tables: one batch of sheets is mapped, versioned against
the stored fingerprints and merged into thirteen targets, in one step of a ``Store``. Batch and stream loads
both go through ``import_batch``."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import ExitStack, closing
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import record_id, row_hash, safe_date, safe_float
from ..session import at_once, shuffles_released
from .incremental import fingerprint_versions
from .mapping import REQUIRED, business_key, mapping_of, missing_fields
from .store import Change, Store, in_slices

HISTORY = "row_history"
HISTORY_KEYS = ("company_id", "document_type", "business_key")
HISTORY_SCHEMA = ("company_id string, document_type string, business_key string, row_hash string, record_version int, "
                  "record_id string, source_file string, row_number long, batch string")
REJECTS = "rejected_rows"
TARGET_KEYS = ("company_id", "record_id")
#: Types with this many rows for each part of a store or more are taken to fall into all its parts.
FEW_A_PART = 100


@dataclass
class Sheet:
    """One uploaded table: ``rows`` has company_id, row_number and the columns of its header. ``most``: how many rows it
    can have, where that is known without reading it; sheets of many rows are loaded some key parts at a time."""

    document_type: str
    rows: DataFrame
    source_file: str
    mapping: dict[str, str] | None = None
    most: int = 0


def _header(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("company_id", "row_number")]


def target_records(document_type: str, field, as_of: str) -> dict[str, dict[str, Column]]:
    """Columns of each table that a row of the type goes to; ``field(name)`` gives a mapped value as text,
    null where the type has no such column."""
    def text(name: str, default: str = "") -> Column:
        return F.coalesce(field(name), F.lit(default))

    def number(name: str, default: float = 0.0) -> Column:
        return F.coalesce(safe_float(field(name)), F.lit(default)) if default == 0.0 else F.when(field(name).isNotNull(), safe_float(field(name))).otherwise(default)

    def day(name: str) -> Column:
        return safe_date(field(name), as_of)

    def named(name: str, prefix: str) -> Column:
        return F.coalesce(field(name), F.concat(F.lit(prefix + " "), F.col("row_number").cast("string")))

    def transaction(date: str, description: Column, category: Column, amount: Column) -> dict[str, Column]:
        return {"transaction_date": day(date), "description": description, "category": category, "amount": amount, "status": F.lit("imported")}

    if document_type in ("assets", "liabilities", "assets_liabilities"):
        forced = {"assets": "asset", "liabilities": "liability"}.get(document_type)
        raw = F.lower(text("category", "asset"))
        category = F.lit(forced) if forced else F.when(raw.contains("liabil") | raw.contains("debt"), "liability").otherwise("asset")
        term = F.lower(text("classification", "current"))
        long = term.contains("non") | term.contains("long") | term.contains(">12")
        return {"assets_liabilities": {"name": named("name", "Imported item"), "category": category,
                                       "classification": F.when(long, "non-current").otherwise("current"), "amount": number("amount"), "status": F.lit("imported")}}
    if document_type in ("supplier_invoices", "sales_invoices", "invoices"):
        return {"invoices": {
            "invoice_number": F.coalesce(field("invoice_number"), F.concat(F.lit("IMPORTED-"), F.col("row_number").cast("string"))),
            "supplier": text("supplier", "Unknown counterparty"), "invoice_date": day("invoice_date"), "due_date": day("due_date"), "amount": number("amount"),
            "status": F.lower(text("status", "due")), "invoice_kind": F.lit("sales" if document_type == "sales_invoices" else "supplier"),
            "currency": text("currency", "AUD"), "subtotal": number("subtotal"), "gst_amount": number("gst_amount"), "description": text("description"),
            "tax_code": F.lit("REVIEW"), "validation_status": F.lit("needs_review"), "quantity": number("quantity")}}
    if document_type == "transactions":
        return {"transactions": transaction("transaction_date", named("description", "Imported transaction"), text("category", "imported"), number("amount"))}
    if document_type == "bank_statements":
        amount = F.when(number("amount") != 0, number("amount")).otherwise(number("credit") - number("debit"))
        description = named("description", "Bank entry")
        return {"bank_transactions": {"transaction_date": day("transaction_date"), "description": description, "account_name": text("account_name", "Bank account"),
                                      "amount": amount, "balance": number("balance"), "currency": text("currency")},
                "transactions": transaction("transaction_date", description, F.lit("bank transaction"), amount)}
    if document_type == "payments":
        party = text("counterparty", "Unknown counterparty")
        return {"payments": {"payment_date": day("payment_date"), "reference": text("reference"), "counterparty": party, "amount": number("amount"),
                             "currency": text("currency"), "status": text("status", "imported")},
                "transactions": transaction("payment_date", F.trim(F.concat_ws(" ", party, text("reference"))), F.lit("payment"), -F.abs(number("amount")))}
    if document_type == "customers":
        return {"customers": {"code": text("code"), "name": named("name", "Customer"), "country": text("country"), "segment": text("segment"), "status": text("status", "active")}}
    if document_type == "suppliers":
        return {"suppliers": {"code": text("code"), "name": named("name", "Supplier"), "country": text("country"), "category": text("category"),
                              "currency": text("currency"), "status": text("status", "active")}}
    if document_type == "inventory":
        quantity, cost = number("quantity"), number("unit_cost")
        return {"inventory": {"sku": text("sku"), "name": named("name", "Item"), "quantity": quantity, "unit_cost": cost,
                              "total_value": F.when(number("total_value") != 0, number("total_value")).otherwise(quantity * cost),
                              "location": text("location"), "status": text("status", "active")}}
    if document_type == "budgets":
        budget, actual = number("budget_amount"), number("actual_amount")
        return {"budgets": {"period": text("period"), "account": text("account"), "category": text("category"), "budget_amount": budget,
                            "actual_amount": actual, "variance": actual - budget}}
    if document_type == "payroll":
        gross, ote = number("gross_pay"), number("ordinary_time_earnings")
        return {"payroll_records": {"pay_period": text("pay_period", as_of), "employee": named("employee", "Employee"), "gross_pay": gross,
                                    "ordinary_time_earnings": F.when(ote != 0, ote).otherwise(gross), "payg_withholding": number("payg_withholding"),
                                    "superannuation": number("superannuation"), "net_pay": number("net_pay"), "currency": text("currency", "AUD"),
                                    "status": text("status", "imported")}}
    if document_type in ("balance_sheet", "profit_loss", "cash_flow_statement"):
        return {"statement_snapshots": {"statement_type": F.lit(document_type), "period_start": day("period_start"), "period_end": day("period_end"),
                                        "line_item": named("line_item", "Line"), "amount": number("amount"), "currency": text("currency")}}
    if document_type == "market_context":
        score = number("relevance_score", 0.5)
        return {"market_signals": {"signal_type": text("signal_type", "market"), "topic": named("topic", "Market signal"), "entity": text("entity"),
                                   "geography": text("geography"), "observed_at": day("observed_at"), "published_at": text("published_at"), "value": number("value"),
                                   "unit": text("unit"), "direction": text("direction"), "source_name": text("source_name"),
                                   "relevance_score": F.when(score > 1, score / 100).otherwise(score), "estimated_impact": text("estimated_impact")}}
    return {"generic_documents": {"document_type": F.lit(document_type), "title": F.coalesce(F.col("_first"), F.concat(F.lit("Record "), F.col("row_number").cast("string"))),
                                  "content": F.col("_content"), "row_number": F.col("row_number")}}


def _mapping(sheet: Sheet) -> dict[str, str]:
    return sheet.mapping or mapping_of(_header(sheet.rows), sheet.document_type)


def uploaded_rows(sheet: Sheet, names: Sequence[str] | None = None, of=None) -> DataFrame:
    """The rows of a sheet in one form for all types: keys, digest, the mapped values as text in the order of
    ``names`` (by default the fields of its mapping), for types without a table of their own the row as canonical
    JSON, and ``issue``, the reason why a row cannot become a record (null if it can). ``of``: a condition on company,
    type and key; rows that have a key are left out where it does not hold, before they are worked on."""
    header = _header(sheet.rows)
    mapping = _mapping(sheet)
    field = lambda name: F.col(mapping[name]) if name in mapping else F.lit(None).cast("string")
    digest, key = row_hash(*header), business_key(sheet.document_type, field)
    rows = sheet.rows if of is None else sheet.rows.filter(key.isNull() | of(F.col("company_id"), F.lit(sheet.document_type), key))
    # the row as JSON and its first value are only shown by tables of documents of no known type
    generic = "generic_documents" in target_records(sheet.document_type, field, "1970-01-01")
    shown = lambda value: value if generic else F.lit(None).cast("string")
    fields = F.array(*[field(f).cast("string") for f in (mapping if names is None else names)])
    return rows.select(
        "company_id", F.lit(sheet.document_type).alias("document_type"), F.coalesce(key, digest).alias("business_key"),
        digest.alias("row_hash"), F.lit(sheet.source_file).alias("source_file"), F.col("row_number").cast("long").alias("row_number"),
        fields.cast("array<string>").alias("fields"), shown(F.col(header[0]).cast("string")).alias("_first"),
        shown(F.to_json(F.struct(*[F.col(c) for c in sorted(header)]), {"ignoreNullFields": "false"})).alias("_content"), _issue(sheet, mapping).alias("issue"))


def _issue(sheet: Sheet, mapping: dict[str, str]) -> Column:
    missing = missing_fields(mapping, sheet.document_type)
    if missing:
        return F.lit("Missing required mappings: " + ", ".join(missing))
    blank = [F.when(F.trim(F.coalesce(F.col(mapping[f]).cast("string"), F.lit(""))) == "", F.lit(f)) for f in REQUIRED.get(sheet.document_type, ())]
    names = F.concat_ws(", ", *blank) if blank else F.lit("")
    return F.when(names != "", F.concat(F.lit("Blank required fields: "), names)).otherwise(F.lit(None).cast("string"))


def current_versions(history: DataFrame, keys: Sequence[str] = HISTORY_KEYS) -> DataFrame:
    """Newest version of each key; ``is_current`` is never stored."""
    best = F.max_by(F.struct("row_hash", "record_version", "record_id"), F.col("record_version"))
    return history.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def with_current(history: DataFrame) -> DataFrame:
    """The history with ``is_current``, derived from the versions."""
    last = history.groupBy(*HISTORY_KEYS).agg(F.max("record_version").alias("_last"))
    return history.join(last, list(HISTORY_KEYS)).withColumn("is_current", F.col("record_version") == F.col("_last")).drop("_last")


def import_batch(store: Store, batch: str, sheets: Sequence[Sheet], as_of: str) -> bool:
    """Load one upload: good rows that are new or changed go to their targets and leave a version in the
    history; rows that cannot become records are kept with number and message; the rest is left alone. Every
    table of the batch is published at once, and a batch that was loaded before changes nothing.

    Types that share no table are loaded one after the other, large ones some key parts at a time, so that the upload
    needs room for the shuffles of a slice and for the scratch rows of one table, not for those of all its sheets. Those
    that share a table are versioned side by side if they are known to have no more rows together than a slice."""
    if store.committed(batch):
        return False
    with shuffles_released(store.spark), closing(_steps(store, batch, sheets, as_of)) as steps:
        return store.commit(batch, steps)


def _steps(store: Store, batch: str, sheets: Sequence[Sheet], as_of: str) -> Iterator[dict[str, Change]]:
    """What a batch does, a group of types at a time; scratch rows of a group go before the next is looked at."""
    by_type: dict[str, list[Sheet]] = {}
    for sheet in sheets:
        by_type.setdefault(sheet.document_type, []).append(sheet)
    names = {t: list(dict.fromkeys(f for sheet in mine for f in _mapping(sheet))) for t, mine in by_type.items()}  # fields, over all sheets of a type
    most = {t: sum(sheet.most for sheet in mine) if all(sheet.most for sheet in mine) else None for t, mine in by_type.items()}
    for types in _sharing_tables(by_type, as_of):
        with ExitStack() as held:
            scratch = [lambda t=t: held.enter_context(store.scratch(_in_slices(store, t, by_type[t], names[t]), t)) for t in types]
            kept = dict(zip(types, at_once(store.spark, scratch) if _no_more_than_a_slice(types, most) else [step() for step in scratch]))
            yield _changes(kept, names, batch, as_of)


def _sharing_tables(types: Iterable[str], as_of: str) -> list[list[str]]:
    """The types in groups: those that go to a common table, directly or through others, are together."""
    groups: list[tuple[list[str], set[str]]] = []
    for t in types:
        tables = set(target_records(t, lambda _: F.lit(None).cast("string"), as_of))
        met = [g for g in groups if g[1] & tables]
        merged = ([x for g in met for x in g[0]] + [t], tables.union(*(g[1] for g in met)))
        first = groups.index(met[0]) if met else len(groups)
        groups = [g for g in groups if g not in met]
        groups.insert(first, merged)
    return [g[0] for g in groups]


def _no_more_than_a_slice(types: Sequence[str], most: dict[str, int | None]) -> bool:
    return None not in (known := [most[t] for t in types]) and len(in_slices(dict(enumerate(known)))) == 1


def _in_slices(store: Store, document_type: str, sheets: Sequence[Sheet], names: Sequence[str]) -> Iterator[DataFrame]:
    """The versioned rows of one type; of many rows some key parts after the other, so that the shuffles of a slice alone
    need room. Rows of a key are in one part, and are taken before they move."""
    most = sum(sheet.most for sheet in sheets)
    slices = in_slices({part: -(-most // store.parts) for part in range(store.parts)})
    for parts in slices:
        yield _versioned(store, document_type, sheets, names, parts if len(slices) > 1 else None)


def _versioned(store: Store, document_type: str, sheets: Sequence[Sheet], names: Sequence[str], parts: Sequence[int] | None = None) -> DataFrame:
    """Rows of one type that are new, changed or rejected, with their versions: those of some parts of the history, or all."""
    inside = None if parts is None else lambda *keys: store.part_of(keys).isin(list(parts))
    rows = reduce(DataFrame.unionByName, [uploaded_rows(sheet, names, inside) for sheet in sheets])
    if inside is not None:
        rows = rows.filter(inside(*HISTORY_KEYS))  # rows without a key of their own
    # each field is a column of its own: no array is built, moved and written for a row
    rows = rows.select(*[c for c in rows.columns if c != "fields"], *[F.get("fields", F.lit(i)).alias(_field(i)) for i in range(len(names))])
    # rows that cannot become records go the same way, each under its own digest, so that the sheets are read once;
    # digests travel as bytes, record ids only where they are not those of their keys
    bad = F.col("issue").isNotNull()
    rows = rows.withColumns({"business_key": F.when(bad, F.col("row_hash")).otherwise(F.col("business_key")), "row_hash": F.unhex("row_hash"), "_bad": bad,
                              "document_type": F.lit(document_type)})
    # the parts that few rows fall into are looked up first; many rows fall into all, and are not worked out for that
    few = parts is None and sum(sheet.most for sheet in sheets) < FEW_A_PART * store.parts
    history = store.near(HISTORY, rows.filter(~bad), HISTORY_KEYS, HISTORY_SCHEMA) if few else store.read(HISTORY, HISTORY_SCHEMA, parts)
    history = history.filter(F.col("document_type") == document_type).withColumns({
        "row_hash": F.unhex("row_hash"), "record_id": F.nullif(F.col("record_id"), record_id(F.col("document_type"), F.col("business_key")))})
    # state and rows meet by the keys of the state, which moves once: what a rejected row meets there is not used. Keys are
    # told apart by a hash first, which sorts faster than they do
    scope, hashed = ("_hash", "company_id"), F.xxhash64("company_id", "business_key")
    state = current_versions(history.withColumn("_hash", hashed), (*scope, "business_key")).withColumn("document_type", F.lit(document_type))
    # only the newest row of a key goes to its table, so that a table's rows meet no others of the batch
    seen = fingerprint_versions(rows.withColumn("_hash", hashed), state, order="row_number", scope=scope, apart=("_bad",), newest="_newest")
    return seen.filter(F.col("_bad") | (F.col("decision") != "unchanged")).drop("_hash")


def _field(index: int) -> str:
    """The column of a field in the versioned rows of its type."""
    return f"_f{index}"


def _changes(kept: dict[str, DataFrame], names: dict[str, list[str]], batch: str, as_of: str) -> dict[str, Change]:
    """What the new, changed and rejected rows of some types do to the tables."""
    targets: dict[str, list[DataFrame]] = {}
    for document_type, rows in kept.items():
        mine, known = rows.filter(~F.col("_bad") & F.col("_newest")), names[document_type]
        field = lambda f, known=known: F.col(_field(known.index(f))) if f in known else F.lit(None).cast("string")
        for name, columns in target_records(document_type, field, as_of).items():
            part = mine.select("company_id", "record_id", *[v.alias(k) for k, v in columns.items()], "source_file", F.col("record_version").alias("_order"))
            targets.setdefault(name, []).append(part)
    changes = {name: Change(reduce(DataFrame.unionByName, parts), TARGET_KEYS, order="_order", single=True) for name, parts in targets.items()}
    common = ("company_id", "document_type", "business_key", "row_hash", "record_version", "record_id", "source_file", "row_number", "issue", "_bad")
    every = reduce(DataFrame.unionByName, [rows.select(*common) for rows in kept.values()])
    changed, rejected = every.filter(~F.col("_bad")), every.filter(F.col("_bad"))
    history = changed.select(*HISTORY_KEYS, F.lower(F.hex("row_hash")).alias("row_hash"), "record_version", "record_id", "source_file", "row_number", F.lit(batch).alias("batch"))
    rejected = rejected.select("company_id", "source_file", "document_type", "row_number", "issue", F.lit(batch).alias("batch"))
    return changes | {HISTORY: Change(history, HISTORY_KEYS, "append"), REJECTS: Change(rejected, ("company_id", "source_file"), "append")}


# FIXED VALUES: tables that hold rows of a source file, and what each scope clears
SOURCE_TABLES = ("assets_liabilities", "transactions", "payments", "bank_transactions", "customers", "suppliers", "inventory", "budgets",
                 "payroll_records", "statement_snapshots", "market_signals", "generic_documents", "invoices")
SCOPES = {
    "company": tuple(t for t in SOURCE_TABLES if t != "market_signals") + (HISTORY, REJECTS),
    "market": ("market_signals",),
    "all": (*SOURCE_TABLES, HISTORY, REJECTS),
}


def source_purge(store: Store, batch: str, sources: DataFrame) -> bool:
    """Take out what some source files brought, given as (company_id, source_file), as one step: their rows in
    all targets, their versions and their rejected rows. A key whose newest version goes loses its older ones
    too, since its record is gone: the next upload of it is new. Records that a later file also changed carry
    that file's name and stay. The state before stays readable under its published number."""
    gone = sources.select("company_id", "source_file").distinct()
    if store.committed(batch):
        return False
    changes = {t: Change(gone, (), "delete") for t in (*SOURCE_TABLES, REJECTS)}
    history = store.read(HISTORY, HISTORY_SCHEMA)
    marked = gone.withColumn("_gone", F.lit(True))
    last = history.groupBy(*HISTORY_KEYS).agg(F.max_by("source_file", "record_version").alias("source_file"))
    ended = last.join(marked, ["company_id", "source_file"]).select(*HISTORY_KEYS, F.lit(True).alias("_ended"))
    versions = history.join(marked, ["company_id", "source_file"], "left").join(ended, list(HISTORY_KEYS), "left")
    versions = versions.filter(F.col("_gone") | F.col("_ended")).select(*HISTORY_KEYS, "record_version")
    # worked out once: they are both counted and taken out
    with shuffles_released(store.spark), store.scratch([versions], "purge") as ended_versions:
        return store.commit(batch, changes | {HISTORY: Change(ended_versions, (), "delete")})


def scope_clear(store: Store, batch: str, companies: DataFrame, scope: str) -> bool:
    """Clear the tables of a scope for some companies (one column, company_id), as one step."""
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {', '.join(SCOPES)}")
    gone = companies.select("company_id").distinct()
    return store.commit(batch, {t: Change(gone, (), "delete") for t in SCOPES[scope]})
