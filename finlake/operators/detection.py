"""Document type of uploaded tables from file name and header, and the stored mappings of headers
seen before. Works on a manifest with one row per uploaded sheet; each distinct header is scored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import evaluate_once, file_stem, first_keyword_class, route_token, schema_signature
from .mapping import ALIASES, FIELDS, REQUIRED
from .store import Change, Store

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: words that speak for a type, in order of preference on equal scores; weights and limits
# ---------------------------------------------------------------------------------------------
HINTS: dict[str, tuple[str, ...]] = {
    "bank_statements": ("bank_statement", "running_balance", "withdrawal", "deposit"),
    "payments": ("payment_reference", "paid_amount", "payment_date"),
    "supplier_invoices": ("supplier_invoice", "vendor", "bill_number", "bill_no"),
    "sales_invoices": ("sales_invoice", "customer_name", "client_name"),
    "customers": ("customer_master", "customer_code", "customer_id"),
    "suppliers": ("supplier_master", "supplier_code", "vendor_id"),
    "inventory": ("inventory", "stock_on_hand", "sku", "product_code"),
    "budgets": ("budget_amount", "planned", "budget"),
    "balance_sheet": ("balance_sheet", "assets", "equity"),
    "profit_loss": ("profit_loss", "income_statement", "revenue", "expenses"),
    "payroll": ("payroll", "pay_run", "gross_pay", "payg", "superannuation", "net_pay"),
    "chart_of_accounts": ("chart_of_accounts", "coa", "account_code", "account_type"),
    "personnel_plan": ("personnel_plan", "headcount", "role", "salary"),
    "market_context": ("market_context", "relevance_score", "business_impact", "source_url", "geopolitical"),
    "transactions": ("transaction", "narration", "description", "amount"),
}
TOKEN_WEIGHT, REQUIRED_WEIGHT, MAPPED_WEIGHT = 1.5, 2.0, 0.15
INVOICE_WORDS = ("invoice", "supplier", "vendor", "customer", "client", "bill")
SALES_WORDS = ("sales_invoice", "customer_invoice", "accounts_receivable", "customer", "client")
SUPPLIER_WORDS = ("supplier_invoice", "vendor_invoice", "accounts_payable", "supplier", "vendor", "bill")
RICH_FIELDS = ("supplier", "invoice_date", "due_date", "subtotal", "gst_amount", "description", "currency")
LEAST_SCORE = 2.2
SAVED_FROM = 0.82
PROFILES = "mapping_profiles"
PROFILE_KEYS = ("company_id", "document_type", "signature")
PROFILE_SCHEMA = "company_id string, document_type string, signature string, mapping map<string,string>, confidence double, batch string, seq long"


def names_of(document_type: str, aliases=ALIASES) -> dict[str, tuple[str, ...]]:
    """Field -> names a column may have: the type's alias list, or the field names themselves."""
    return aliases.get(document_type) or {f: (f,) for f in FIELDS.get(document_type, ())}


def normalised_header(header: Column) -> Column:
    """Column names as words joined by underscores."""
    return F.transform(header, lambda x: F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("column")))


def _entries(types, aliases) -> Column:
    """All (type, field, names) as one literal."""
    return F.array(*[F.struct(F.lit(t).alias("type"), F.lit(f).alias("field"), F.array(*[F.lit(n) for n in ns]).alias("names"))
                     for t in types for f, ns in names_of(t, aliases).items()])


def suggested(columns: Column, types, aliases=ALIASES, only: Column | None = None) -> Column:
    """Array of (type, field, column): for every field of every type (or the type ``only``) the column of the
    header that is one of its names (the first name that is there), else the first column that contains one."""
    def find(e: Column) -> Column:
        exact = F.get(F.filter(e["names"], lambda n: F.array_contains(columns, n)), F.lit(0))
        within = F.get(F.filter(columns, lambda c: F.exists(e["names"], lambda n: c.contains(n))), F.lit(0))
        return F.struct(e["type"].alias("type"), e["field"].alias("field"), F.coalesce(exact, within).alias("column"))

    entries = _entries(types, aliases)
    mine = entries if only is None else F.filter(entries, lambda e: e["type"] == only)
    return F.filter(F.transform(mine, find), lambda e: e["column"].isNotNull())


def mapping_for(found: Column, document_type: Column) -> Column:
    """The mapping of one type out of what ``suggested`` found, as a map field -> column."""
    mine = F.filter(found, lambda e: e["type"] == document_type)
    return F.map_from_entries(F.transform(mine, lambda e: F.struct(e["field"].alias("key"), e["column"].alias("value"))))


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def _percent(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def detect(manifest: DataFrame, aliases=ALIASES, hints=HINTS) -> DataFrame:
    """``manifest`` (filename, sheet, columns) with document_type, confidence, mapping and signature.

    In this order: a type named by the file name; the structure of bank, market, payroll and invoice tables;
    the best score of hint words, required fields and mapped fields, where the first type in the list wins a
    tie; ``generic`` below the least score."""
    columns, joined, found = F.col("columns"), F.col("_joined"), F.col("_fields")
    types = list(dict.fromkeys([*hints, *aliases, *FIELDS]))
    has = lambda t, *fields: F.forall(F.array(*[F.lit(f) for f in fields]), lambda f: F.exists(found, lambda e: (e["type"] == t) & (e["field"] == f)))
    all_in = lambda *names: F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(columns, n))
    word = lambda c: F.get(normalised_header(F.array(F.coalesce(c, F.lit("")))), F.lit(0))

    # hint words and required fields of every type
    table = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(-i).alias("order"), F.array(*[F.lit(w) for w in ws]).alias("words"),
                               F.array(*[F.lit(f) for f in REQUIRED.get(t, ())]).cast("array<string>").alias("need")) for i, (t, ws) in enumerate(hints.items())])
    size = lambda t: F.size(F.filter(found, lambda e: e["type"] == t))

    def mapped(h: Column) -> Column:
        fields = F.transform(F.filter(found, lambda e: e["type"] == h["type"]), lambda e: e["field"])
        return F.struct(F.size(F.array_intersect(h["need"], fields)).alias("need"), F.size(fields).alias("size"))

    # each distinct header is looked through once: its mapping to every type, and all that the types ask of the header alone
    maps = F.map_from_entries(F.filter(F.transform(F.array(*[F.lit(t) for t in types]), lambda t: F.struct(t.alias("key"), mapping_for(found, t).alias("value"))), lambda e: F.size(e["value"]) > 0))
    facts = F.struct(
        F.transform(table, mapped).alias("types"), size("invoices").alias("invoices"), size("assets_liabilities").alias("positions"),
        all_in("due_date").alias("due_date"), has("invoices", *REQUIRED["invoices"]).alias("invoices_ok"), has("assets_liabilities", "name", "amount").alias("positions_ok"),
        (all_in("debit", "credit", "balance") | all_in("withdrawal", "deposit", "balance")).alias("bank"), all_in("topic", "relevance_score", "estimated_impact").alias("market"),
        (has("payroll", "gross_pay") & (has("payroll", "employee") | has("payroll", "pay_period")) & (
            has("payroll", "payg_withholding") | has("payroll", "superannuation") | has("payroll", "net_pay"))).alias("payroll"),
        has("invoices", "invoice_number", "amount").alias("invoice"), (has("invoices", "supplier") | has("invoices", "invoice_date") | has("invoices", "due_date")).alias("party"))
    headers = manifest.select("columns").distinct().withColumn("_fields", evaluate_once(suggested(columns, types, aliases)))
    headers = headers.select("columns", evaluate_once(maps).alias("_maps"), evaluate_once(facts).alias("_h"))
    rows = manifest.join(headers, "columns").withColumn("_joined", evaluate_once(F.concat_ws(" ", "columns", word(F.col("filename")), word(F.col("sheet")))))

    def scored(h: Column, i: Column) -> Column:
        known = F.get(F.col("_h.types"), i)
        hits = F.size(F.filter(h["words"], lambda w: joined.contains(w)))
        score = hits * TOKEN_WEIGHT + known["need"] * REQUIRED_WEIGHT + known["size"] * MAPPED_WEIGHT
        return F.struct(score.alias("score"), h["order"].alias("order"), h["type"].alias("type"), (known["need"] == F.size(h["need"])).alias("ok"))

    fixed = lambda t, order, when, score, ok: F.struct(F.when(when, score).otherwise(F.lit(-1.0)).cast("double").alias("score"), F.lit(order).alias("order"), F.lit(t).alias("type"), F.col(ok).alias("ok"))
    more = [fixed("invoices", -len(hints), joined.contains("invoice") | F.col("_h.due_date"), 4 + F.col("_h.invoices") * 0.2, "_h.invoices_ok"),
            fixed("assets_liabilities", -len(hints) - 1, joined.contains("asset") & joined.contains("liabil"), 6 + F.col("_h.positions") * 0.2, "_h.positions_ok")]
    rows = rows.withColumn("_best", evaluate_once(F.array_max(F.concat(F.transform(table, scored), F.array(*more)))))

    named = first_keyword_class(route_token(file_stem(F.col("filename"))), [(t, [R.route_token_py(x) for x in words]) for t, words in R.FILENAME_RULES], None)
    bank = joined.contains("bank_statement") | F.col("_h.bank")
    market = joined.contains("market_context") | F.col("_h.market")
    payroll = F.col("_h.payroll")
    invoice = F.col("_h.invoice") & (F.col("_h.party") | _any(joined, INVOICE_WORDS))
    sales, supply = _any(joined, SALES_WORDS), _any(joined, SUPPLIER_WORDS)
    kind = F.when(sales & ~supply, "sales_invoices").when(supply & ~sales, "supplier_invoices").otherwise("invoices")
    chosen = lambda rule, t: F.struct(F.lit(rule).alias("rule"), (t if isinstance(t, Column) else F.lit(t)).alias("type"))
    rows = rows.withColumn("_type", evaluate_once(
        F.when(named.isNotNull(), chosen("name", named)).when(bank, chosen("table", "bank_statements")).when(market, chosen("table", "market_context"))
        .when(payroll, chosen("table", "payroll")).when(invoice, chosen("invoice", kind)).when(F.col("_best.score") < LEAST_SCORE, chosen("none", "generic"))
        .otherwise(chosen("score", F.col("_best.type")))))
    rows = rows.withColumn("_mapping", evaluate_once(F.coalesce(F.when(F.col("_type.rule") != "none", F.col("_maps")[F.col("_type.type")]), F.create_map().cast("map<string,string>"))))
    rich = F.size(F.array_intersect(F.map_keys("_mapping"), F.array(*[F.lit(f) for f in RICH_FIELDS])))
    best = F.when(F.col("_best.ok"), F.least(F.lit(0.99), 0.35 + F.col("_best.score") / 12)).otherwise(F.least(F.lit(0.69), F.col("_best.score") / 12))
    confidence = (F.when(F.col("_type.rule") == "name", 0.99).when(F.col("_type.rule") == "table", 0.96)
                  .when(F.col("_type.rule") == "invoice", _percent(F.least(F.lit(0.99), 0.93 + rich * 0.008))).when(F.col("_type.rule") == "none", 0.2).otherwise(_percent(best)))
    return rows.select(*manifest.columns, F.col("_type.type").alias("document_type"), confidence.alias("confidence"), F.col("_mapping").alias("mapping"),
                       schema_signature(columns).alias("signature"))


def declared(detected: DataFrame, declared_type: str = "declared_type", aliases=ALIASES) -> DataFrame:
    """A type that the uploader declared (other than ``auto``) replaces the detected one, with the mapping of
    the declared type (or the detected one if it maps nothing) and a confidence of 0.99."""
    other = (F.col(declared_type) != "auto") & (F.col(declared_type) != F.col("document_type"))
    by_type = mapping_for(suggested(F.col("columns"), sorted({*aliases, *FIELDS}), aliases, F.col(declared_type)), F.col(declared_type))
    rows = detected.withColumn("_declared", evaluate_once(F.when(other, by_type)))
    mapping = F.when(other & (F.size("_declared") > 0), F.col("_declared")).otherwise(F.col("mapping"))
    return rows.withColumns({"mapping": mapping, "confidence": F.when(other, F.greatest("confidence", F.lit(0.99))).otherwise(F.col("confidence")),
                             "document_type": F.when(other, F.col(declared_type)).otherwise(F.col("document_type"))}).drop("_declared")


# -- stored mappings ------------------------------------------------------------------------------

def profiles(store: Store) -> DataFrame:
    """Stored mappings by (company_id, document_type, signature) with their use counts. Uses are kept as
    events and added up on reading, so none is lost and a replayed batch adds none."""
    events = store.read(PROFILES, PROFILE_SCHEMA)
    last = F.max_by(F.when(F.col("mapping").isNotNull(), F.struct("mapping", "confidence")), F.when(F.col("mapping").isNotNull(), F.col("seq")))
    return events.groupBy(*PROFILE_KEYS).agg(last.alias("p"), F.count("*").alias("use_count")).select(*PROFILE_KEYS, "p.mapping", "p.confidence", "use_count")


def with_profiles(detected: DataFrame, store: Store) -> DataFrame:
    """Detected sheets with the stored mapping of their header where there is one, and ``from_profile``."""
    known = profiles(store).select(*PROFILE_KEYS, F.col("mapping").alias("_saved"))
    rows = detected.join(known, list(PROFILE_KEYS), "left")
    return rows.withColumns({"from_profile": F.col("_saved").isNotNull(), "mapping": F.coalesce("_saved", "mapping")}).drop("_saved")


def use_profiles(store: Store, batch: str, detected: DataFrame) -> bool:
    """One upload: each sheet whose header is stored counts as one use of it; a new header is stored if the
    detection is sure enough and its required fields are mapped."""
    if store.committed(batch):
        return False
    need = F.create_map(*[x for t, f in REQUIRED.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in f]))])[F.col("document_type")]
    complete = F.coalesce(F.forall(need, lambda f: F.map_contains_key(F.col("mapping"), f)), F.lit(True)) & (F.col("document_type") != "generic")
    rows = with_profiles(detected, store).filter(complete & (F.col("from_profile") | (F.col("confidence") >= SAVED_FROM)))
    seq = F.lit(store.version() + 1).cast("long")
    saved = F.when(~F.col("from_profile"), F.col("mapping"))
    return store.commit(batch, {PROFILES: Change(rows.select(*PROFILE_KEYS, saved.alias("mapping"), "confidence", F.lit(batch).alias("batch"), seq.alias("seq")), PROFILE_KEYS, "append")})
