"""What uploaded files prove: their set of document types, coverage of the document catalogue, findings of each
file, the date a file speaks for, and evidence for tax schemes (SURVEY 2.4, 2.8 and 2.13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions.expr import first_keyword_class
from . import aggregates as AG

# FIXED VALUES: the document catalogue (type, intake category, tier)
CATALOGUE = (
    ("balance_sheet", "setup", "required"),
    ("profit_loss", "setup", "required"),
    ("cash_flow_statement", "setup", "required"),
    ("chart_of_accounts", "setup", "required"),
    ("business_requirements", "setup", "required"),
    ("fixed_asset_register", "setup", "recommended"),
    ("aged_debtors_creditors", "setup", "recommended"),
    ("material_contracts", "setup", "recommended"),
    ("sales_forecast", "setup", "recommended"),
    ("personnel_plan", "setup", "recommended"),
    ("use_cases_user_stories", "setup", "recommended"),
    ("historical_tax_returns", "setup", "recommended"),
    ("supplier_invoices", "recurring", "operational"),
    ("bank_statements", "recurring", "operational"),
    ("sales_invoices", "recurring", "operational"),
    ("payroll", "recurring", "operational"),
)
# FIXED VALUES: types that count as another one
TYPE_ALIASES = {
    "invoices": "supplier_invoices",
    "assets": "balance_sheet",
    "liabilities": "balance_sheet",
    "assets_liabilities": "balance_sheet",
    "transactions": "bank_statements",
    "budgets": "sales_forecast",
    "contracts": "material_contracts",
}
# FIXED VALUES: types that prove nothing, by where they were recorded
STORED_VAGUE = ("profiling", "mixed_business_workbook", "generic")
DETECTED_VAGUE = ("profiling", "generic")
DECLARED_VAGUE = ("auto",)

# FIXED VALUES: month names of file names
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

# FIXED VALUES: tax schemes (id, title, category)
SCHEMES = (
    ("instant_asset_write_off", "$20,000 instant asset write-off", "Assets"),
    ("simplified_depreciation", "Simplified depreciation and small-business pool", "Assets"),
    ("prepaid_expenses", "Immediate deduction for qualifying prepayments", "Deductions"),
    ("trading_stock", "Simplified trading-stock rules", "Inventory"),
    ("rdti", "Research and Development Tax Incentive", "Innovation"),
    ("employee_costs", "Salary, wage and super deductions", "People"),
    ("cgt_concessions", "Four small-business CGT concessions", "Capital gains"),
    ("gst_credits", "GST credits and adjustments", "GST"),
    ("government_programs", "Government grants and programs finder", "Funding"),
)

#: Counterparties and positions named in a finding.
NAMED = 4


def canonical_type(x: Column) -> Column:
    """Lower-cased type name with its alias resolved; a null stays null."""
    name = F.lower(F.trim(x))
    return reduce(lambda e, kv: e.when(name == kv[0], F.lit(kv[1])), TYPE_ALIASES.items(), F.when(F.lit(False), name)).otherwise(name)


def type_set(stored: Column, detected: Column, analysed: Column, declared: Column) -> Column:
    """Sorted distinct types an upload is known under: stored, detected (an array), analysed and declared ones,
    without those that prove nothing. Nulls and blanks add nothing; no type gives an empty array."""
    def told(x: Column, vague) -> Column:
        t = canonical_type(x)
        return F.when((t != "") & ~t.isin(*vague), t)

    listed = F.transform(F.coalesce(detected, F.array().cast("array<string>")), lambda x: told(x, DETECTED_VAGUE))
    single = F.array(told(stored, STORED_VAGUE), told(analysed, DETECTED_VAGUE), told(declared, DECLARED_VAGUE))
    return F.array_sort(F.array_distinct(F.filter(F.concat(single, listed), lambda x: x.isNotNull())))


def with_types(uploads: DataFrame) -> DataFrame:
    """``types``: what each upload is known under; ``intended``: the same, or the type its name hints at if there is none."""
    signal = F.regexp_replace(F.lower(F.coalesce("filename", F.lit(""))), "[^a-z0-9]+", "_")
    hint = first_keyword_class(signal, R.FILENAME_HINT_RULES, "")
    types = type_set(F.col("document_type"), F.col("detected_types"), F.col("analysed_type"), F.col("declared_type"))
    found = uploads.withColumn("types", types)
    hinted = F.when(hint != "", F.array(hint)).otherwise(F.array().cast("array<string>"))
    return found.withColumn("intended", F.when(F.size("types") > 0, F.col("types")).otherwise(hinted))


def coverage_by_catalogue(uploads: DataFrame) -> DataFrame:
    """Per company and document of the catalogue, over all its uploads of the same intake category.

    ``file_count``: complete uploads, ``retry_count``: the others, ``attempt_count``: both, with types hinted at by
    file names; ``state`` is received, needs_retry or missing. ``covered``: a complete upload is known under the
    type without a hint, which is what readiness counts. Uploads without a category are recurring; every company
    with an upload gets all documents. One partial aggregate over the uploads; the catalogue is a literal.
    """
    done = F.col("processing_status").isin(*R.COMPLETE_UPLOAD_STATUSES)
    category = F.when(F.coalesce("intake_category", F.lit("")) == "", "recurring").otherwise(F.col("intake_category"))
    each = with_types(uploads).select(
        "company_id", category.alias("intake_category"), F.coalesce(done, F.lit(False)).alias("done"), "types",
        F.explode_outer("intended").alias("id"))
    counts = each.groupBy("company_id", "intake_category", "id").agg(
        F.count("*").alias("attempts"), F.count(F.when(F.col("done"), 1)).alias("files"),
        F.max(F.col("done") & F.array_contains("types", F.col("id"))).alias("known"))
    listed = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("intake_category"), F.lit(t).alias("tier")) for i, c, t in CATALOGUE])
    wanted = counts.select("company_id").distinct().select("company_id", F.inline(listed))
    found = wanted.join(counts, ["company_id", "intake_category", "id"], "left")
    files, attempts = F.coalesce("files", F.lit(0)), F.coalesce("attempts", F.lit(0))
    return found.select(
        "company_id", "id", "intake_category", "tier", (files > 0).alias("received"), files.alias("file_count"),
        attempts.alias("attempt_count"), (attempts - files).alias("retry_count"),
        F.when(files > 0, "received").when(attempts > files, "needs_retry").otherwise("missing").alias("state"),
        F.coalesce("known", F.lit(False)).alias("covered"))


def effective_date(filename: Column, candidates: list[Column], processed: Column) -> Column:
    """ISO date a file speaks for: the first candidate that starts like a date, else YYYYMMDD, "Month YYYY" (the
    month earliest in the year if there are several), "FY YYYY" (30 June) in its name, else the day it was processed."""
    given = [F.regexp_extract(F.trim(c), r"^(\d{4}-\d{2}-\d{2})", 1) for c in candidates]
    day = r"(20\d{2})[ _.-]?(0[1-9]|1[0-2])[ _.-]?([0-3]\d)"
    stamped = F.concat_ws("-", *[F.nullif(F.regexp_extract(filename, day, g), F.lit("")) for g in (1, 2, 3)])
    spaced = F.translate(filename, "_-", "  ")
    names = F.array(*[F.lit(m.lower()) for m in MONTHS])
    said = F.regexp_extract_all(spaced, F.lit(r"(?i)\b(" + "|".join(MONTHS) + r")\s+20\d{2}\b"), F.lit(0))
    dated = F.transform(said, lambda s, i: F.struct(
        F.array_position(names, F.lower(F.regexp_extract(s, "^([A-Za-z]+)", 1))).alias("m"), i.alias("at"), F.substring(s, -4, 4).alias("y")))
    first = F.array_min(dated)
    month = F.when(F.size(said) > 0, F.concat(first["y"], F.lit("-"), F.lpad(first["m"].cast("string"), 2, "0"), F.lit("-01")))
    year = F.regexp_extract(spaced, r"(?i)FY\s?(20\d{2})", 1)
    tried = [F.nullif(x, F.lit("")) for x in (*given, stamped)]
    return F.coalesce(*tried, month, F.when(year != "", F.concat(year, F.lit("-06-30"))), F.date_format(processed, "yyyy-MM-dd"))


def file_findings(rows: DataFrame) -> DataFrame:
    """Findings of every file: rows, total, tax, inflow and outflow, distinct counterparties (count and the first
    four by name) and the four largest positions (by size, ties by name).

    ``rows`` has company_id, file_id, document_type, name, party, amount, tax; null amounts count as zero, blank
    parties and names are not named. The files' ranks keep four rows a file in each task before the shuffle, so
    a file of any size is never collected.
    """
    key = ["company_id", "file_id", "document_type"]
    amount = F.coalesce("amount", F.lit(0)).cast("decimal(18,2)")
    totals = rows.groupBy(*key).agg(
        F.count("*").alias("rows"), F.sum(amount).alias("total"), F.sum(F.coalesce("tax", F.lit(0)).cast("decimal(18,2)")).alias("tax"),
        AG.sum_when(amount > 0, amount).alias("inflow"), AG.sum_when(amount < 0, -amount).alias("outflow"))
    party = F.trim(F.col("party"))
    parties = rows.filter(party != "").select(*key, party.alias("party")).distinct()
    named = _first_of(parties, key, "party", [F.col("party")], "counterparties")
    counted = parties.groupBy(*key).agg(F.count("*").alias("parties"))
    items = rows.filter(F.trim("name") != "").select(*key, F.col("name"), F.abs(amount).alias("size"))
    largest = _first_of(items.withColumn("item", F.concat(F.col("name"), F.lit("="), F.col("size").cast("string"))), key, "item",
                        [F.col("size").desc(), F.col("name")], "positions")
    found = reduce(lambda a, b: a.join(b, key, "left"), (named, counted, largest), totals)
    return found.withColumn("parties", F.coalesce("parties", F.lit(0)))


def _first_of(rows: DataFrame, key: list[str], column: str, order: list[Column], name: str) -> DataFrame:
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("place") <= NAMED)
    listed = F.array_sort(F.collect_list(F.struct("place", column)))
    return ranked.groupBy(*key).agg(F.array_join(F.transform(listed, lambda x: x[column]), ", ").alias(name))


def scheme_signals(classified: DataFrame, inventory: DataFrame, payroll: DataFrame) -> DataFrame:
    """One row a company: capital invoices, invoices with review-level GST, software spend, stock value, payroll rows.
    Each table is aggregated by company first; a company need not be in all three."""
    software = F.lower("c_account_name").contains("software")
    parts = [
        classified.groupBy("company_id").agg(
            F.count(F.when(F.col("c_account_code") == "1500", 1)).alias("capital"), F.count(F.when(F.col("c_tax_code") == "REVIEW", 1)).alias("gst_review"),
            AG.sum_when(software, F.col("amount")).alias("software")),
        inventory.groupBy("company_id").agg(F.sum("total_value").alias("stock")),
        payroll.groupBy("company_id").agg(F.count("*").alias("payroll"))]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    zero = lambda c, t: F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c)
    return together.groupBy("company_id").agg(zero("capital", "bigint"), zero("gst_review", "bigint"), zero("software", "decimal(18,2)"),
                                              zero("stock", "decimal(18,2)"), zero("payroll", "bigint"))


def scheme_evidence(signals: DataFrame) -> DataFrame:
    """Every scheme for every company, with the status that its records support and the figure behind it (null
    where no record bears on the scheme)."""
    status = {
        "employee_costs": F.when(F.col("payroll") > 0, "evidence present").otherwise("missing payroll"),
        "cgt_concessions": F.lit("event dependent"),
        "gst_credits": F.when(F.col("gst_review") > 0, "review now").otherwise("evidence present"),
    }
    figure = {"instant_asset_write_off": "capital", "trading_stock": "stock", "rdti": "software", "employee_costs": "payroll", "gst_credits": "gst_review"}
    listed = F.array(*[F.struct(
        F.lit(i).alias("scheme"), F.lit(title).alias("title"), F.lit(category).alias("category"),
        status.get(i, F.lit("eligibility review")).alias("status"),
        (F.col(figure[i]).cast("string") if i in figure else F.lit(None).cast("string")).alias("evidence")) for i, title, category in SCHEMES])
    return signals.select("company_id", F.inline(listed))
