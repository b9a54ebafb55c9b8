"""Projections, filters and predicates. Pure, lazy DataFrame functions; every date
comparison takes an explicit ``as_of``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import contains_any

CLOSED_STATUSES = ("paid", "cancelled")


def _d(as_of: str) -> F.Column:
    return F.lit(as_of).cast("date")


def open_invoices(inv: DataFrame) -> DataFrame:
    """status NOT IN ('paid','cancelled'); NULL status is dropped (three-valued logic)."""
    return inv.filter(~F.col("status").isin(*CLOSED_STATUSES))


def overdue_invoices(inv: DataFrame, as_of: str) -> DataFrame:
    return open_invoices(inv).filter(F.col("due_date") < _d(as_of))


def due_within(inv: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    return open_invoices(inv).filter(F.col("due_date").between(_d(as_of), F.date_add(_d(as_of), days)))


def recent_transactions(txn: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Transactions on or after as_of - days (no upper bound, as in the reference)."""
    return txn.filter(F.col("transaction_date") >= F.date_sub(_d(as_of), days))


def payment_schedule(inv: DataFrame) -> DataFrame:
    return (inv.filter(~F.lower(F.col("status")).isin("paid", "cancelled", "void"))
            .select("invoice_number", "supplier", "invoice_date", "due_date", "amount", "status"))


def customer_statement(inv: DataFrame, counterparty: str) -> DataFrame:
    """Case-insensitive substring match on the counterparty."""
    return (inv.filter(F.lower(F.col("supplier")).contains(counterparty.lower()))
            .select("invoice_number", "supplier", "invoice_date", "due_date", "amount", "status"))


def marketing_records_filter(classified: DataFrame) -> DataFrame:
    """Marketing mart rows: account 6150 or a marketing word in the description."""
    d = F.lower(F.coalesce(F.col("description"), F.lit("")))
    return classified.filter((F.col("c_account_code") == "6150") | contains_any(d, R.MARKETING_DESCRIPTION_TOKENS))


def marketing_invoices(classified: DataFrame, compat: bool = False) -> DataFrame:
    """Account 6150 marketing spend. Default keeps approved rows only; ``compat`` reproduces the
    reference's ``NOT IN ('review','pending')`` test, which never excludes ``needs_review``."""
    base = classified.filter(F.col("c_account_code") == "6150")
    if compat:
        return base.filter(~F.coalesce(F.col("c_validation"), F.lit("")).isin("review", "pending"))
    return base.filter(F.col("c_validation") == "approved")


def position_bucket(al: DataFrame) -> DataFrame:
    n = F.lower(F.col("name"))
    cat, cls = F.col("category"), F.col("classification")
    label = (F.when((cat == "asset") & n.contains("cash"), "Cash")
             .when((cat == "asset") & n.contains("receivable"), "Receivables")
             .when((cat == "asset") & n.contains("inventory"), "Inventory")
             .when((cat == "asset") & (cls == "current"), "Other current assets")
             .when(cat == "asset", "Non-current assets")
             .when((cat == "liability") & (cls == "current"), "Current liabilities")
             .when(cat == "liability", "Non-current liabilities")
             .otherwise("Other"))
    return al.withColumn("label", label)


POSITION_ORDER = ("Cash", "Receivables", "Inventory", "Other current assets", "Non-current assets",
                  "Current liabilities", "Non-current liabilities", "Other")


def position_class_ledger(tb: DataFrame, compat: bool = False) -> DataFrame:
    """Ledger position flags. ``compat`` reproduces the reference's substring test that also counts a
    'non-current liability' subtype as current (SURVEY Q2); the default excludes it."""
    t, s, n = F.col("account_type"), F.lower(F.col("subtype")), F.lower(F.col("name"))
    cur_liab = s.contains("current") if compat else (s.contains("current") & ~s.contains("non-current"))
    return tb.withColumns({
        "is_current_asset": (t == "asset") & s.contains("current") & ~s.contains("non-current"),
        "is_current_liability": (t == "liability") & cur_liab,
        "is_inventory": (t == "asset") & n.contains("inventory"),
        "is_cash": (t == "asset") & (n.contains("cash") | n.contains("bank")),
    })


def register_search(df: DataFrame, cols: Sequence[str], query: str, state_col: str | None = None,
                    state: str | None = None) -> DataFrame:
    """Free-text contains over the concatenated columns, plus an optional state filter."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    out = df.filter(text.contains(query.lower())) if query else df
    if state_col and state and state != "all":
        out = out.filter(F.col(state_col) == state)
    return out


def signal_tiering(sig: DataFrame) -> DataFrame:
    r = F.coalesce(F.col("relevance_score"), F.lit(0.0))
    return sig.withColumn("tier", F.when(r >= 0.75, "high").when(r >= 0.4, "medium").otherwise("watch"))


def _blank_null(c: str) -> F.Column:
    return F.nullif(F.col(c), F.lit(""))


def signal_alert_status(sig: DataFrame) -> DataFrame:
    """Alert card per signal: critical at relevance >= 0.85, else watch; text fallbacks."""
    r = F.coalesce(F.col("relevance_score"), F.lit(0.0))
    linked = F.concat(F.lit("Linked to "), F.coalesce(_blank_null("entity"), _blank_null("geography"),
                                                      F.lit("company context")), F.lit("."))
    return sig.select(
        "id", F.coalesce(_blank_null("topic"), _blank_null("signal_type"), F.lit("Uploaded market signal")).alias("name"),
        F.when(r >= 0.85, "critical").otherwise("watch").alias("status"),
        F.coalesce(_blank_null("estimated_impact"), linked).alias("impact"),
        F.coalesce(_blank_null("source_url"), F.lit("")).alias("url"),
        F.coalesce(_blank_null("source_name"), F.lit("uploaded market file")).alias("source"),
        F.col("relevance_score"))


OFFICIAL_DOMAINS = ("ato.gov.au", "business.gov.au")


def official_domain_filter(df: DataFrame, domains: Sequence[str] = OFFICIAL_DOMAINS, url_col: str = "url") -> DataFrame:
    """Rows whose URL host equals an allowed domain or is a subdomain of one."""
    host = F.lower(F.parse_url(F.col(url_col), F.lit("HOST")))
    cond = F.lit(False)
    for d in domains:
        d = d.lower()
        cond = cond | (host == d) | host.endswith("." + d)
    return df.filter(cond)
