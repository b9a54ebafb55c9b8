"""Double-entry ledger built from invoices and the opening balance sheet.

Pipeline: invoices -> ``rule_first_match`` (one CASE chain per row, no shuffle) -> ``gst_split``
-> ``invoice_journals`` (one ``posexplode`` of 2-3 lines per invoice) -> ``trial_balance``
(aggregate by account before joining the 47-row chart). Every step is a pure function of its
input DataFrames and parameters, so a "rebuild" is a recompute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import params as P
from ..functions import rules as R
from ..functions.expr import evaluate_once, MONEY, first_keyword_class, normalise_text, out_money

COA_SCHEMA = "code string, name string, account_type string, subtype string, default_tax_code string, active boolean, source string"


def chart_of_accounts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(R.DEFAULT_ACCOUNTS, COA_SCHEMA)


def _account_name_map() -> F.Column:
    items = []
    for code, name, *_ in R.DEFAULT_ACCOUNTS:
        items += [F.lit(code), F.lit(name)]
    return F.create_map(*items)


def _account_type_map() -> F.Column:
    items = []
    for code, _name, account_type, *_ in R.DEFAULT_ACCOUNTS:
        items += [F.lit(code), F.lit(account_type)]
    return F.create_map(*items)


# ----------------------------------------------------------------------------- classification

def rule_first_match(df: DataFrame, rules: list[dict] | None = None, supplier: str = "supplier",
                     description: str = "description", amount: str = "amount", where: F.Column | None = None) -> DataFrame:
    """First matching categorisation rule per row (priority desc, keyword length desc, list order). Rows that
    are not in ``where`` are not looked at: no rule matches them.

    Rules are a bounded list (system + user rules), compiled into one CASE expression that yields
    the rule's position; the rule's attributes come from an array literal. No join, no shuffle.
    Adds: rule_id, keyword, account_code, account_name, account_type, tax_code, confidence, status, reason, source.
    """
    rules = rules if rules is not None else R.rule_rows()
    sn, dn, hay = F.col("_sn"), F.col("_dn"), F.col("_hay")
    idx = None
    for i, r in enumerate(rules):
        kw = F.lit(r["keyword_norm"])
        mt = r["match_type"]
        cond = (sn == kw) if mt == "supplier_exact" else sn.contains(kw) if mt == "supplier_contains" else \
            dn.contains(kw) if mt == "description_contains" else hay.contains(kw)
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
    table = F.array(*[F.struct(
        F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["keyword"]).alias("keyword"),
        F.lit(r["account_code"]).alias("account_code"), F.lit(r["tax_code"]).alias("tax_code"),
        F.lit(R.rule_confidence(r["priority"])).alias("confidence"), F.lit(r.get("source", "system")).alias("source"),
    ) for r in rules])
    hit = F.col("_hit")
    capital = (F.abs(F.col(amount)) >= 1000) & (hit.account_code == "1500")
    conf = F.when(hit.isNull(), F.lit(0.35)).when(capital, F.least(hit.confidence, F.lit(0.9))).otherwise(hit.confidence)
    status = (F.when(hit.isNull(), "needs_review").when(capital, "suggested")
              .when(hit.confidence >= 0.95, "auto_approved").otherwise("suggested"))
    code = F.coalesce(hit.account_code, F.lit("6999"))
    reason = F.when(hit.isNull(), F.lit("No approved supplier or keyword rule matched this invoice.")).otherwise(
        F.concat(F.lit("Matched the saved keyword '"), hit.keyword, F.lit("'."),
                 F.when(capital, F.lit(" Capital treatment and depreciation require review.")).otherwise(F.lit(""))))
    only = (lambda x: x) if where is None else (lambda x: F.when(where, x))
    staged = (df.withColumns({"_sn": only(normalise_text(F.col(supplier))), "_dn": only(normalise_text(F.col(description)))})
              .withColumn("_hay", only(F.trim(F.concat_ws(" ", sn, dn))))
              .withColumn("_hit", F.get(table, evaluate_once(only(idx)))))
    return staged.withColumns({
        "rule_id": hit.rule_id,
        "keyword": hit.keyword,
        "c_account_code": code,
        "c_tax_code": F.coalesce(hit.tax_code, F.lit("REVIEW")),
        "c_confidence": conf,
        "c_status": status,
        "c_reason": reason,
        "c_source": F.coalesce(hit.source, F.lit("fallback")),
    }).drop("_sn", "_dn", "_hay", "_hit")


def classify_invoices(inv: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Supplier invoices by rule; sales invoices go to 4000 Sales revenue (auto-approved), whatever their text."""
    sales = F.col("invoice_kind") == "sales"
    c = rule_first_match(inv, rules, where=F.coalesce(~sales, F.lit(True)))
    manual = (F.col("validation_status") == "approved") & F.col("account_code").isNotNull() & ~sales
    code = F.when(sales, "4000").when(manual, F.col("account_code")).otherwise(F.col("c_account_code"))
    status = F.when(sales, "auto_approved").when(manual, "approved").otherwise(F.col("c_status"))
    return c.withColumns({
        "c_account_code": code,
        "c_tax_code": F.when(sales | manual, F.coalesce("tax_code", F.lit("GST"))).otherwise(F.col("c_tax_code")),
        "c_confidence": F.when(sales, F.lit(0.99)).when(manual, F.lit(1.0)).otherwise(F.col("c_confidence")),
        "c_status": status,
        "c_reason": F.when(sales, "Sales invoice routed to sales revenue.").otherwise(F.col("c_reason")),
        "rule_id": F.when(sales | manual, F.lit(None)).otherwise(F.col("rule_id")),
        "keyword": F.when(sales | manual, F.lit(None)).otherwise(F.col("keyword")),
        "c_account_name": _account_name_map()[code],
        "c_account_type": _account_type_map()[code],
        "c_validation": F.when(status.isin("auto_approved", "approved"), "approved").otherwise("needs_review"),
    })


def gst_split(df: DataFrame, gst_registered: bool = P.GST_REGISTERED) -> DataFrame:
    """Explicit GST wins; else registered and tax code GST -> total/11; else 0. Adds total, gst, net."""
    total = F.abs(F.col("amount")).cast(MONEY)
    explicit = F.abs(F.coalesce(F.col("gst_amount"), F.lit(0)))
    gst = (F.when(explicit > 0, explicit)
           .when(F.lit(gst_registered) & (F.col("c_tax_code") == "GST"), F.round(total / 11, 2))
           .otherwise(F.lit(0))).cast(MONEY)
    df = df.withColumns({"total": total, "gst": gst})
    net = F.when(explicit > 0, F.coalesce(F.nullif(F.abs(F.col("subtotal")), F.lit(0)),
                                          F.greatest(F.col("total") - F.col("gst"), F.lit(0))))\
        .otherwise(F.col("total") - F.col("gst"))
    return df.withColumn("net", net.cast(MONEY))


# ----------------------------------------------------------------------------- journals

def _line(n, code, debit, credit, tax) -> F.Column:
    return F.struct(F.lit(n).alias("line_number") if isinstance(n, int) else n.alias("line_number"),
                    code.alias("account_code"), debit.cast(MONEY).alias("debit"),
                    credit.cast(MONEY).alias("credit"), tax.alias("tax_code"))


def invoice_journals(inv: DataFrame, opening_cutoff: str | None = P.OPENING_CUTOFF,
                     gst_registered: bool = P.GST_REGISTERED, rules: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """Invoices -> (entries, lines). Entry status: draft (needs review) / included_in_opening
    (dated on or before the opening balance) / posted. Lines carry their entry's status so the
    trial balance needs no lines-entries join. Each invoice explodes into 2-3 lines; the optional
    GST line is a NULL array element dropped after the explode (no lambda, stays in codegen)."""
    return invoice_journals_from_classified(gst_split(classify_invoices(inv, rules), gst_registered), opening_cutoff)


def invoice_journals_from_classified(g: DataFrame, opening_cutoff: str | None = P.OPENING_CUTOFF) -> tuple[DataFrame, DataFrame]:
    """Journals from invoices that already carry classification and GST split columns."""
    within = F.lit(False) if not opening_cutoff else (F.col("invoice_date") <= F.lit(opening_cutoff).cast("date"))
    g = g.withColumns({
        "entry_status": F.when(F.col("c_validation") != "approved", "draft").when(within, "included_in_opening").otherwise("posted"),
        "journal_id": F.concat(F.lit("je-invoice-"), F.col("id")),
    })
    zero = F.lit(0)
    tax = F.col("c_tax_code")
    has_gst = F.col("gst") != 0
    sales_lines = F.array(
        _line(1, F.lit("1100"), F.col("total"), zero, tax),
        _line(2, F.lit("4000"), zero, F.col("net"), tax),
        F.when(has_gst, _line(3, F.lit("2100"), zero, F.col("gst"), F.lit("GST"))),
    )
    supplier_lines = F.array(
        _line(1, F.col("c_account_code"), F.col("net"), zero, tax),
        F.when(has_gst, _line(2, F.lit("1300"), F.col("gst"), zero, F.lit("GST"))),
        _line(F.when(has_gst, 3).otherwise(2), F.lit("2000"), zero, F.col("total"), tax),
    )
    arr = F.when(F.col("invoice_kind") == "sales", sales_lines).otherwise(supplier_lines)
    lines = (g.select("company_id", "journal_id", "entry_status", "source_file", F.col("supplier").alias("counterparty"),
                      F.explode(arr).alias("l"))
             .filter(F.col("l").isNotNull())
             .select("company_id",
                     F.concat(F.col("journal_id"), F.lit("-"), F.col("l.line_number").cast("string")).alias("id"),
                     "journal_id", F.col("l.line_number").alias("line_number"),
                     F.col("l.account_code").alias("account_code"),
                     _account_name_map()[F.col("l.account_code")].alias("account_name"),
                     F.col("l.debit").alias("debit"), F.col("l.credit").alias("credit"),
                     F.col("l.tax_code").alias("tax_code"), "counterparty", "source_file", "entry_status"))
    entries = g.select(
        "company_id", F.col("journal_id").alias("id"), F.col("invoice_date").alias("entry_date"),
        F.col("invoice_number").alias("reference"),
        F.concat(F.initcap(F.col("invoice_kind")), F.lit(" invoice "), F.col("invoice_number"), F.lit(" · "),
                 F.col("supplier")).alias("description"),
        F.lit("invoice").alias("source_type"), F.col("id").alias("source_id"), F.col("entry_status").alias("status"))
    return entries, lines


def opening_journal(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest balance sheet per company -> opening journal, balanced by an Owner equity line."""
    bs = statements.filter(F.col("statement_type") == "balance_sheet")
    latest = bs.groupBy("company_id").agg(F.max("period_end").alias("period_end"))
    rows = bs.join(latest, ["company_id", "period_end"], "left_semi").filter(F.abs("amount") >= 0.005)
    nl = normalise_text(F.col("line_item"))
    mapped = first_keyword_class(nl, [(code, toks) for toks, code in R.OPENING_ACCOUNT_RULES], None)
    w = Window.partitionBy("company_id").orderBy("line_item")
    det = rows.select(
        "company_id", "period_end",
        F.row_number().over(w).alias("line_number"),
        F.coalesce(mapped, F.when(F.col("amount") >= 0, "1190").otherwise("2290")).alias("account_code"),
        F.when(F.col("amount") >= 0, F.abs("amount")).otherwise(F.lit(0)).cast(MONEY).alias("debit"),
        F.when(F.col("amount") < 0, F.abs("amount")).otherwise(F.lit(0)).cast(MONEY).alias("credit"),
        F.col("line_item").alias("counterparty"), "source_file",
        mapped.isNotNull().alias("mapped"))
    diff = F.col("d") - F.col("c")
    bal = (det.groupBy("company_id", "period_end")
           .agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.max("line_number").alias("n"))
           .filter(F.abs(diff) >= 0.005)
           .select("company_id", "period_end", (F.col("n") + 1).alias("line_number"), F.lit("3000").alias("account_code"),
                   F.when(diff > 0, F.lit(0)).otherwise(F.abs(diff)).cast(MONEY).alias("debit"),
                   F.when(diff > 0, diff).otherwise(F.lit(0)).cast(MONEY).alias("credit"),
                   F.lit("Opening equity").alias("counterparty"), F.lit("Opening balance sheet").alias("source_file"),
                   F.lit(True).alias("mapped")))
    all_lines = det.unionByName(bal)
    lines = all_lines.select(
        "company_id", F.concat(F.lit("je-opening-balance-"), F.col("line_number").cast("string")).alias("id"),
        F.lit("je-opening-balance").alias("journal_id"), "line_number", "account_code",
        _account_name_map()[F.col("account_code")].alias("account_name"), "debit", "credit",
        F.lit("N-T").alias("tax_code"), "counterparty", "source_file", F.lit("posted").alias("entry_status"))
    entries = latest.select(
        "company_id", F.lit("je-opening-balance").alias("id"), F.col("period_end").alias("entry_date"),
        F.concat(F.lit("OPEN-"), F.col("period_end").cast("string")).alias("reference"),
        F.concat(F.lit("Opening balance sheet at "), F.col("period_end").cast("string")).alias("description"),
        F.lit("opening_balance").alias("source_type"), F.col("period_end").cast("string").alias("source_id"),
        F.lit("posted").alias("status"))
    return entries, lines


def ledger(invoices_df: DataFrame, statements: DataFrame, opening_cutoff: str | None = P.OPENING_CUTOFF,
           gst_registered: bool = P.GST_REGISTERED, rules: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    ie, il = invoice_journals(invoices_df, opening_cutoff, gst_registered, rules)
    oe, ol = opening_journal(statements)
    return ie.unionByName(oe), il.unionByName(ol)


def posted_lines(lines: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Lines of posted journals. With ``entries`` a semi-join on the entry status; otherwise the
    status carried on the line (ledgers built here carry it)."""
    if entries is not None:
        return lines.join(entries.filter(F.col("status") == "posted").select(F.col("id").alias("journal_id")),
                          "journal_id", "left_semi")
    return lines.filter(F.col("entry_status") == "posted")


def trial_balance(coa: DataFrame, lines: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Per company that has journal lines: active accounts LEFT JOIN posted-line totals; balance signed
    by account type.

    All lines are read once and aggregated to (company, account) -- map-side partial aggregation --, draft ones
    as well, since they make a company known. A company's totals, at most one for each account, then meet the
    chart as one map, so that neither the companies nor the totals need a second pass.
    """
    if entries is None:
        posted = F.col("entry_status") == "posted"
    else:
        known = entries.filter(F.col("status") == "posted").select(F.col("id").alias("journal_id"), F.lit(True).alias("_posted")).distinct()
        lines, posted = lines.join(known, "journal_id", "left"), F.col("_posted")
    per = lines.groupBy("company_id", "account_code").agg(
        F.sum(F.when(posted, F.col("debit"))).alias("debits"), F.sum(F.when(posted, F.col("credit"))).alias("credits"),
        F.count(F.when(posted, F.col("id"))).alias("posted_lines"))
    total = F.struct("account_code", F.struct("debits", "credits", "posted_lines"))
    company = per.groupBy("company_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("account_code").isNotNull(), total))).alias("_totals"))
    a = coa.filter(F.col("active"))  # each company has the whole chart: a reference table of accounts
    j = company.join(F.broadcast(a)).withColumn("_t", F.when(F.col("company_id").isNotNull(), F.col("_totals")[F.col("code")])).select("*", "_t.*")
    debits = F.coalesce(F.col("debits"), F.lit(0))
    credits = F.coalesce(F.col("credits"), F.lit(0))
    bal = F.when(F.col("account_type").isin("asset", "expense"), debits - credits).otherwise(credits - debits)
    return j.select(
        "company_id", "code", "name", "account_type", "subtype",
        F.col("default_tax_code").alias("tax_code"),
        out_money(debits).alias("debits"), out_money(credits).alias("credits"), out_money(bal).alias("balance"),
        F.coalesce(F.col("posted_lines"), F.lit(0)).cast("bigint").alias("posted_lines"))
