"""Canonical business tables derived from the driver's parquet tables (FIXTURES.md section 3).

Each function returns a lazy DataFrame with the canonical schema of one operational table. The
DuckDB oracle defines the same views in ``finlake.oracle.views``; both sides use exact integer
cents, so money is identical on the two engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import params as P
from ..functions.expr import cents_of, idiv, money_from_cents
from .tables import Tables


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _phrase(index_col: F.Column, phrases) -> F.Column:
    expr = None
    for i, phrase in enumerate(phrases):
        expr = F.when(index_col == i, F.lit(phrase)) if expr is None else expr.when(index_col == i, F.lit(phrase))
    return expr


def _by_key(df: DataFrame) -> DataFrame:
    """A master table that grows with the rows which refer to it: joined by key on both sides. Its compressed files look
    small enough to be broadcast long after its rows are too many to pass through the driver."""
    return df.hint("merge")


def lineitem_net(t: Tables) -> DataFrame:
    """lineitem plus exact integer cents: price_cents and net_cents (after discount, HALF_UP)."""
    li = t.lineitem
    price = cents_of("l_extendedprice")
    disc = cents_of("l_discount")
    return li.withColumn("price_cents", price).withColumn("net_cents", idiv(price * (F.lit(100) - disc) + 50, 100))


def sales_invoices(t: Tables) -> DataFrame:
    o, c = t.orders, t.customer
    d = F.to_date("o_orderdate")
    return (o.join(_by_key(c), o.o_custkey == c.c_custkey)
            .select(
                F.lit(P.COMPANY).alias("company_id"),
                F.concat(F.lit("so-"), _s("o_orderkey")).alias("id"),
                F.concat(F.lit("INV-"), _s("o_orderkey")).alias("invoice_number"),
                F.col("c_name").alias("supplier"),
                d.alias("invoice_date"),
                F.date_add(d, 30).alias("due_date"),
                money_from_cents(cents_of("o_totalprice")).alias("amount"),
                F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "due")
                 .otherwise("review").alias("status"),
                F.concat(F.lit("sales_invoices_"), _s(F.year(d)), F.lit(".csv")).alias("source_file"),
                F.lit("sales").alias("invoice_kind"),
                F.lit(P.CURRENCY).alias("currency"),
                F.lit(None).cast("decimal(18,2)").alias("subtotal"),
                F.lit(None).cast("decimal(18,2)").alias("gst_amount"),
                F.concat(F.lit("Order "), F.col("o_orderpriority")).alias("description"),
                F.lit(None).cast("string").alias("tax_code"),
                F.lit(None).cast("string").alias("account_code"),
                F.lit("imported").alias("validation_status"),
                F.lit(None).cast("string").alias("sku"),
                F.lit(None).cast("double").alias("quantity"),
            ))


def supplier_invoices(t: Tables) -> DataFrame:
    li = (lineitem_net(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                               "l_linestatus", "l_shipdate", "price_cents", "net_cents"))
    s, p = t.supplier, t.part
    d = F.to_date("l_shipdate")
    return (li.join(s, li.l_suppkey == s.s_suppkey).join(_by_key(p), li.l_partkey == p.p_partkey)
            .select(
                F.lit(P.COMPANY).alias("company_id"),
                F.concat_ws("-", F.lit("bl"), _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"),
                            _s("l_suppkey"), _s("price_cents")).alias("id"),
                F.concat(F.lit("BILL-"), _s("l_orderkey"), F.lit("-"), _s("l_linenumber")).alias("invoice_number"),
                F.col("s_name").alias("supplier"),
                d.alias("invoice_date"),
                F.date_add(d, 45).alias("due_date"),
                money_from_cents("net_cents").alias("amount"),
                F.when(F.col("l_linestatus") == "F", "paid").otherwise("due").alias("status"),
                F.concat(F.lit("supplier_invoices_"), _s(F.year(d)), F.lit(".csv")).alias("source_file"),
                F.lit("supplier").alias("invoice_kind"),
                F.lit(P.CURRENCY).alias("currency"),
                F.lit(None).cast("decimal(18,2)").alias("subtotal"),
                F.lit(None).cast("decimal(18,2)").alias("gst_amount"),
                F.concat(F.col("p_name"), F.lit(" "),
                         _phrase(F.pmod(F.col("l_partkey"), F.lit(len(P.DESCRIPTION_PHRASES))), P.DESCRIPTION_PHRASES)
                         ).alias("description"),
                F.lit(None).cast("string").alias("tax_code"),
                F.lit(None).cast("string").alias("account_code"),
                F.lit("imported").alias("validation_status"),
                F.concat(F.lit("SKU-"), _s("l_partkey")).alias("sku"),
                F.col("l_quantity").alias("quantity"),
            ))


def invoices(t: Tables) -> DataFrame:
    return sales_invoices(t).unionByName(supplier_invoices(t))


def transactions(t: Tables) -> DataFrame:
    """Customer receipts (finished orders, +) and supplier payments (finished lines, -)."""
    o = t.orders.filter(F.col("o_orderstatus") == "F")
    od = F.to_date("o_orderdate")
    receipts = o.select(
        F.lit(P.COMPANY).alias("company_id"),
        F.concat(F.lit("tx-s-"), _s("o_orderkey")).alias("id"),
        od.alias("transaction_date"),
        F.concat(F.lit("Customer receipt INV-"), _s("o_orderkey")).alias("description"),
        F.lit("sales receipt").alias("category"),
        money_from_cents(cents_of("o_totalprice")).alias("amount"),
        F.lit("imported").alias("status"),
        F.concat(F.lit("transactions_"), _s(F.year(od)), F.lit(".csv")).alias("source_file"),
    )
    li = lineitem_net(t).filter(F.col("l_linestatus") == "F")
    s = t.supplier
    ld = F.to_date("l_shipdate")
    payments = li.join(s, li.l_suppkey == s.s_suppkey).select(
        F.lit(P.COMPANY).alias("company_id"),
        F.concat_ws("-", F.lit("tx-p"), _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"),
                    _s("l_suppkey"), _s("price_cents")).alias("id"),
        ld.alias("transaction_date"),
        F.concat(F.col("s_name"), F.lit(" INV-"), _s("l_orderkey")).alias("description"),
        F.lit("supplier payment").alias("category"),
        money_from_cents(-F.col("net_cents")).alias("amount"),
        F.lit("imported").alias("status"),
        F.concat(F.lit("transactions_"), _s(F.year(ld)), F.lit(".csv")).alias("source_file"),
    )
    return receipts.unionByName(payments)


def bank_transactions(t: Tables) -> DataFrame:
    """Every order paid through the bank; +1 cent when key % 7 = 0, +5.00 when key % 11 = 0."""
    o, c = t.orders, t.customer
    d = F.date_add(F.to_date("o_orderdate"), 2)
    k = F.col("o_orderkey")
    cents = (cents_of("o_totalprice") + F.when(F.pmod(k, F.lit(7)) == 0, 1).otherwise(0)
             + F.when(F.pmod(k, F.lit(11)) == 0, 500).otherwise(0))
    return o.join(_by_key(c), o.o_custkey == c.c_custkey).select(
        F.lit(P.COMPANY).alias("company_id"),
        F.concat(F.lit("bk-"), _s(k)).alias("id"),
        d.alias("transaction_date"),
        F.concat(F.lit("Payment INV-"), _s(k), F.lit(" "), F.col("c_name"), F.lit(" "),
                 _phrase(F.pmod(F.col("o_custkey"), F.lit(4)), P.BANK_SEGMENT_PHRASES)).alias("description"),
        F.lit("Operating account").alias("account_name"),
        money_from_cents(cents).alias("amount"),
        F.lit(None).cast("decimal(18,2)").alias("balance"),
        F.lit(P.CURRENCY).alias("currency"),
        F.lit("imported").alias("status"),
        F.concat(F.lit("bank_"), _s(F.year(d)), F.lit(".csv")).alias("source_file"),
    )


def statement_snapshots(t: Tables) -> DataFrame:
    """P&L per ship/order year and balance sheets at 1995-12-31 and 1996-12-31 (signed amounts)."""
    li = lineitem_net(t).select(
        F.year("l_shipdate").alias("y"), "l_returnflag", "l_linestatus", "net_cents")
    o = t.orders.select(F.year("o_orderdate").alias("y"), "o_orderstatus", cents_of("o_totalprice").alias("tc"))

    def agg_lines(df, cents, rules):
        exprs = [F.sum(F.when(cond, cents).otherwise(0)).cast("bigint").alias(name) for name, cond in rules]
        return df.groupBy("y").agg(*exprs)

    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    pl_costs = agg_lines(li, F.col("net_cents"), [
        ("Cost of goods sold", rf == "N"),
        ("Wages and salaries", (rf == "R") & (ls == "F")),
        ("Rent and occupancy", (rf == "R") & (ls == "O")),
        ("Interest expense", (rf == "A") & (ls == "F")),
        ("Income tax expense", (rf == "A") & (ls == "O")),
    ])
    pl_rev = o.groupBy("y").agg(F.sum("tc").cast("bigint").alias("Sales revenue"))
    pl = pl_rev.join(pl_costs, "y", "full").select(
        F.coalesce(pl_rev.y, pl_costs.y).alias("y"),
        F.stack(F.lit(6),
                F.lit("Sales revenue"), F.coalesce(F.col("`Sales revenue`"), F.lit(0)),
                F.lit("Cost of goods sold"), -F.coalesce(F.col("`Cost of goods sold`"), F.lit(0)),
                F.lit("Wages and salaries"), -F.coalesce(F.col("`Wages and salaries`"), F.lit(0)),
                F.lit("Rent and occupancy"), -F.coalesce(F.col("`Rent and occupancy`"), F.lit(0)),
                F.lit("Interest expense"), -F.coalesce(idiv(F.col("`Interest expense`"), F.lit(10)), F.lit(0)),
                F.lit("Income tax expense"), -F.coalesce(idiv(F.col("`Income tax expense`"), F.lit(10)), F.lit(0)),
                ).alias("line_item", "cents"),
    ).withColumn("statement_type", F.lit("profit_loss"))

    bs_o = o.filter(F.col("y").isin(1995, 1996)).groupBy("y").agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("tc")).otherwise(0)).cast("bigint").alias("cash"),
        F.sum(F.when(F.col("o_orderstatus") == "O", F.col("tc")).otherwise(0)).cast("bigint").alias("ar"),
        F.sum(F.when(F.col("o_orderstatus") == "P", idiv(F.col("tc"), F.lit(11))).otherwise(0)).cast("bigint").alias("gst"),
    )
    bs_l = li.filter(F.col("y").isin(1995, 1996)).groupBy("y").agg(
        F.sum(F.when(rf == "R", F.col("net_cents")).otherwise(0)).cast("bigint").alias("inv"),
        F.sum(F.when(rf == "A", F.col("net_cents")).otherwise(0)).cast("bigint").alias("ppe"),
        F.sum(F.when((rf == "N") & (ls == "O"), F.col("net_cents")).otherwise(0)).cast("bigint").alias("ap"),
        F.sum(F.when((rf == "N") & (ls == "F"), F.col("net_cents")).otherwise(0)).cast("bigint").alias("loan"),
    )
    bs = bs_o.join(bs_l, "y", "full").select(
        "y",
        F.stack(F.lit(7),
                F.lit("Cash at bank"), F.coalesce("cash", F.lit(0)),
                F.lit("Accounts receivable"), F.coalesce("ar", F.lit(0)),
                F.lit("Inventory"), F.coalesce("inv", F.lit(0)),
                F.lit("Plant and equipment"), F.coalesce("ppe", F.lit(0)),
                F.lit("Accounts payable"), -F.coalesce("ap", F.lit(0)),
                F.lit("Loans payable"), -F.coalesce("loan", F.lit(0)),
                F.lit("GST payable"), -F.coalesce("gst", F.lit(0)),
                ).alias("line_item", "cents"),
    ).withColumn("statement_type", F.lit("balance_sheet"))

    both = pl.unionByName(bs)
    y = F.col("y").cast("string")
    return both.select(
        F.lit(P.COMPANY).alias("company_id"),
        F.concat_ws("-", F.lit("st"), F.col("statement_type"), y,
                    F.regexp_replace(F.lower("line_item"), "[^a-z0-9]+", "_")).alias("id"),
        "statement_type",
        F.to_date(F.concat(y, F.lit("-01-01"))).alias("period_start"),
        F.to_date(F.concat(y, F.lit("-12-31"))).alias("period_end"),
        "line_item",
        money_from_cents("cents").alias("amount"),
        F.lit(P.CURRENCY).alias("currency"),
        F.concat(F.col("statement_type"), F.lit("_"), y, F.lit(".xlsx")).alias("source_file"),
    )


CURRENT_LABELS = ("Cash at bank", "Accounts receivable", "Inventory", "Accounts payable", "GST payable")


def assets_liabilities(t: Tables) -> DataFrame:
    """Latest balance sheet as the asset/liability register (positive amounts, class by label)."""
    st = statement_snapshots(t).filter(F.col("statement_type") == "balance_sheet")
    latest = st.groupBy("company_id").agg(F.max("period_end").alias("period_end"))
    cur = st.join(latest, ["company_id", "period_end"], "left_semi")
    return cur.select(
        "company_id",
        F.concat(F.lit("al-"), F.regexp_replace(F.lower("line_item"), "[^a-z0-9]+", "-")).alias("id"),
        F.col("line_item").alias("name"),
        F.when(F.col("amount") >= 0, "asset").otherwise("liability").alias("category"),
        F.when(F.col("line_item").isin(*CURRENT_LABELS), "current").otherwise("non-current").alias("classification"),
        F.abs("amount").alias("amount"),
        F.lit("imported").alias("status"),
        "source_file",
    )


def inventory(t: Tables) -> DataFrame:
    """One stock line per part; quantity = units shipped up to the stock-count date."""
    li = t.lineitem.filter(F.to_date("l_shipdate") <= F.lit(P.STOCK_CUTOFF).cast("date"))
    q = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"))
    p = t.part
    j = p.join(q, p.p_partkey == q.l_partkey, "left")
    qty = F.coalesce(F.col("qty"), F.lit(0.0))
    unit_cents = cents_of("p_retailprice")
    return j.select(
        F.lit(P.COMPANY).alias("company_id"),
        F.concat(F.lit("stk-"), _s("p_partkey")).alias("id"),
        F.concat(F.lit("SKU-"), _s("p_partkey")).alias("sku"),
        F.col("p_name").alias("name"),
        qty.alias("quantity"),
        money_from_cents(unit_cents).alias("unit_cost"),
        money_from_cents(F.round(qty * unit_cents).cast("bigint")).alias("total_value"),
        F.concat(F.lit("WH-"), _s(F.pmod("p_size", F.lit(3)))).alias("location"),
        F.lit("active").alias("status"),
        F.lit(P.STOCK_COUNT_FILE).alias("source_file"),
    )


def inventory_movements(t: Tables) -> DataFrame:
    """Every line item moves stock: returns (R) come back in (+), other lines go out (-)."""
    li = lineitem_net(t)
    sign = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0)
    d = F.to_date("l_shipdate")
    return li.select(
        F.lit(P.COMPANY).alias("company_id"),
        F.concat_ws("-", F.lit("mv"), _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"),
                    _s("l_suppkey"), _s("price_cents")).alias("id"),
        d.alias("movement_date"),
        F.concat(F.lit("SKU-"), _s("l_partkey")).alias("sku"),
        F.when(F.col("l_returnflag") == "R", "purchase").otherwise("sale").alias("movement_type"),
        (sign * F.col("l_quantity")).alias("signed_quantity"),
        F.concat(F.lit("BILL-"), _s("l_orderkey"), F.lit("-"), _s("l_linenumber")).alias("source_invoice"),
        F.concat(F.lit("movements_"), _s(F.year(d)), F.lit(".csv")).alias("source_file"),
    )


def payroll_records(t: Tables) -> DataFrame:
    """Purchase events as pay lines: gross = value x 100 dollars, PAYG 20 %, super 12 % (11.5 % for
    user_id % 5 = 0)."""
    e = t.events.filter(F.col("event_type") == "purchase")
    gross = cents_of("value") * 100
    payg = idiv(gross, F.lit(5))
    sup = F.when(F.pmod("user_id", F.lit(5)) == 0, idiv(gross * 115, F.lit(1000))).otherwise(idiv(gross * 12, F.lit(100)))
    return e.select(
        F.lit(P.COMPANY).alias("company_id"),
        F.concat(F.lit("pay-"), _s("event_id")).alias("id"),
        F.date_format("ts", "yyyy-MM-dd").alias("pay_period"),
        F.concat(F.lit("Employee "), _s("user_id")).alias("employee"),
        money_from_cents(gross).alias("gross_pay"),
        money_from_cents(gross).alias("ordinary_time_earnings"),
        money_from_cents(payg).alias("payg_withholding"),
        money_from_cents(sup).alias("superannuation"),
        money_from_cents(gross - payg).alias("net_pay"),
        F.lit(P.CURRENCY).alias("currency"),
        F.lit("imported").alias("status"),
        F.concat(F.lit("payroll_"), F.date_format("ts", "yyyy_MM"), F.lit(".csv")).alias("source_file"),
    )


def employee_profiles(t: Tables) -> DataFrame:
    users = t.events.filter(F.pmod("user_id", F.lit(10)) != 0).select("user_id").distinct()
    dept = F.pmod("user_id", F.lit(len(P.DEPARTMENTS)))
    return users.select(
        F.lit(P.COMPANY).alias("company_id"),
        F.concat(F.lit("Employee "), _s("user_id")).alias("employee"),
        F.concat(F.lit("EMP-"), F.lpad(_s("user_id"), 4, "0")).alias("employee_code"),
        _phrase(dept, P.DEPARTMENTS).alias("department"),
        F.when(F.pmod("user_id", F.lit(3)) == 0, "Manager").otherwise("Associate").alias("role"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, "full_time").otherwise("part_time").alias("employment_type"),
        F.lit("active").alias("status"),
    )


def market_signals(t: Tables) -> DataFrame:
    s, n = t.supplier, t.nation
    k = F.col("s_suppkey")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.lit(P.COMPANY).alias("company_id"),
        F.concat(F.lit("sig-"), _s(k)).alias("id"),
        _phrase(F.pmod(k, F.lit(4)), P.SIGNAL_TYPES).alias("signal_type"),
        F.concat(F.lower("n_name"), F.lit(" "), _phrase(F.pmod(k, F.lit(4)), P.SIGNAL_TYPES)).alias("topic"),
        F.col("n_name").alias("entity"),
        F.col("n_name").alias("geography"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(k, F.lit(700)).cast("int")).alias("observed_at"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(F.lit("2023-12-01").cast("date"), F.pmod(k, F.lit(500)).cast("int")))
         .alias("published_at"),
        F.concat(idiv(F.abs(cents_of("s_acctbal")), 100000).cast("string"), F.lit(" pts")).alias("value"),
        F.lit("AUD").alias("unit"),
        F.when(F.col("s_acctbal") >= 0, "up").otherwise("down").alias("direction"),
        F.concat(F.lit("source "), _s(F.pmod(k, F.lit(7)))).alias("source_name"),
        F.concat(F.lit("https://source"), _s(F.pmod(k, F.lit(7))), F.lit(".example.com/"), _s(k)).alias("source_url"),
        (F.pmod(k, F.lit(100)) / 100.0).alias("relevance_score"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Impact on "), F.lower("n_name"))).alias("estimated_impact"),
        F.lit("market_context.xlsx").alias("source_file"),
    )


def uploads(t: Tables) -> DataFrame:
    """Upload registry: one uploaded file per document."""
    d = t.documents
    k = F.col("doc_id")
    stem = _phrase(F.pmod(k, F.lit(len(P.UPLOAD_FILE_STEMS))), P.UPLOAD_FILE_STEMS)
    return d.select(
        F.lit(P.COMPANY).alias("company_id"),
        F.concat(F.lit("up-"), _s(k)).alias("upload_id"),
        F.concat(stem, F.lit("_"), _s(k), F.lit(".csv")).alias("filename"),
        F.sha2(F.col("text"), 256).alias("sha256"),
        _phrase(F.pmod(k, F.lit(len(P.UPLOAD_STATUSES))), P.UPLOAD_STATUSES).alias("processing_status"),
        F.when(F.pmod(k, F.lit(2)) == 0, "setup").otherwise("recurring").alias("intake_category"),
        F.col("n_chars").cast("bigint").alias("file_size"),
        F.col("source").alias("source"),
        F.col("lang").alias("lang"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(k, F.lit(365)).cast("int")).alias("created_at"),
    )


def customer_batch_old(t: Tables) -> DataFrame:
    """Customer master as currently stored (one row per customer code)."""
    c = t.customer
    return c.select(
        F.lit(P.COMPANY).alias("company_id"), F.lit("customers").alias("document_type"),
        F.concat(F.lit("C-"), _s("c_custkey")).alias("code"), F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("string").alias("country"), F.col("c_mktsegment").alias("segment"),
        money_from_cents(cents_of("c_acctbal")).alias("balance"), (F.col("c_custkey") * 2).alias("seq"))


def customer_batch_new(t: Tables) -> DataFrame:
    """Next customer upload: balance +1.00 when key % 10 = 0; rows with key % 13 = 0 absent; a
    second, later row (+2.00 more) when key % 17 = 0; new customers 'C-N<key>' when key % 19 = 0."""
    c = t.customer.filter(F.pmod("c_custkey", F.lit(13)) != 0)
    k = F.col("c_custkey")
    base_cents = cents_of("c_acctbal") + F.when(F.pmod(k, F.lit(10)) == 0, 100).otherwise(0)

    def rows(code, cents, seq):
        return F.struct(code.alias("code"), cents.alias("cents"), seq.alias("seq"))

    arr = F.array(
        rows(F.concat(F.lit("C-"), _s(k)), base_cents, k * 2),
        F.when(F.pmod(k, F.lit(17)) == 0, rows(F.concat(F.lit("C-"), _s(k)), base_cents + 200, k * 2 + 1)),
        F.when(F.pmod(k, F.lit(19)) == 0, rows(F.concat(F.lit("C-N"), _s(k)), base_cents, k * 2)),
    )
    e = c.select("c_name", "c_nationkey", "c_mktsegment", F.explode(arr).alias("r")).filter(F.col("r").isNotNull())
    return e.select(
        F.lit(P.COMPANY).alias("company_id"), F.lit("customers").alias("document_type"), F.col("r.code").alias("code"),
        F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("country"),
        F.col("c_mktsegment").alias("segment"), money_from_cents(F.col("r.cents")).alias("balance"),
        F.col("r.seq").alias("seq"))


# Wide balance-sheet template layout: (row, label, section or None). Amount cells go in column 1 + year index.
BALANCE_TEMPLATE = (
    (0, "Balance sheet", None), (3, "Current assets", "section"), (4, "Cash at bank", None),
    (5, "Accounts receivable", None), (6, "Inventory", None), (7, "Fixed assets", "section"),
    (8, "Plant and equipment", None), (9, "Total assets", None), (10, "Current liabilities", "section"),
    (11, "Accounts payable", None), (12, "GST payable", None), (13, "Long term liabilities", "section"),
    (14, "Loans payable", None), (15, "Total liabilities", None),
)


def balance_sheet_cells(t: Tables) -> DataFrame:
    """The balance sheets rendered as one wide workbook sheet per company, as long cells
    (file_id, sheet, row, col, value): title, a header row of period-end dates, section rows, line
    rows with amounts as text ("1,234.56"), and total rows."""
    st = statement_snapshots(t).filter(F.col("statement_type") == "balance_sheet")
    years = st.select("company_id", "period_end").distinct()
    w = Window.partitionBy("company_id").orderBy("period_end")
    cols = years.withColumn("col", F.row_number().over(w))
    layout = F.create_map(*[x for r, lab, _ in BALANCE_TEMPLATE for x in (F.lit(lab), F.lit(r))])
    lines = st.join(cols, ["company_id", "period_end"]).select(
        "company_id", layout[F.col("line_item")].alias("row"), "col",
        F.format_number(F.abs("amount"), 2).alias("value"))
    asset_rows = ("Cash at bank", "Accounts receivable", "Inventory", "Plant and equipment")
    totals = st.join(cols, ["company_id", "period_end"]).groupBy("company_id", "col").agg(
        F.sum(F.when(F.col("line_item").isin(*asset_rows), F.abs("amount")).otherwise(0)).alias("ta"),
        F.sum(F.when(~F.col("line_item").isin(*asset_rows), F.abs("amount")).otherwise(0)).alias("tl"))
    total_cells = totals.select("company_id", F.explode(F.array(
        F.struct(F.lit(9).alias("row"), F.format_number("ta", 2).alias("value")),
        F.struct(F.lit(15).alias("row"), F.format_number("tl", 2).alias("value")))).alias("x"), "col").select(
        "company_id", "x.row", "col", "x.value")
    header = cols.select("company_id", F.lit(2).alias("row"), "col", F.date_format("period_end", "yyyy-MM-dd").alias("value"))
    labels = years.select("company_id").distinct().select(
        "company_id", F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(lab).alias("value"))
                                          for r, lab, _ in BALANCE_TEMPLATE] +
                                        [F.struct(F.lit(2).alias("row"), F.lit("Line item").alias("value"))])).alias("x")
    ).select("company_id", "x.row", F.lit(0).alias("col"), "x.value")
    cells = labels.unionByName(header).unionByName(lines).unionByName(total_cells)
    return cells.select("company_id", F.concat(F.lit("balance_sheet_"), F.col("company_id"), F.lit(".xlsx")).alias("file_id"),
                        F.lit("Balance Sheet").alias("sheet"), F.col("row").cast("int").alias("row"),
                        F.col("col").cast("int").alias("col"), "value")
