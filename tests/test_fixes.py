"""Cases that earlier versions got wrong: tenants merged, history lost, plans that ran jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from finlake.context import Ctx
from finlake.functions import rules as R
from finlake.operators import aggregates as AG
from finlake.operators import joins as J
from finlake.operators import recognition as RC
from finlake.plans import ledger as L
from finlake.plans.queries_intake import memory_compaction
from finlake.sources import sinks as SK

SF = "/root/testdata/sf0.001"


def test_trial_balance_keeps_companies_apart(spark):
    lines = spark.createDataFrame(
        [("A", "l1", "j1", "1100", "10.00", "0.00", "posted"), ("B", "l2", "j2", "1100", "5.00", "0.00", "posted"),
         ("B", "l3", "j3", "1100", "7.00", "0.00", "draft")],
        "company_id string, id string, journal_id string, account_code string, debit string, credit string, entry_status string",
    ).withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("debit", "credit")})
    tb = L.trial_balance(L.chart_of_accounts(spark), lines)
    got = {(r["company_id"], float(r["balance"])) for r in tb.filter("code = '1100'").collect()}
    assert got == {("A", 10.0), ("B", 5.0)}
    assert {r["n"] for r in tb.groupBy("company_id").agg(F.count("*").alias("n")).collect()} == {sum(1 for a in R.DEFAULT_ACCOUNTS if a[5])}


def test_exposure_and_duplicates_by_company(spark):
    day = dt.date(2024, 1, 1)
    inv = spark.createDataFrame([("A", "1", "N1", "sales", "due", day, 10.0), ("B", "2", "N1", "sales", "due", day, 5.0), ("B", "3", "N1", "sales", "paid", day, 1.0)],
                                "company_id string, id string, invoice_number string, invoice_kind string, status string, due_date date, amount double")
    assert {(r["company_id"], r["open"]) for r in AG.invoice_exposure(inv, "2024-06-01").collect()} == {("A", 10.0), ("B", 5.0)}
    assert [(r["company_id"], r["count"]) for r in AG.duplicate_invoice_numbers(inv).collect()] == [("B", 2)]


def test_kpi_history_keeps_every_version(spark, tmp_path):
    path = str(tmp_path / "kpi")
    for v in (1, 2):
        rows = spark.createDataFrame([("default", float(v))], "company_id string, cash double")
        rows = rows if v == 1 else rows.withColumn("extra", F.lit(9))
        out = SK.kpi_snapshot_append(spark, path, rows, f"2024-01-0{v} 00:00:00", v)
    assert sorted((r["data_version"], r["cash"], r["extra"]) for r in out.collect()) == [(1, 1.0, None), (2, 2.0, 9)]
    again = SK.kpi_snapshot_append(spark, path, rows, "2024-01-02 00:00:00", 2)
    assert again.count() == 2


@pytest.mark.parametrize(("text", "end"), [("FY 2024", "2024-12-31"), ("2023", "2023-12-31"), ("31/03/2022", "2022-03-31"), ("Notes", None), ("1899", None)])
def test_period_in_a_heading(spark, text, end):
    got = spark.createDataFrame([(text,)], "v string").select(RC.period_from_header(F.col("v")).alias("p")).first()["p"]["period_end"]
    assert (str(got) if got else None) == end


def test_invoice_signal_far_into_the_text(spark):
    text = "padding words " * 1000 + "\nTAX INVOICE\nInvoice No: AB-1\nTotal: $12.50\n"
    docs = spark.createDataFrame([("x.pdf", "auto", text)], "filename string, declared_type string, text string")
    assert [r["amount"] for r in RC.text_invoice_extract(docs).collect()] == [12.5]


def test_memory_carries_the_previous_summary(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(50)] + [(2, i, "user", "x") for i in range(39)]
    messages = spark.createDataFrame(rows, "session_id long, o long, role string, text string")
    old = spark.createDataFrame([(1, "z" * 3000)], "session_id long, summary string")
    got = {r["session_id"]: r["summary"] for r in memory_compaction(messages, old).collect()}
    assert set(got) == {1}
    assert got[1].startswith("z" * 2500 + "\nRecent user objectives: ") and got[1].endswith("m48")


def test_upload_statuses_that_count_as_complete():
    assert R.COMPLETE_UPLOAD_STATUSES == ("committed", "stored_source", "pending_mapping")


def test_building_a_plan_runs_no_job(spark):
    c = Ctx(spark, SF)
    raw, txn = c.raw_invoices, c.transactions
    spark.sparkContext.setJobGroup("plan-only", "no job expected")
    try:
        J.duplicate_payment_pairs(txn)
        L.gst_split(L.classify_invoices(raw))
        RC.text_invoice_extract(RC.render_invoice_text(c.sales_invoices))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_kpi_versions_are_counted_per_company(spark, tmp_path):
    """Two companies write the same version; a company that writes it again replaces its own row alone."""
    from finlake.sources.sinks import kpi_snapshot_append

    path = str(tmp_path / "kpi")
    for company, value in (("007", 1), ("b", 2), ("007", 3)):
        row = spark.createDataFrame([(company, value)], "company_id string, cash int")
        history = kpi_snapshot_append(spark, path, row, "1998-07-01 00:00:00", 1)
    assert sorted((r["company_id"], r["data_version"], r["cash"]) for r in history.collect()) == [("007", 1, 3), ("b", 1, 2)]


def test_classified_text_is_computed_once(spark):
    """A normalised text is bound once, not written into the branch of every token."""
    from finlake.functions.expr import file_stem, first_keyword_class, route_token

    rules = [(f"type{i}", [f"word{i}a", f"word{i}b"]) for i in range(20)]
    df = spark.createDataFrame([("x/Word3b.csv",), ("Other word19a.CSV",), ("none.csv",), (None,)], "name string")
    out = df.select(first_keyword_class(route_token(file_stem(F.col("name"))), rules, "generic").alias("t"))
    assert [r["t"] for r in out.collect()] == ["type3", "type19", "generic", "generic"]
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace") <= 4


def test_file_match_does_not_pair_questions_with_every_file(spark):
    """Files and questions with the same tokens are taken together; the answers are those of all pairs."""
    from finlake.plans.queries_context import file_token_match

    names = [("a" if i % 5 else "b", f"up-{i:03d}", ("Invoice_" if i % 3 else "report_") + str(i % 40) + ".csv", "sales" if i % 4 else None, dt.date(2024, 1, 1 + i % 28)) for i in range(300)]
    asks = [("a" if i % 2 else "b", f"q{i % 50}", ["the invoice csv", "sales REPORT invoice_12", "nothing here", "", None][i % 5]) for i in range(60)]
    uploads = spark.createDataFrame(names + names[:9], "company_id string, upload_id string, filename string, document_type string, created_at date")
    questions = spark.createDataFrame(asks, "company_id string, question_id string, text string")
    import re
    tokens: dict = {}
    for co, q, text in asks:
        tokens.setdefault((co, q), set()).update(re.findall("[a-z0-9_-]{3,}", (text or "").lower()))
    want = set()
    for (co, q), ts in tokens.items():
        scored = {u: sum(t in fn.lower() or t in (kind or "") for t in ts) for c2, u, fn, kind, _ in names if c2 == co}
        best = sorted((-n, u) for u, n in scored.items() if n)[:8]
        want |= {(co, q, u, -n, i) for i, (n, u) in enumerate(best, 1)}
    got = file_token_match(questions, uploads)
    assert {tuple(r) for r in got.filter("score > 0").collect()} == want
    assert {(r[0], r[1]) for r in got.filter("score = 0").collect()} == {key for key in tokens if not any(x[:2] == key for x in want)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, ((company_id" in plan and "asked" in plan
