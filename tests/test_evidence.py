"""Type sets, catalogue coverage, effective dates, file findings and schemes against plain versions."""

import random
import re
from collections import defaultdict
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from finlake.functions import rules as R
from finlake.operators import evidence as E

UPLOADS = "company_id string, upload_id long, filename string, document_type string, detected_types array<string>, analysed_type string, declared_type string, processing_status string, intake_category string"


def plain_types(u):
    known = lambda x: E.TYPE_ALIASES.get((x or "").strip().lower(), (x or "").strip().lower())
    found = {known(u[3])} - set(E.STORED_VAGUE) | {known(x) for x in u[4] or []} - set(E.DETECTED_VAGUE)
    return (found | {known(u[5])} - set(E.DETECTED_VAGUE) | {known(u[6])} - set(E.DECLARED_VAGUE)) - {""}


def plain_hint(name):
    signal = re.sub("[^a-z0-9]+", "_", (name or "").lower())
    return {next((t for t, ws in R.FILENAME_HINT_RULES if any(w in signal for w in ws)), "")} - {""}


def some_uploads():
    draw = random.Random(5)
    kinds = [None, "", "generic", "Invoices ", "balance_sheet", "payroll", "budgets", "auto", "profiling", "mixed_business_workbook"]
    names = ["payroll 1.csv", "Balance-Sheet.pdf", "notes.txt", None, "coa.csv"]
    return [(draw.choice("aaab"), i, draw.choice(names), draw.choice(kinds), draw.choice([None, [], [None], ["assets", "liabilities"], ["generic", "payroll"]]),
             draw.choice(kinds), draw.choice(kinds), draw.choice(["committed", "failed", "pending_mapping", None]), draw.choice(["setup", "recurring", "", None])) for i in range(300)]


def test_types_and_coverage_equal_a_plain_loop(spark):
    rows = some_uploads()
    got = {r["upload_id"]: r for r in E.with_types(spark.createDataFrame(rows, UPLOADS)).collect()}
    count = defaultdict(lambda: [0, 0, False])
    for u in rows:
        types = plain_types(u)
        assert got[u[1]]["types"] == sorted(types)
        intended = types or plain_hint(u[2])
        assert got[u[1]]["intended"] == sorted(intended)
        done = u[7] in R.COMPLETE_UPLOAD_STATUSES
        for t in intended:
            c = count[u[0], u[8] or "recurring", t]
            c[0] += 1
            c[1] += done
            c[2] |= done and t in types
    found = E.coverage_by_catalogue(spark.createDataFrame(rows, UPLOADS)).collect()
    assert len(found) == 2 * len(E.CATALOGUE)
    for r in found:
        attempts, files, known = count[r["company_id"], r["intake_category"], r["id"]]
        assert (r["attempt_count"], r["file_count"], r["retry_count"], r["covered"]) == (attempts, files, attempts - files, known)
        assert r["state"] == ("received" if files else "needs_retry" if attempts else "missing") and r["received"] == (files > 0)


def test_coverage_of_nothing(spark):
    empty = spark.createDataFrame([], UPLOADS)
    assert E.coverage_by_catalogue(empty).count() == 0
    lone = E.coverage_by_catalogue(spark.createDataFrame([("a", 1, None, None, None, None, None, None, None)], UPLOADS)).collect()
    assert {r["state"] for r in lone} == {"missing"} and len(lone) == len(E.CATALOGUE)


def test_effective_dates_in_order(spark):
    cases = [
        ("x_20240315.csv", "2023-06-30T00:00", "2023-06-30"), ("x_20240315.csv", " n/a", "2024-03-15"), ("x 2024-03.15.csv", None, "2024-03-15"),
        ("payroll_march-2024.csv", None, "2024-03-01"), ("June 2023 to May 2024.csv", None, "2024-05-01"), ("May 2024 and May 2022", None, "2024-05-01"),
        ("tax FY2023.csv", None, "2023-06-30"), ("tax fy 2022 20241399", None, "2022-06-30"), ("Mayor 2024", None, "2025-01-02"), ("", None, "2025-01-02"), (None, None, "2025-01-02")]
    rows = spark.createDataFrame([(i, n, c, date(2025, 1, 2)) for i, (n, c, _) in enumerate(cases)], "i int, n string, c string, d date")
    got = {r["i"]: r["e"] for r in rows.select("i", E.effective_date(F.col("n"), [F.col("c")], F.col("d")).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == [e for *_, e in cases]


FINDING = "company_id string, file_id string, document_type string, name string, party string, amount decimal(18,2), tax decimal(18,2)"


def test_findings_equal_a_plain_loop(spark):
    draw = random.Random(3)
    rows = [(draw.choice("ab"), draw.choice("fffg"), "bank", draw.choice([None, " ", *"klmnopq"]), draw.choice([None, "", " p", "p", "q", "r", "s", "t"]),
             draw.choice([None, Decimal("5.00"), Decimal("-5.00"), Decimal(draw.randrange(-999, 999)) / 4]), draw.choice([None, Decimal("0.10")])) for _ in range(400)]
    got = {(r["company_id"], r["file_id"]): r for r in E.file_findings(spark.createDataFrame(rows, FINDING)).collect()}
    assert len(got) == len({r[:2] for r in rows})
    for key, f in got.items():
        mine = [r for r in rows if r[:2] == key]
        cents = [Decimal(r[5] or 0).quantize(Decimal("0.01"), "ROUND_HALF_UP") for r in mine]
        assert (f["rows"], f["total"], f["inflow"], f["outflow"]) == (len(mine), sum(cents), sum(c for c in cents if c > 0), -sum(c for c in cents if c < 0))
        assert f["tax"] == sum(r[6] or 0 for r in mine)
        parties = sorted({(r[4] or "").strip() for r in mine} - {""})
        assert (f["parties"], f["counterparties"]) == (len(parties), ", ".join(parties[:4]))
        sized = sorted((-abs(c), r[3]) for c, r in zip(cents, mine) if (r[3] or "").strip())
        assert f["positions"] == ", ".join(f"{n}={-s}" for s, n in sized[:4])


def test_files_are_cut_to_four_rows_before_the_shuffle(spark):
    plan = E.file_findings(spark.createDataFrame([], FINDING))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_schemes_of_companies_with_part_of_the_records(spark):
    classified = spark.createDataFrame([("a", "1500", "REVIEW", "Software", Decimal("9.50")), ("a", None, None, None, None), ("b", "1", "GST", "Rent", Decimal("1.00"))],
                                       "company_id string, c_account_code string, c_tax_code string, c_account_name string, amount decimal(18,2)")
    stock = spark.createDataFrame([("c", Decimal("3.25"))], "company_id string, total_value decimal(18,2)")
    payroll = spark.createDataFrame([("a",), ("a",)], "company_id string")
    got = {(r["company_id"], r["scheme"]): (r["status"], r["evidence"]) for r in E.scheme_evidence(E.scheme_signals(classified, stock, payroll)).collect()}
    assert len(got) == 3 * len(E.SCHEMES)
    assert got["a", "gst_credits"] == ("review now", "1") and got["b", "gst_credits"] == ("evidence present", "0")
    assert got["a", "rdti"] == ("eligibility review", "9.50") and got["a", "instant_asset_write_off"] == ("eligibility review", "1")
    assert got["a", "employee_costs"] == ("evidence present", "2") and got["c", "employee_costs"] == ("missing payroll", "0")
    assert got["c", "trading_stock"] == ("eligibility review", "3.25") and got["b", "cgt_concessions"] == ("event dependent", None)
