"""A second company with the same rows changes nothing in the first one's results, and gets the same results itself."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paths import SF_SMALL
from finlake.context import Ctx
from finlake.plans import queries_analytics as QA
from finlake.plans import queries_catalog as QC
from finlake.plans import queries_context as QX
from finlake.plans import queries_core as QL
from finlake.plans import queries_domains as QD
from finlake.plans import queries_intake as QI
from finlake.plans import queries_matching as QM
from oracle_harness import _norm

REPORTS = (QA.q_top_positions, QA.q_recent_invoices, QA.q_recent_transactions_top, QA.q_top_signals, QA.q_top_inventory_value, QA.q_company_market_signals,
           QC.q_staged_file_dedupe, QC.q_rule_use_counts, QX.q_metric_state_counts, QX.q_top_contributors, QX.q_unreconciled_staged_files,
           QL.q_journal_status_counts, QL.q_journal_totals, QL.q_task_queue, QD.q_competitor_dimensions, QD.q_competitor_ranking, QD.q_signal_counts,
           QI.q_document_coverage, QI.q_row_change_classify, QI.q_row_change_counts, QI.q_incremental_upsert, QI.q_latest_wins, QM.q_validation_counts, QM.q_validation_queue)


class Twice:
    """A context whose tables hold every row for two companies."""

    def __init__(self, one: Ctx):
        self.one = one

    def __getattr__(self, name):
        got = getattr(self.one, name)
        if isinstance(got, DataFrame) and "company_id" in got.columns:
            return got.unionByName(got.withColumn("company_id", F.lit("other")))
        return got


@pytest.mark.parametrize("report", REPORTS, ids=lambda f: f.__name__)
def test_companies_are_kept_apart(spark, report):
    one = Ctx.get(spark, SF_SMALL)

    def rows(df, company):
        rest = [x for x in df.columns if x != "company_id"]
        return sorted(repr(tuple(_norm(r[x]) for x in rest)) for r in df.filter(F.col("company_id") == company).collect())

    expected = rows(report(one), "default")
    both = report(Twice(one))
    assert expected and rows(both, "default") == expected and rows(both, "other") == expected


def test_journals_of_one_id_balance_apart(spark):
    assert QL.q_journal_balance_check(Twice(Ctx.get(spark, SF_SMALL))).count() == 0
