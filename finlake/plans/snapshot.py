"""Financial snapshot, cash forecast and dashboard series.

Every KPI is a column of a one-row-per-company DataFrame built from single-pass aggregates joined on
``company_id``; no value is pulled to the driver. Ratios are computed in double and rounded at the
edge, money stays decimal until the edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import params as P
from ..context import Ctx
from ..functions.expr import out_money
from ..operators import aggregates as AG
from ..operators import filters as FL


def _d(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def monthly_latest_two(monthly: DataFrame) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy(F.col("month").desc())
    m = monthly.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)
    return m.groupBy("company_id").agg(
        F.count("*").alias("months"),
        AG.sum_when(F.col("_rn") == 1, F.col("revenue")).alias("rev1"),
        AG.sum_when(F.col("_rn") == 1, F.col("expenses")).alias("exp1"),
        AG.sum_when(F.col("_rn") == 2, F.col("revenue")).alias("rev2"))


def financial_snapshot(c: Ctx, as_of: str = P.AS_OF) -> DataFrame:
    st = AG.position_totals(c.assets_liabilities)
    lg = AG.ledger_values(c.trial_balance).select(
        "company_id", *[F.col(x).alias("l_" + x) for x in (
            "posted_lines", "current_assets", "current_liabilities", "inventory", "cash", "total_assets",
            "total_liabilities", "revenue", "expenses")])
    mo = monthly_latest_two(AG.monthly_flow(c.transactions))
    open_ = ~F.col("status").isin(*FL.CLOSED_STATUSES)
    inv = c.invoices.groupBy("company_id").agg(
        AG.sum_when(open_, F.col("amount")).alias("open_total"),
        AG.sum_when(open_ & (F.col("due_date") < F.lit(as_of).cast("date")), F.col("amount")).alias("overdue_total"))
    anomalies = c.transactions.groupBy("company_id").agg(
        F.count(F.when(F.col("status").isin("anomaly", "critical"), 1)).alias("anomaly_count"))
    base = lg.join(st, "company_id", "left").join(mo, "company_id", "left").join(inv, "company_id", "left") \
        .join(anomalies, "company_id", "left")

    use_ledger = F.coalesce(F.col("l_posted_lines"), F.lit(0)) > 0

    def pick(name):
        return F.when(use_ledger, F.col("l_" + name)).otherwise(F.coalesce(F.col(name), F.lit(0)))

    has_months = F.coalesce(F.col("months"), F.lit(0)) > 0
    ledger_rev = F.coalesce(F.col("l_revenue"), F.lit(0))
    ledger_exp = F.coalesce(F.col("l_expenses"), F.lit(0))
    rev = F.when(has_months, F.col("rev1")).otherwise(ledger_rev)
    exp = F.when(has_months, F.col("exp1")).otherwise(ledger_exp)
    prev = F.when(F.coalesce(F.col("months"), F.lit(0)) > 1, F.col("rev2")).otherwise(rev)
    s = base.select(
        "company_id", pick("current_assets").alias("ca"), pick("current_liabilities").alias("cl"),
        pick("inventory").alias("inv"), pick("cash").alias("cash"), pick("total_assets").alias("ta"),
        pick("total_liabilities").alias("tl"), rev.alias("rev"), exp.alias("exp"), prev.alias("prev"),
        F.coalesce(F.col("open_total"), F.lit(0)).alias("open_total"),
        F.coalesce(F.col("overdue_total"), F.lit(0)).alias("overdue_total"),
        F.coalesce(F.col("anomaly_count"), F.lit(0)).cast("bigint").alias("anomaly_count"),
        F.when(use_ledger, "posted_ledger").otherwise("assets_liabilities").alias("position_basis"))
    ca, cl, inv_, cash, ta, tl = (_d(x) for x in ("ca", "cl", "inv", "cash", "ta", "tl"))
    rv, ex, pv, ot = _d("rev"), _d("exp"), _d("prev"), _d("open_total")
    avg_daily = ex / 30
    return s.select(
        "company_id",
        out_money("ca").alias("current_assets"), out_money("cl").alias("current_liabilities"),
        F.when(cl != 0, F.round(ca / cl, 2)).alias("current_ratio"),
        F.when(cl != 0, F.round((ca - inv_) / cl, 2)).alias("quick_ratio"),
        out_money(F.col("ca") - F.col("cl")).alias("working_capital"),
        out_money("cash").alias("cash"), out_money("inv").alias("inventory"),
        out_money("ta").alias("total_assets"), out_money("tl").alias("total_liabilities"),
        F.when(ta != 0, F.round(tl / ta, 2)).alias("debt_to_assets"),
        "anomaly_count",
        out_money("rev").alias("revenue_month"), out_money("exp").alias("expenses_month"),
        F.when(pv != 0, F.round((rv - pv) / pv * 100, 1)).otherwise(F.lit(0.0)).alias("revenue_change"),
        F.when(rv != 0, F.round((rv - ex) / rv * 100, 1)).otherwise(F.lit(0.0)).alias("gross_margin"),
        F.bround(ot / F.greatest(rv, F.lit(1.0)) * 30, 0).cast("bigint").alias("receivable_days"),
        F.bround(cl / F.greatest(ex, F.lit(1.0)) * 30, 0).cast("bigint").alias("payable_days"),
        F.when(avg_daily != 0, (cash / avg_daily).cast("bigint")).otherwise(F.lit(0)).cast("bigint").alias("cash_runway_days"),
        out_money("open_total").alias("open_invoice_total"), out_money("overdue_total").alias("overdue_invoice_total"),
        "position_basis")


def cash_forecast(c: Ctx, as_of: str = P.AS_OF, days: int = P.FORECAST_DAYS, window: int = 90) -> DataFrame:
    """Weekly points 0, 7, ... <= days: cash + k*7*daily_net - (open invoices due in weeks 1..k).

    Due dates map to their week arithmetically (step = ceil(days_until_due / 7)), so the range
    join of the reference becomes an equi-join on (company, step) against a 13-row grid.
    """
    snap = (c.snapshot if as_of == c.as_of else financial_snapshot(c, as_of)).select("company_id", F.col("cash").alias("cash"))
    recent = FL.recent_transactions(c.transactions, as_of, 90).groupBy("company_id").agg(
        F.sum("amount").alias("net"), F.count("*").alias("n"))
    base = snap.join(recent, "company_id", "left").select(
        "company_id", "cash",
        (F.coalesce(_d("net"), F.lit(0.0)) / F.when(F.coalesce(F.col("n"), F.lit(0)) > 0, 90.0).otherwise(30.0))
        .alias("daily_net"))
    asof = F.lit(as_of).cast("date")
    due = (FL.due_within(c.invoices, as_of, window)
           .withColumn("step", F.ceil(F.datediff(F.col("due_date"), asof) / 7).cast("int"))
           .filter(F.col("step").between(1, days // 7))
           .groupBy("company_id", "step").agg(F.sum("amount").alias("due")))
    grid = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(days // 7))).alias("step"))
    w = Window.partitionBy("company_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = grid.join(due, ["company_id", "step"], "left").withColumn(
        "cum_due", F.sum(F.coalesce(F.col("due"), F.lit(0))).over(w))
    point = F.date_add(asof, F.col("step") * 7)
    return j.select(
        "company_id", "step", point.alias("date"), F.date_format(point, "dd MMM").alias("label"),
        F.round(F.col("cash") + (F.col("step") * 7) * F.col("daily_net") - _d("cum_due"), 2).alias("forecast"),
        F.round(F.col("daily_net"), 2).alias("daily_net_assumption"))


def forecast_summary(c: Ctx, as_of: str = P.AS_OF, days: int = P.FORECAST_DAYS) -> DataFrame:
    """Low point and the overview chart picks (index 4, 8 and last = day 28, 56, 84)."""
    fc = cash_forecast(c, as_of, days)
    last = days // 7
    return fc.groupBy("company_id").agg(
        F.max("daily_net_assumption").alias("daily_net_assumption"),
        F.min("forecast").alias("low_point"),
        F.max(F.when(F.col("step") == min(4, last), F.col("forecast"))).alias("forecast_30d"),
        F.max(F.when(F.col("step") == min(8, last), F.col("forecast"))).alias("forecast_60d"),
        F.max(F.when(F.col("step") == last, F.col("forecast"))).alias("forecast_90d"))


def position_series(c: Ctx) -> DataFrame:
    b = FL.position_bucket(c.assets_liabilities)
    order = F.create_map(*[x for i, lab in enumerate(FL.POSITION_ORDER) for x in (F.lit(lab), F.lit(i + 1))])
    return (b.groupBy("company_id", "label").agg(F.sum("amount").alias("v")).filter(F.abs("v") > 0.005)
            .select("company_id", "label", F.round(F.abs(_d("v")), 2).alias("value"), order[F.col("label")].alias("sort_order")))
