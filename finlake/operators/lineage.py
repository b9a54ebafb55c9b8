"""The graph from sources over processes and department agents to the supervisor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: processes of a document type, sections of a process, and what each agent works with
# ---------------------------------------------------------------------------------------------
TYPE_PROCESSES: dict[str, tuple[str, ...]] = {
    "balance_sheet": ("financial_statements", "ledger_and_accounts", "working_capital"),
    "profit_loss": ("financial_statements", "ledger_and_accounts"),
    "cash_flow_statement": ("financial_statements", "bank_and_reconciliation"),
    "chart_of_accounts": ("ledger_and_accounts",),
    "business_requirements": ("company_and_requirements",),
    "fixed_asset_register": ("assets_and_depreciation", "ledger_and_accounts"),
    "aged_debtors_creditors": ("working_capital",),
    "material_contracts": ("contracts_and_commitments", "company_and_requirements"),
    "sales_forecast": ("forecast_and_budget",),
    "personnel_plan": ("payroll_and_obligations", "forecast_and_budget"),
    "use_cases_user_stories": ("company_and_requirements",),
    "historical_tax_returns": ("ledger_and_accounts", "financial_statements"),
    "market_context": ("market_and_competitors",),
    "supplier_invoices": ("invoice_and_gst", "ledger_and_accounts", "working_capital"),
    "sales_invoices": ("invoice_and_gst", "ledger_and_accounts", "working_capital"),
    "bank_statements": ("bank_and_reconciliation", "ledger_and_accounts"),
    "payroll": ("payroll_and_obligations", "ledger_and_accounts"),
    "generic": ("generic_extraction",),
}
PROCESS_SECTIONS: dict[str, tuple[str, ...]] = {
    "financial_statements": ("overview", "accounts", "tax", "intelligence"),
    "ledger_and_accounts": ("accounts", "tax", "overview"),
    "invoice_and_gst": ("accounts", "tax", "overview", "marketing"),
    "bank_and_reconciliation": ("overview", "accounts", "tax"),
    "payroll_and_obligations": ("accounts", "tax", "overview"),
    "working_capital": ("overview", "accounts", "intelligence"),
    "assets_and_depreciation": ("accounts", "tax", "overview"),
    "forecast_and_budget": ("overview", "marketing", "intelligence"),
    "company_and_requirements": ("overview", "intelligence"),
    "market_and_competitors": ("intelligence", "marketing", "overview"),
    "contracts_and_commitments": ("accounts", "intelligence", "overview"),
    "generic_extraction": ("intelligence",),
}
AGENT_PROCESSES: dict[str, tuple[str, ...]] = {
    "executive": ("financial_statements", "working_capital", "forecast_and_budget", "company_and_requirements", "generic_extraction"),
    "finance": ("financial_statements", "ledger_and_accounts", "working_capital", "bank_and_reconciliation", "invoice_and_gst", "assets_and_depreciation"),
    "tax": ("invoice_and_gst", "ledger_and_accounts", "payroll_and_obligations", "assets_and_depreciation"),
    "marketing": ("forecast_and_budget", "invoice_and_gst", "working_capital", "market_and_competitors"),
    "operations": ("bank_and_reconciliation", "working_capital", "contracts_and_commitments", "assets_and_depreciation", "forecast_and_budget"),
    "people": ("payroll_and_obligations", "forecast_and_budget", "company_and_requirements"),
    "market": ("market_and_competitors", "forecast_and_budget", "company_and_requirements", "contracts_and_commitments"),
}
SUPERVISOR = "supervisor:ledger"


def _lists(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])


def lineage_edges(sources: DataFrame, lens: str = "all") -> DataFrame:
    """Edges (company_id, id, edge_type, source, target, enabled, active) of each company's graph.

    ``sources``: company_id, node_id, document_type, enabled; a type without a pipeline is extracted generically.
    Each source leads to the processes of its type, each process that any of the company's sources feeds to
    the agents that work with it, and each of those agents to its dashboard and the supervisor. An edge is
    active if its ends are enabled and shown under ``lens``, a section. Only distinct (company, process) pairs
    are shuffled; the rest follows from literals."""
    processes = F.coalesce(_lists(TYPE_PROCESSES)[F.col("document_type")], F.array(F.lit("generic_extraction")))
    shown = F.lit(True) if lens == "all" else F.array_contains(_lists(PROCESS_SECTIONS)[F.col("process")], lens)
    rows = sources.select("company_id", "node_id", "enabled", F.explode(processes).alias("process"))

    def edge(kind: str, source: Column, target: Column, enabled: Column, active: Column) -> list[Column]:
        return [F.concat_ws(":", F.lit("edge"), source, target).alias("id"), F.lit(kind).alias("edge_type"), source.alias("source"), target.alias("target"),
                enabled.alias("enabled"), active.alias("active")]

    yes = F.lit(True)
    process = F.concat(F.lit("process:"), F.col("process"))
    extract = rows.select("company_id", *edge("extract", F.col("node_id"), process, F.col("enabled"), F.col("enabled") & shown))
    fed = rows.select("company_id", "process").distinct()
    agents = {p: tuple(a for a, ps in AGENT_PROCESSES.items() if p in ps) for p in PROCESS_SECTIONS}
    pairs = fed.select("company_id", "process", F.explode(_lists(agents)[F.col("process")]).alias("agent"))
    agent, dashboard = F.concat(F.lit("agent:"), F.col("agent")), F.concat(F.lit("dashboard:"), F.col("agent"))
    inputs = pairs.select("company_id", *edge("agent_input", process, agent, yes, shown))
    working = pairs.select("company_id", "agent").distinct()
    ends = [("publish_dashboard", agent, dashboard), ("agent_decision", agent, F.lit(SUPERVISOR)), ("dashboard_evidence", dashboard, F.lit(SUPERVISOR))]
    out = [working.select("company_id", *edge(kind, a, b, yes, yes)) for kind, a, b in ends]
    return reduce(DataFrame.unionByName, [extract, inputs, *out])


def lineage_board(sources: DataFrame) -> DataFrame:
    """Agent nodes of each company's graph with the numbers of sources and processes that reach them.
    Sources are counted by type first, so that reachability is worked out for (company, type) pairs."""
    processes = F.coalesce(_lists(TYPE_PROCESSES)[F.col("document_type")], F.array(F.lit("generic_extraction")))
    types = sources.groupBy("company_id", "document_type").agg(F.count_if("enabled").alias("n")).withColumn("processes", processes)
    agents = F.array(*[F.struct(F.lit(a).alias("agent"), F.array(*[F.lit(p) for p in ps]).alias("works")) for a, ps in AGENT_PROCESSES.items()])
    rows = types.select("company_id", "n", "processes", F.explode(agents).alias("a"))
    hit = F.array_intersect("processes", "a.works")
    out = rows.groupBy("company_id", F.col("a.agent").alias("agent")).agg(
        F.sum(F.when(F.size(hit) > 0, F.col("n")).otherwise(0)).alias("source_count"), F.array_distinct(F.flatten(F.collect_set(hit))).alias("p"))
    return out.select("company_id", "agent", "source_count", F.size("p").cast("long").alias("process_count"))
