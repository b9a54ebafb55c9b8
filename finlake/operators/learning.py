"""Rules learned from approvals, and the rebuild of what they change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import normalise_text, sha1_prefix

# FIXED VALUES: priorities of rules from approvals and of rules written by hand; the capital account
LEARNED_PRIORITY, WRITTEN_PRIORITY = 200, 150
CAPITAL_ACCOUNT, CAPITAL_FROM = "1500", 1000


def learned_rules(approvals: DataFrame) -> DataFrame:
    """One supplier rule per company and supplier from approvals (company_id, invoice_id, supplier,
    account_code, tax_code, approved_at): the latest approval counts (ties: greatest invoice id). Blank
    suppliers teach nothing."""
    rows = approvals.withColumn("keyword", normalise_text(F.col("supplier"))).filter("keyword <> ''")
    last = F.max_by(F.struct("account_code", "tax_code"), F.struct("approved_at", "invoice_id"))
    rules = rows.groupBy("company_id", "keyword").agg(last.alias("r")).select("company_id", "keyword", "r.*")
    key = F.concat_ws("|", "keyword", "account_code", "tax_code")
    return rules.select("company_id", F.concat(F.lit("rule-user-"), sha1_prefix(key)).alias("rule_id"), "keyword", F.lit("supplier_exact").alias("match_type"),
                        "account_code", "tax_code", F.lit(LEARNED_PRIORITY).alias("priority"), F.lit("user").alias("source"))


def affected(invoices: DataFrame, rules: DataFrame, approvals: DataFrame) -> DataFrame:
    """The supplier invoices that learned rules decide anew, classified: an equi-join on company and
    normalised supplier, in which hot suppliers are split by the adaptive skew join. The approved invoices
    themselves are final."""
    rows = invoices.filter(F.col("invoice_kind") != "sales").withColumn("_key", normalise_text(F.col("supplier")))
    hit = rules.select("company_id", F.col("keyword").alias("_key"), F.col("rule_id").alias("learned_rule"), F.col("account_code").alias("learned_account"),
                       F.col("tax_code").alias("learned_tax"))
    final = approvals.groupBy("company_id", F.col("invoice_id").alias("id")).agg(F.max_by(F.struct("account_code", "tax_code"), "approved_at").alias("_final"))
    rows = rows.join(hit, ["company_id", "_key"]).join(final, ["company_id", "id"], "left")
    sure = F.lit(R.rule_confidence(LEARNED_PRIORITY))
    capital = (F.abs(F.col("amount")) >= CAPITAL_FROM) & (F.col("learned_account") == CAPITAL_ACCOUNT)
    done = F.col("_final").isNotNull()
    return rows.withColumns({
        "c_account_code": F.when(done, F.col("_final.account_code")).otherwise(F.col("learned_account")),
        "c_tax_code": F.when(done, F.col("_final.tax_code")).otherwise(F.col("learned_tax")),
        "c_confidence": F.when(done, 1.0).when(capital, F.least(sure, F.lit(0.9))).otherwise(sure),
        "c_status": F.when(done, "approved").when(capital, "suggested").when(sure >= 0.95, "auto_approved").otherwise("suggested"),
        "rule_id": F.when(~done, F.col("learned_rule")),
    }).drop("_key", "_final", "learned_rule", "learned_account", "learned_tax")


def journal_rebuild(lines: DataFrame, again: DataFrame, new_lines: DataFrame, key: str = "source_id") -> DataFrame:
    """Journal lines with those of the reclassified invoices replaced: the others are not touched."""
    ids = again.select("company_id", F.col("id").alias(key)).distinct()
    return lines.join(ids, ["company_id", key], "left_anti").unionByName(new_lines)
