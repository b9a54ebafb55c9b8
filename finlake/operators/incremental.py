"""Incremental load, versioning and lifecycle.

State lives in DataFrames (fingerprints, registry); every operator is a join of a batch against
state plus windows *inside the batch only* (never over the full history), so the work per batch is
proportional to the batch, and hot keys are reduced by partial aggregation (``max_by``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions.expr import sha1_prefix


def text_hash(cols: Sequence[str]) -> F.Column:
    """sha256 over the '|'-joined text of typed columns (money as decimal text); equal rows <=>
    equal hashes. Used where an engine-independent hash is needed."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]), 256)


def fingerprint_versions(batch: DataFrame, state: DataFrame, key: str = "business_key", order: str = "seq",
                         doc_type: str = "document_type", scope: Sequence[str] = (), apart: Sequence[str] = (), newest: str | None = None) -> DataFrame:
    """Classify each batch row against the latest state of its key and earlier rows of the same key
    in this batch (A -> B -> A is two changes): decision new / unchanged / changed, record version
    and a stable record id. ``state``: (document_type, business_key, row_hash, record_version, record_id).
    ``scope`` names further key columns of both sides, such as the company; ``apart`` columns of the batch alone,
    rows that differ in which are no versions of each other. ``newest`` names a column that is true in the last row of a
    key in this batch that is not unchanged, told in the window that counts the versions."""
    keys = [*scope, doc_type, key]
    cur = state.select(*keys, F.col("row_hash").alias("s_hash"), F.col("record_version").alias("s_ver"),
                       F.col("record_id").alias("s_id"))
    j = batch.join(cur, keys, "left")
    w = Window.partitionBy(*keys, *apart).orderBy(order)
    prev = F.coalesce(F.lag("row_hash").over(w), F.col("s_hash"))
    first_seen = F.col("s_hash").isNull() & (F.row_number().over(w) == 1)
    j = j.withColumn("decision", F.when(first_seen, "new").when(F.col("row_hash") == prev, "unchanged").otherwise("changed"))
    count = F.sum(F.when(F.col("decision") != "unchanged", 1).otherwise(0))
    bumps = count.over(w.rowsBetween(Window.unboundedPreceding, 0))
    stable = F.concat(F.lit("lf-"), F.col(doc_type), F.lit("-"), sha1_prefix(F.col(key)))
    last = {} if newest is None else {newest: (F.col("decision") != "unchanged") & (bumps == count.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))}
    return (j.withColumns({"record_version": (F.coalesce("s_ver", F.lit(0)) + bumps).cast("int"), **last})
            .withColumn("record_id", F.coalesce("s_id", stable))
            .drop("s_hash", "s_ver", "s_id"))


def change_counts(classified: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return classified.groupBy(*scope, "decision").agg(F.count("*").cast("bigint").alias("rows"))


def latest_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the row with the greatest ``order`` (INSERT OR REPLACE semantics)."""
    cols = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def incremental_upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Target after applying a batch: the last batch row per key replaces the target row; keys not
    in the batch keep their row (upsert never deletes). Target rows sort before every batch row."""
    t = target.withColumn(order, F.lit(-1).cast("bigint"))
    return latest_wins(t.unionByName(rows.select(*t.columns)), keys, order).drop(order)


def file_dedupe_decision(uploads: DataFrame) -> DataFrame:
    """Per upload, compare with the earliest upload of the same content hash: first -> new; earlier
    copy completed -> duplicate (moved if the intake category differs); earlier attempt stale or
    failed -> reprocess. One partial aggregate per hash, no window over the registry."""
    first = uploads.groupBy("company_id", "sha256").agg(
        F.min_by(F.struct("upload_id", "processing_status", "intake_category"), F.col("upload_id")).alias("f"))
    j = uploads.join(first, ["company_id", "sha256"])
    complete = F.col("f.processing_status").isin(*R.COMPLETE_UPLOAD_STATUSES)
    decision = (F.when(F.col("upload_id") == F.col("f.upload_id"), "new")
                .when(~complete & (F.col("f.processing_status") != "processing"), "reprocess")
                .when(F.col("intake_category") != F.col("f.intake_category"), "moved")
                .otherwise("duplicate"))
    return j.select("company_id", "upload_id", "sha256", F.col("f.upload_id").alias("first_upload_id"), decision.alias("decision"))


def affected_metrics(datasets: DataFrame, dataset_col: str = "document_type") -> DataFrame:
    """Datasets -> distinct dependent metrics (unknown datasets refresh 'dashboard'). The dependency
    map is a fixed 18-entry literal evaluated per row (no join)."""
    m = F.create_map(*[x for k, v in R.DEPENDENCIES.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    metrics = F.coalesce(m[F.col(dataset_col)], F.array(F.lit("dashboard")))
    return datasets.select(F.col(dataset_col).alias("dataset"), F.explode(metrics).alias("metric")).distinct()


def source_delete(table: DataFrame, deleted: DataFrame, key: str = "source_file") -> DataFrame:
    """Table without the rows of deleted sources (anti-join; partition-pruned when the table is
    partitioned by source)."""
    return table.join(deleted.select(key).distinct(), key, "left_anti")


# FIXED VALUES: lineage stages (stage, operation) in order
LINEAGE_STAGES = (
    ("source", "Source file registered"),
    ("raw", "Immutable source preserved"),
    ("clean", "Rows cleaned, mapped and versioned"),
    ("store", "Business records and detailed context committed"),
    ("serve", "Metrics and compact context refreshed"),
)


def lineage_backfill(uploads: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """Five ordered stage events per upload that has no lineage yet (anti-join + explode)."""
    todo = uploads if lineage is None else uploads.join(lineage.select("upload_id").distinct(), "upload_id", "left_anti")
    stages = F.array(*[F.struct(F.lit(i + 1).alias("stage_order"), F.lit(s).alias("stage"), F.lit(o).alias("operation"))
                       for i, (s, o) in enumerate(LINEAGE_STAGES)])
    run_id = F.concat(F.lit("registry_"), F.col("upload_id"), F.lit("_0"))
    return todo.select("company_id", "upload_id", "filename", run_id.alias("run_id"), F.explode(stages).alias("s")).select(
        "company_id", F.concat(F.col("run_id"), F.lit("_"), F.col("s.stage_order").cast("string")).alias("event_id"),
        "run_id", "upload_id", F.col("s.stage_order").alias("stage_order"), F.col("s.stage").alias("stage"),
        F.col("s.operation").alias("operation"), F.col("filename").alias("source_name"))
