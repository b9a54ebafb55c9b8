"""Sinks: Silver parquet by document type, mart tables, CSV report exports and the
KPI history. Paths are shared storage (e.g. under ``spark.checkpoint.dir`` or a lake root); writes
are idempotent overwrites of whole partitions or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def silver_write(df: DataFrame, path: str, partition_cols=("document_type",)) -> None:
    """zstd parquet partitioned by document type; re-running a load replaces only its partitions."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy(*partition_cols).parquet(path))


def silver_read(spark: SparkSession, path: str, document_types=None) -> DataFrame:
    """Read Silver; a document-type filter prunes partitions at planning time."""
    df = spark.read.parquet(path)
    return df if not document_types else df.filter(F.col("document_type").isin(*document_types))


def mart_publish(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Overwrite each department mart table as parquet under ``root``; returns name -> path."""
    out = {}
    for name, df in tables.items():
        p = f"{root.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(p)
        out[name] = p
    return out


def report_rows_export(df: DataFrame, path: str) -> None:
    """A report row set as CSV with a header (one directory per report)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def kpi_snapshot_append(spark: SparkSession, history_path: str, snapshot: DataFrame, snapshot_time: str,
                        data_version: int, keep: int = 5000) -> DataFrame:
    """Append one KPI row per company as the partition of the company and its ``data_version`` and return the
    history: all versions, with the columns of any of them, the newest ``keep`` per company. Versions are counted
    per company; writing one again replaces this company's partition only."""
    new = snapshot.withColumn("snapshot_time", F.lit(snapshot_time).cast("timestamp")).withColumn(
        "data_version", F.lit(data_version)).withColumn("company_part", F.concat(F.lit("c-"), "company_id"))
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("company_part", "data_version")
     .parquet(history_path))
    history = spark.read.option("mergeSchema", "true").parquet(history_path).drop("company_part")
    w = Window.partitionBy("company_id").orderBy(F.col("snapshot_time").desc(), F.col("data_version").desc())
    return history.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")
