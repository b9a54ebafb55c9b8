"""Structured Streaming re-aims of the reference's folder polling and scheduled refresh.

* ``folder_intake_stream``: a ``binaryFile`` file source over the landing folder (supported
  extensions only, hidden / lock files skipped, recursive), ``foreachBatch`` registering each new
  file by content hash; triggers ``availableNow`` (catch-up) or a processing-time interval.
* ``dedupe_stream``: content-hash de-duplication across micro-batches against the registry table
  (exact; the registry is a table, not in-memory state).
* ``daily_event_flow_stream``: per-day, per-type totals of the event stream. The reference keeps
  late rows, so this runs in complete mode (no watermark drop); the aggregate is bounded by
  days x types. Each micro-batch overwrites the published table, so retries are idempotent.

All sinks and checkpoints live under the cluster's ``spark.checkpoint.dir`` (read from the session;
a private folder is set only when it is unset, as in local tests).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..operators.store import Change, Store
from ..operators.targets import Sheet, import_batch
from ..session import checkpoint_dir

SUPPORTED_GLOB = "*.{csv,xlsx,xlsm,pdf}"
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _area(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/finlake-streams/{name}/{uuid.uuid4().hex}"


def _parquet_stream(spark: SparkSession, path: str, glob: str, schema=None, max_files: int | None = None) -> DataFrame:
    """Stream of the parquet tables under ``path`` whose name matches ``glob``; each is one file or a folder of
    files, which ``pathGlobFilter`` (names of files only) would leave out. Streams take a single file by a
    pattern only, so a plain name becomes one."""
    pattern = glob if any(x in glob for x in "*?[{") else f"{glob[:-1]}[{glob[-1]}]"
    source = f"{path.rstrip('/')}/{pattern}"
    reader = spark.readStream.schema(schema or spark.read.parquet(source).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(source)


def folder_intake_stream(spark: SparkSession, landing: str, registry: str, checkpoint: str,
                         available_now: bool = True, interval: str = "5 seconds"):
    """Register every new supported file under ``landing`` by sha256 (new vs duplicate)."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("pathGlobFilter", SUPPORTED_GLOB)
             .option("recursiveFileLookup", "true")
             .load(landing)
             .filter(~F.regexp_extract("path", r"([^/]*)$", 1).rlike(r"^(\.|~\$)")))

    def register(batch: DataFrame, batch_id: int) -> None:
        b = batch.select(F.col("path").alias("file_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
                         F.col("length").alias("file_size"), F.sha2(F.col("content"), 256).alias("sha256"),
                         F.col("modificationTime").alias("modified_at"))
        _register_batch(spark, b, registry, batch_id, "file_id")

    writer = files.writeStream.foreachBatch(register).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def _register_batch(spark: SparkSession, batch: DataFrame, registry: str, batch_id: int, id_col: str) -> None:
    """Dedupe a micro-batch by content hash within itself and against the registry, then write the
    batch's registry rows into its own ``batch_id`` partition (overwrite => retry-safe)."""
    first_in_batch = batch.groupBy("sha256").agg(F.min(id_col).alias("first_id"))
    try:
        known = spark.read.parquet(registry).filter(F.col("batch_id") != batch_id) \
            .filter(F.col("decision") == "new").select("sha256", F.col(id_col).alias("known_id"))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":  # only the first batch has no registry yet
            raise
        known = None
    b = batch.join(first_in_batch, "sha256")
    if known is not None:
        b = b.join(known, "sha256", "left")
    else:
        b = b.withColumn("known_id", F.lit(None).cast(batch.schema[id_col].dataType))
    decision = F.when(F.col("known_id").isNotNull(), "duplicate").when(F.col(id_col) == F.col("first_id"), "new") \
        .otherwise("duplicate")
    out = b.select(*batch.columns, F.coalesce("known_id", "first_id").alias("original_id"), decision.alias("decision"),
                   F.lit(batch_id).alias("batch_id"))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(registry))


def dedupe_stream(spark: SparkSession, source_dir: str, glob: str, id_col: str, text_col: str,
                  registry: str, checkpoint: str, max_files: int | None = None):
    """Content-hash de-duplication of text rows arriving as parquet files. Files that are there together are one
    micro-batch (unless ``max_files`` parts them), so their order does not decide and the registry is read once."""
    src = _parquet_stream(spark, source_dir, glob, max_files=max_files)

    def register(batch: DataFrame, batch_id: int) -> None:
        b = batch.select(F.col(id_col), F.sha2(F.col(text_col), 256).alias("sha256"))
        _register_batch(spark, b, registry, batch_id, id_col)

    return (src.writeStream.foreachBatch(register).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def daily_event_flow_stream(spark: SparkSession, source_dir: str, output: str, checkpoint: str, glob: str = "events.parquet"):
    """Per (day, event_type): events and summed value, complete mode, published by overwrite."""
    ev = _parquet_stream(spark, source_dir, glob)
    agg = ev.groupBy(F.window(F.col("ts"), "1 day").alias("w"), "event_type").agg(
        F.count("*").alias("events"), F.sum("value").alias("value"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.to_date(F.col("w.start")).alias("day"), "event_type", F.col("events").cast("bigint").alias("events"),
                      F.round("value", 2).alias("value"))
         .write.mode("overwrite").parquet(output))

    return (agg.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def upsert_stream(spark: SparkSession, landing: str, schema: str, store: Store, name: str, document_type: str, checkpoint: str, as_of: str):
    """Uploads that arrive as parquet files (one upload each, with its number in ``upload``) go through the
    same ``import_batch`` as batch loads. The batch id names stream and upload, so neither a retried micro-batch
    nor a stream started anew over the same files changes anything."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(landing)

    def load(batch: DataFrame, batch_id: int) -> None:
        for row in batch.select("upload").distinct().orderBy("upload").collect():  # one file, one upload
            rows = batch.filter(F.col("upload") == row["upload"]).drop("upload")
            import_batch(store, f"{name}-{row['upload']}", [Sheet(document_type, rows, f"{document_type}_{row['upload']}.csv")], as_of)

    return src.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Days of flow: late rows count as long as they are at most this much behind the newest event
FLOW_WATERMARK = "31 days"
FLOW_DAYS = "flow_days"
FLOW_KEYS = ("company_id", "day")


def _flows(rows: DataFrame) -> DataFrame:
    """company_id, ts, inflow and outflow in cents of events (company by user, purchases come in)."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return rows.select(F.concat(F.lit("co-"), F.pmod("user_id", F.lit(5)).cast("string")).alias("company_id"), F.col("ts").cast("timestamp").alias("ts"),
                       F.when(F.col("event_type") == "purchase", cents).otherwise(0).alias("inflow"),
                       F.when(F.col("event_type") == "purchase", 0).otherwise(cents).alias("outflow"))


def daily_flow(rows: DataFrame) -> DataFrame:
    """Inflow and outflow in cents by company and day: the batch answer."""
    return _flows(rows).groupBy("company_id", F.to_date("ts").alias("day")).agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))


def daily_flow_stream(spark: SparkSession, source: str, schema, store: Store, checkpoint: str, glob: str = "*.parquet", watermark: str = FLOW_WATERMARK, max_files: int = 1):
    """Live inflow and outflow by company and day. State is kept for the days within the watermark only;
    each trigger merges the days that changed into ``flow_days``. Rows later than the watermark are left out
    of the live table until ``reconcile_flow`` brings them in."""
    src = _parquet_stream(spark, source, glob, schema, max_files)
    flow = _flows(src).withWatermark("ts", watermark).groupBy("company_id", F.window("ts", "1 day").alias("w")).agg(
        F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        days = batch.select("company_id", F.to_date("w.start").alias("day"), "inflow", "outflow").persist()
        days.count()  # the state is read and stored once, also when the batch was merged before
        store.commit(f"flow-{batch_id}", {FLOW_DAYS: Change(days, FLOW_KEYS)})
        days.unpersist()

    return flow.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconcile_flow(store: Store, rows: DataFrame, batch: str) -> bool:
    """Replace the days on which the live table differs from all rows: the rule for rows that came after the
    watermark had passed."""
    live = store.read(FLOW_DAYS, "company_id string, day date, inflow bigint, outflow bigint").withColumnsRenamed({"inflow": "i", "outflow": "o"})
    days = daily_flow(rows).join(live, list(FLOW_KEYS), "left")
    wrong = days.filter(~(F.col("inflow").eqNullSafe(F.col("i")) & F.col("outflow").eqNullSafe(F.col("o")))).drop("i", "o")
    return store.commit(batch, {FLOW_DAYS: Change(wrong, FLOW_KEYS)})


def monthly(days: DataFrame) -> DataFrame:
    """Days of flow as months, in money."""
    money = lambda c: F.round(F.sum(c).cast("decimal(38,2)") / 100, 2).cast("double").alias(c)
    return days.groupBy("company_id", F.date_format("day", "yyyy-MM").alias("month")).agg(money("inflow"), money("outflow"))


def run_daily_event_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = _area(spark, "daily_event_flow")
    q = daily_event_flow_stream(spark, sf_dir, f"{area}/out", f"{area}/chk")
    q.awaitTermination()
    return spark.read.parquet(f"{area}/out")


def run_document_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = _area(spark, "document_dedupe")
    q = dedupe_stream(spark, sf_dir, "documents.parquet", "doc_id", "text", f"{area}/registry", f"{area}/chk")
    q.awaitTermination()
    return spark.read.parquet(f"{area}/registry").drop("batch_id")
