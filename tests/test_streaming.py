"""Folder intake stream over real files: supported extensions only, hidden files skipped, content
duplicates detected, and a replayed batch does not double-register."""

import os
import tempfile

from pyspark.sql import functions as F

from finlake.streaming import streams as S


def test_folder_intake_registers_by_content(spark):
    root = tempfile.mkdtemp(prefix="finlake-landing-")
    landing = os.path.join(root, "landing", "recurring")
    os.makedirs(landing)
    for name, body in [("bank_statement_jan.csv", "a,b\n1,2\n"), ("copy_of_bank.csv", "a,b\n1,2\n"),
                       ("supplier_invoice_7.pdf", "%PDF fake"), ("notes.txt", "skip"), (".hidden.csv", "skip"),
                       ("~$lock.xlsx", "skip")]:
        with open(os.path.join(landing, name), "w") as fh:
            fh.write(body)
    registry, chk = os.path.join(root, "registry"), os.path.join(root, "chk")
    S.folder_intake_stream(spark, os.path.join(root, "landing"), registry, chk).awaitTermination()
    reg = spark.read.parquet(registry)
    names = {r.filename: r.decision for r in reg.collect()}
    assert set(names) == {"bank_statement_jan.csv", "copy_of_bank.csv", "supplier_invoice_7.pdf"}
    assert sorted(names.values()) == ["duplicate", "new", "new"]
    # second availableNow run: nothing new arrives, registry unchanged
    S.folder_intake_stream(spark, os.path.join(root, "landing"), registry, chk).awaitTermination()
    assert spark.read.parquet(registry).count() == 3
    assert reg.filter(F.col("sha256").isNull()).count() == 0


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    """A table may be one file or a folder of files; the earliest document of a text is the same either way."""
    rows = [(i, f"text {i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.orderBy(F.col("doc_id").desc()).repartition(5).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "part"))
    os.makedirs(tmp_path / "one")
    file = next(p for p in os.listdir(tmp_path / "part") if p.endswith(".parquet"))
    os.rename(tmp_path / "part" / file, tmp_path / "one" / "documents.parquet")
    for kind in ("many", "one"):
        found = S.run_document_dedupe(spark, str(tmp_path / kind)).collect()
        assert sorted((r.doc_id, r.original_id, r.decision) for r in found) == [(i, i % 7, "new" if i < 7 else "duplicate") for i in range(40)]
