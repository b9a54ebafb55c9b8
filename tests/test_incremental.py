"""Incremental-load properties: re-ingesting the stored rows changes nothing; A -> B -> A is two changes."""

from pyspark.sql import functions as F

from finlake.context import Ctx
from finlake.operators import incremental as INC
from finlake.plans import queries_intake as QI
from paths import SF_SMALL


def test_reingest_same_batch_is_all_unchanged(spark):
    c = Ctx(spark, SF_SMALL)
    same = QI._keyed(c.batch_old)
    out = INC.fingerprint_versions(same, QI.fingerprint_state(c))
    counts = {r.decision: r.rows for r in INC.change_counts(out).collect()}
    assert counts == {"unchanged": c.batch_old.count()}


def test_a_b_a_counts_two_changes(spark):
    state = spark.createDataFrame([("t", "k", "hA", 1, "lf-t-1")],
                                  "document_type string, business_key string, row_hash string, record_version int, record_id string")
    batch = spark.createDataFrame([("t", "k", "hB", 1), ("t", "k", "hA", 2), ("t", "k", "hA", 3)],
                                  "document_type string, business_key string, row_hash string, seq int")
    got = [(r.seq, r.decision, r.record_version) for r in INC.fingerprint_versions(batch, state).orderBy("seq").collect()]
    assert got == [(1, "changed", 2), (2, "changed", 3), (3, "unchanged", 3)]


def test_upsert_keeps_absent_keys(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    rows = spark.createDataFrame([("b", 20, 1), ("b", 21, 2), ("c", 3, 1)], "k string, v int, seq bigint")
    got = sorted(tuple(r) for r in INC.incremental_upsert(t, rows, ["k"], "seq").collect())
    assert got == [("a", 1), ("b", 21), ("c", 3)]
