"""Streaming queries: each runs its Structured Streaming job to completion (availableNow) and
returns the published sink table read back as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..context import Ctx
from ..registry import query
from ..streaming import streams as S


@query("stream_daily_event_flow", """
SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS events,
       round(sum(value), 2) AS value FROM events GROUP BY 1, 2""")
def q_stream_daily_event_flow(c: Ctx):
    """Daily event counts and value per type from the event stream (complete mode, late rows kept)."""
    return S.run_daily_event_flow(c.spark, c.sf_dir)


@query("stream_file_dedupe", """
WITH h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents),
f AS (SELECT sha256, min(doc_id) AS first_id FROM h GROUP BY 1)
SELECT h.doc_id, h.sha256, f.first_id AS original_id, CASE WHEN h.doc_id = f.first_id THEN 'new' ELSE 'duplicate' END AS decision
FROM h JOIN f USING (sha256)""")
def q_stream_file_dedupe(c: Ctx):
    """Content-hash de-duplication of the document stream against the registry."""
    return S.run_document_dedupe(c.spark, c.sf_dir).select("doc_id", "sha256", "original_id", "decision")
