"""The thin queries ``opN_<name>`` over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import bpe, chunks, langid, licenses, linededup, mixing, pii, quality, resample, runs, secrets, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def op(name: str, sql: str | None = None, beside: tuple[str, ...] = ()):
    """Register a query over ``documents`` and the tables named ``beside`` it."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(*[spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet") for table in ("documents", *beside)])

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@op("op1_simhash")
def op1(docs: DataFrame) -> DataFrame:
    """Four-word shingles, XXH64 with seed 42, links at 4 or fewer differing bits."""
    return simhash.groups(docs, words=4, budget=4).select("doc_id", "fingerprint", "component_id")


@op("op2_mixing", mixing.SQL)
def op2(docs: DataFrame) -> DataFrame:
    """Weights 3, 1, 2; 150 % of all sizes; targets of at most twice a source's size."""
    return mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken")


@op("op3_pii")
def op3(docs: DataFrame) -> DataFrame:
    """Fixed patterns and bootstrapped contexts."""
    return pii.summary(docs)


@op("op4_bpe")
def op4(docs: DataFrame) -> DataFrame:
    """Ids and decoded text of the public word vocabulary, as digests."""
    return bpe.encode(docs, outputs=("ids_sha256", "decoded_sha256"))


@op("op5_quality", beside=("labels",))
def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rules and line labels; the field is fitted on the labelled texts."""
    found = quality.judge(docs, quality.train(docs, labels))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


@op("op6_langid")
def op6(docs: DataFrame) -> DataFrame:
    """Train on rows that are not held out, predict for every row."""
    return langid.predict(docs, langid.train(docs))


@op("op7_chunks")
def op7(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    return chunks.compare_with_edits(docs)


@op("op8_linededup")
def op8(docs: DataFrame) -> DataFrame:
    """Texts without lines, of one word or more, that match an earlier line of any text at Jaccard 0.8 or more."""
    return linededup.dedup(docs.select("doc_id", "text"), least=1, counts=True)


@op("op9_licenses")
def op9(docs: DataFrame) -> DataFrame:
    """Phrases and template blocks of every text, within lines and across line ends."""
    return licenses.summary(licenses.scan(docs, across=True))


@op("op10_secrets")
def op10(docs: DataFrame) -> DataFrame:
    """Fixed patterns and linked weak candidates."""
    return secrets.summary(docs)


@op("op11_resample", resample.SQL, beside=("benchmark",))
def op11(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Single words in 10,000 buckets; a tenth of the documents with 20 words or more, drawn towards ``benchmark``."""
    return resample.draw(docs, benchmark)


@op("op12_toxicity", beside=("labels",))
def op12(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labelled rows that are not held out, score every row."""
    return toxicity.score(docs, toxicity.train(docs, labels))


def looped_tails(doc_ids: list, first: np.ndarray) -> np.ndarray:
    """The word to read at each place: of one document in ten (by crc32 of the doc_id) a tail of words
    becomes a loop of its first few. Rows without a doc_id stay as they are."""
    take = np.arange(first[-1])
    for doc, a, b in zip(doc_ids, first[:-1].tolist(), first[1:].tolist(), strict=True):
        if doc is None or a == b:
            continue
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            n, g = b - a, h // 10
            start = g % n
            period = 1 + (n - start) // (3 + g % 8)
            take[a + start : b] = a + start + np.arange(n - start) % period
    return take


@op("op13_runs")
def op13(docs: DataFrame) -> DataFrame:
    """Runs of six words or more, and four periods or more, in texts some of which got a looped tail."""
    return runs.summary(docs, least=6, times=4, edit=looped_tails)
