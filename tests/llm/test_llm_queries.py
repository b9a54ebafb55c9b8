"""The registered queries and the pipeline."""

import importlib

import pytest
from llm_cases import SCHEMA, edge_rows
from oracle_harness import compare

import __spark_entry__ as entry
from finlake.llm import queries as llm

NAMES = ["op1_simhash", "op2_mixing", "op3_pii", "op4_bpe", "op5_quality", "op6_langid", "op7_chunks", "op8_linededup", "op9_licenses", "op10_secrets", "op11_resample", "op12_toxicity", "op13_runs"]


def test_all_registered():
    assert list(k for k in entry.queries() if k.startswith("op") and "_" in k and k in llm.QUERIES) and set(NAMES) == set(llm.QUERIES)
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_document(spark, sf_small, name):
    rows = entry.queries()[name](spark, sf_small)
    n = spark.read.parquet(f"{sf_small}/documents.parquet").count()
    assert rows.count() == n and rows.columns[0] == "doc_id"


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_oracle(spark, sf_small, name):
    assert compare(spark, sf_small, [name], verbose=False)[name][0] == "ok"


@pytest.fixture()
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline_stages(spark, sf_small, pipeline, tmp_path):
    """Each stage on what the one before it kept, against what its operator says."""
    from finlake.llm import langid, linededup, mixing, simhash

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_small)
        if k < 4:
            assert out.columns == docs.columns
        path = str(tmp_path / f"{k}-{name}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        rows, before = [r["doc_id"] for r in out.collect()], [r["doc_id"] for r in docs.collect()]
        if name == "language_id":
            bad = {r["doc_id"] for r in langid.predict(docs, langid.train(docs)).collect() if r["lang_pred"] == "und" or r["score"] < pipeline.LEAST_SCORE}
            assert set(rows) == set(before) - bad and len(rows) == len(before) - len(bad)
        elif name == "line_dedup":
            assert sorted(rows) == sorted(before)
            gone = linededup.later_matches(docs).count()
            lines = lambda d: sum((r["text"] or "").count("\n") + 1 for r in d.collect())
            assert 0 <= gone - (lines(docs) - lines(out)) <= len(before)  # a text without lines left still counts one
        elif name == "near_dedup":
            assert sorted(rows) == sorted({r["component_id"] for r in simhash.groups(docs).collect()})
        elif name == "mix_sources":
            want = {r["doc_id"]: r["copies"] for r in mixing.plan(docs).collect() if r["copies"]}
            assert {i: rows.count(i) for i in set(rows)} == want
        else:
            assert sorted(rows) == sorted(before)
        docs = out


def test_pipeline_edges(spark, pipeline, tmp_path):
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    empty = tmp_path / "empty"
    spark.createDataFrame([], SCHEMA).write.parquet(str(empty / "documents.parquet"))
    assert pipeline.run(spark, str(empty)).count() == 0


def test_entry_without_the_package(monkeypatch):
    """The other queries stay when the training-data files are deleted."""
    import sys

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("finlake.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m.startswith("finlake.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    import finlake

    if hasattr(finlake, "llm"):
        monkeypatch.delattr(finlake, "llm")
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    again = importlib.reload(entry)
    assert "trial_balance" in again.queries() and not set(NAMES) & set(again.queries()) and "op2_mixing" not in again.oracle_sql()
