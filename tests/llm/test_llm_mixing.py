import pytest
from llm_cases import WORD, edge_docs, edge_rows, empty_docs

from finlake.llm import mixing


def _targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        if not open_:
            return {s: most * sizes[s] for s in names}
        level = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= above


def _check(rows, got):
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = _targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]


def test_edge_cases(spark):
    _check(edge_rows(), mixing.plan(edge_docs(spark)).collect())
    assert mixing.plan(empty_docs(spark)).count() == 0
    assert mixing.mix(empty_docs(spark)).count() == 0


def test_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i * 7919 % 40), "en", None if i % 5 == 0 else f"s{i % 5 if i % 50 < 30 else 1}", 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.plan(docs).collect()
    _check(rows, got)
    taken, target = {}, {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    for s in taken:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s]
    again = {r["doc_id"]: r["taken"] for r in mixing.plan(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    mixed = {r["doc_id"]: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert mixed == {r["doc_id"]: r["copies"] for r in got if r["copies"]}


def test_mix_keeps_columns(spark):
    docs = edge_docs(spark)
    assert mixing.mix(docs).columns == docs.columns


def test_many_sources_need_many_rounds(spark):
    sizes = spark.createDataFrame([(f"s{k:03}", 2**(k % 20) + k) for k in range(90)], "source string, source_size long")
    want = _targets({r["source"]: r["source_size"] for r in sizes.collect()})
    for r in mixing.targets(sizes).collect():
        assert r["target"] == pytest.approx(want[r["source"]])
