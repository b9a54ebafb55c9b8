import random

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import docs_of, edge_docs, edge_rows, empty_docs, later_lines

from finlake.llm import linededup, queries


def _rows(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(n):
        lines = [" ".join(rng.choice(words[: rng.choice([8, 60])]) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 6))]
        if rows and rng.random() < 0.5:
            own = rng.choice(rng.choice(rows)[1].split("\n")).split()
            if own:
                own[rng.randrange(len(own))] = rng.choice(words).upper()
                lines.append(" ".join(own))
        rows.append((d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("cell_rows", "look"), [(8192, 64), (25, 1)])
def test_equals_brute_force(spark, monkeypatch, cell_rows, look):
    """With small cells, common words are dealt out in parts; with one candidate at first, more rounds follow."""
    monkeypatch.setattr(linededup, "LOOK", look)
    rows = _rows(350, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc"], r["line"]) for r in linededup.later_matches(docs, cell_rows=cell_rows).collect()}
    assert found == later_lines(rows)
    texts = {r["doc_id"]: r for r in linededup.dedup(docs, counts=True).collect()}
    for d, text in rows:
        lines = text.split("\n")
        stay = [x for k, x in enumerate(lines) if (d, k) not in found]
        assert texts[d]["text"] == "\n".join(stay)
        assert (texts[d]["n_lines"], texts[d]["n_removed"]) == (len(lines), len(lines) - len(stay))


def test_group_of_near_copies(spark):
    """Every line but the first of a large group goes, though each differs from the others."""
    words = [f"t{i}" for i in range(40)]
    texts = []
    for i in range(1500):
        own = list(words)
        own[i % 40] = f"other{i}"
        texts.append(" ".join(own))
    found = {(r["doc"], r["line"]) for r in linededup.later_matches(docs_of(spark, texts), cell_rows=300).collect()}
    assert found == later_lines(list(enumerate(texts)))
    assert len(found) == 1499


def test_real_texts(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    found = {(r["doc"], r["line"]) for r in linededup.later_matches(docs).collect()}
    assert found == later_lines([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("similar", [0.6, 0.8])
def test_short_lines(spark, similar):
    """With ``least`` 1 lines of one to three words match too."""
    rng = random.Random(7)
    texts = ["\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))) for _ in range(4)) for _ in range(80)]
    found = {(r["doc"], r["line"]) for r in linededup.later_matches(docs_of(spark, texts), similar, 1).collect()}
    assert found == later_lines(list(enumerate(texts)), similar, 1)


def test_query_takes_short_lines(spark, tmp_path):
    texts = ["All rights reserved.\na first text", "all RIGHTS reserved.\n\nanother text", "one\none"]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in queries.QUERIES["op8_linededup"](spark, str(tmp_path)).collect()}
    assert got == {0: (texts[0], 0), 1: ("\nanother text", 1), 2: ("one", 1)}


def test_edges(spark):
    docs = edge_docs(spark)
    out = linededup.dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(edge_rows())
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["text"])
    fox = "The Quick brown fox jumps over the lazy dog again and again."
    assert sorted(by[4]) == [fox, fox, "another text under the same id"]  # a repeated row is one document
    assert by[5] == [""] and by[0] == [None] and by[1] == [""] and by[3] == ["one"]
    assert linededup.dedup(empty_docs(spark)).count() == 0


def test_lines_of_a_long_text():
    x = linededup.Lines(pa.array(["a b\n\nc", "", None, "\nd e f\n", "g"]))
    assert x.doc.tolist() == [0, 0, 3, 4] and x.number.tolist() == [0, 2, 1, 0]


def test_a_lone_open_line_meets_its_whole_group():
    """Of hundreds of lines under one word one is open, and its match lies over 64 places away in size order."""
    n = 400
    e = np.zeros(n, linededup._PREFIX)
    e["doc"], e["own"], e["size"] = np.arange(n), np.arange(n), 20
    e["lo"] = linededup.mixed(np.arange(1, n + 1, dtype=np.uint64))
    for mine, match in ((350, 10), (10, 350)):
        x = e.copy()
        x["lo"][mine], x["lo"][match], x["size"][mine] = 3, 3, 20
        x["doc"][mine], x["doc"][match] = 900, 800
        late, early, _, more = linededup.candidates(x["key"], x, 0.8, linededup.MORE, np.array([mine], np.uint32))
        assert (late.tolist(), early.tolist(), more.tolist()) == ([mine], [match], [False])


def test_candidates_of_open_lines_equal_all_pairs():
    """Every open line gets all earlier candidates, or more than the limit."""
    rng = np.random.default_rng(3)
    for n, limit in ((300, 10_000), (300, 5)):
        e = np.zeros(n, linededup._PREFIX)
        e["key"], e["doc"], e["own"] = rng.integers(0, 2, n), rng.permutation(n), np.arange(n)
        e["size"], e["lo"] = rng.integers(4, 12, n), rng.integers(0, 16, n).astype(np.uint64)
        only = np.sort(rng.choice(n, 12, replace=False)).astype(np.uint32)
        got = linededup.candidates(e["key"], e, 0.8, limit, only)
        pairs = list(zip(got[0].tolist(), got[1].tolist()))
        assert len(set(pairs)) == len(pairs)
        every = linededup.candidates(e["key"], e, 0.8, 10_000)
        want = {(a, b) for a, b in zip(every[0].tolist(), every[1].tolist()) if a in set(only.tolist())}
        assert set(pairs) <= want
        for k in only.tolist():
            have, need = sum(a == k for a, _ in pairs), sum(a == k for a, _ in want)
            assert have == min(need, limit + 1)
