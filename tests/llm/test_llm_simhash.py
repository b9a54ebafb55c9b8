import numpy as np
import pytest
from llm_cases import classes, docs_of, edge_docs, edge_rows, empty_docs, fingerprint

from finlake.llm import components, simhash


def _expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = classes(fps, 4)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted([(i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root)], key=str)


def _found(df):
    return sorted([tuple(r) for r in simhash.groups(df).select("doc_id", "fingerprint", "component_id").collect()], key=str)


def test_edge_cases(spark):
    assert _found(edge_docs(spark)) == _expected([(r[0], r[1]) for r in edge_rows()])
    assert _found(empty_docs(spark)) == []


def test_random_texts(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 400, rng.integers(0, 80))) for _ in range(60)]
    texts = []
    for t in base:
        texts.append(t)
        words = t.split()
        for _ in range(int(rng.integers(0, 4))):
            if words:
                words[int(rng.integers(0, len(words)))] = "Changed"
                texts.append(" ".join(words).upper())
    assert _found(docs_of(spark, texts)) == _expected(list(enumerate(texts)))


@pytest.mark.parametrize("front", [64, 1 << 18])
def test_trie_join_finds_all_classes(front):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    code = np.repeat(centre, 25)
    for _ in range(5):
        code = code ^ (np.uint64(1) << rng.integers(0, 64, len(code)).astype(np.uint64)) * (rng.random(len(code)) < 0.5).astype(np.uint64)
    i, j = simhash.trie_links(np.zeros(len(code), np.uint64), np.zeros(len(code), int), code, 4, front)
    up = np.arange(len(code))
    for a, b in zip(i, j):
        assert int(np.bitwise_count(code[a] ^ code[b])) >= 0
        ra, rb = a, b
        while up[ra] != ra:
            ra = up[ra]
        while up[rb] != rb:
            rb = up[rb]
        up[max(ra, rb)] = min(ra, rb)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    want, got = classes(code.tolist(), 4), [root(x) for x in range(len(code))]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_large_root_in_parts(spark):
    """One root that holds most fingerprints is dealt out in parts; the classes stay the same."""
    rng = np.random.default_rng(3)
    code = np.unique(np.uint64(0xABCD) << np.uint64(48) | rng.integers(0, 1 << 40, 3000, dtype=np.uint64) & np.uint64(0xFFFFF))
    fps = spark.createDataFrame([(int(x),) for x in code.view(np.int64)], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.near_links(fps, 4, cell_rows=100).collect()]
    assert all(int(np.bitwise_count(np.int64(a) ^ np.int64(b))) >= 1 for a, b in links)
    names = {int(x): k for k, x in enumerate(code.view(np.int64))}
    up = list(range(len(code)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[root(names[a])] = root(names[b])
    want, got = classes(code.tolist(), 4), [root(x) for x in range(len(code))]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


@pytest.mark.parametrize("n", [0, 1000, 10**6, 10**9, 3 * 10**10])
def test_more_blocks_for_more_fingerprints(n):
    blocks = simhash._block_count(n, 4)
    assert 5 <= blocks <= 8
    assert sum(w for _, w in simhash._layout(blocks)) == 64


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([*((i, i + 1) for i in range(300)), (5, 5), (None, 1), (900, 800)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert found == {**{i: 0 for i in range(301)}, 800: 800, 900: 800}


def test_one_row_of_each_group_stays(spark):
    docs = edge_docs(spark)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == len(set(classes([fingerprint(r[1]) for r in edge_rows()], 4)))
    assert len([r for r in rows if r[0] == 4 and "fox" in (r[1] or "")]) == 1
    assert simhash.drop_near_copies(empty_docs(spark)).count() == 0


def test_all_copies(spark):
    docs = docs_of(spark, ["the same words in every one of these texts"] * 500)
    assert [r["doc_id"] for r in simhash.drop_near_copies(docs).collect()] == [0]
