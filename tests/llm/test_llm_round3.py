"""Importance resampling, toxicity and periodic runs against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import LOWER, TEXTS, WORD, docs_of, edge_docs, empty_docs, sha
from pyspark.sql import functions as F

from finlake.llm import queries, resample, runs, toxicity

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# -- importance resampling ------------------------------------------------------------------------


def plain_draw(docs, target, share=10, least=20, most=1, buckets=10_000):
    """Rows (doc_id, n_features, weight, score, rank) by the definition."""

    def grams(text):
        words = ALNUM.findall((text or "").translate(LOWER))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    parsed = [(i, *grams(text)) for i, text in docs]
    for _, _, f in parsed:
        s.update(map(bucket, f))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, words, f in parsed:
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return rows, able[: share * len(able) // 100]


def key(row):
    return tuple((v is None, v or 0) for v in row)


@pytest.mark.parametrize("most", [1, 3])
def test_draw_equals_plain(spark, most):
    rng = random.Random(most)
    docs = [(i, None if i == 7 else " ".join(rng.choice(["Alpha", "beta", "né", "x1", "gamma-delta", "ZZ"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    target = ["alpha beta alpha", "né x1", None, ""]
    rows, drawn = plain_draw(docs, target, most=most)
    place = {id(r): k + 1 for k, r in enumerate(drawn)}
    want = sorted([(*r[:4], place.get(id(r))) for r in rows], key=key)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = resample.draw(table, spark.createDataFrame([(t,) for t in target], "text string"), most_words=most).collect()
    assert sorted(map(tuple, got), key=key) == want


def test_draw_edges(spark):
    got = resample.draw(edge_docs(spark), docs_of(spark, ["the quick"]).drop("doc_id"), least_words=2, share=50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and got.count() == edge_docs(spark).count()
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1))
    assert resample.draw(empty_docs(spark), empty_docs(spark)).count() == 0
    assert resample.draw(edge_docs(spark), empty_docs(spark)).count() == edge_docs(spark).count()


@pytest.mark.parametrize("rows", [1, 9, 500])
@pytest.mark.parametrize("ties", [1, 50])
def test_cutoff_is_the_key_at_that_place(spark, rows, ties):
    """Few keys are sorted at once here, so that many rounds of medians are needed; repeated keys tie."""
    rng = random.Random(rows)
    data = [(rng.choice([None, *range(20)]) if ties > 1 else i, rng.randint(-rows, rows) // ties, i) for i in range(rows)]
    table = resample.cut(spark.createDataFrame(data, "doc_id long, score long, at long").repartition(6))
    order = sorted((-s, d is None, d or 0, a) for d, s, a in data)
    for count in sorted({0, rows // 10, rows // 2, rows - 1}):
        down, nameless, doc, at = order[count]
        assert resample.cutoff(table, count, last=1) == (down, int(nameless), doc, at)
    assert resample.cutoff(table, rows, last=1) is None


def test_crc32_of_all_lengths():
    words = [bytes(range(n % 200)) * 4 for n in range(300)]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    assert resample.crc32(data, ends - [len(w) for w in words], ends).tolist() == [zlib.crc32(w) for w in words]


# -- periodic runs --------------------------------------------------------------------------------


def plain_runs(words, least=6, times=4):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            seg = words[i : j + q]
            if j > i and len(seg) >= max(least, times * q) and all(seg[p:] != seg[:-p] for p in range(1, q)):
                out.append((i, len(seg), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_summary(doc, text, edit=True, least=6, times=4):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc).encode())
    if edit and doc is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, least, times)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(kept))


def looping_texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        letters = "abcdefg"[: rng.choice([1, 2, 3, 5, 7])]
        words = [rng.choice(letters) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.6:
            loop = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
            at = rng.randint(0, len(words))
            words[at:at] = (loop * 9)[: rng.randint(1, 8 * len(loop))]
        yield " ".join(words)


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (5, 3), (9, 4)])
@pytest.mark.parametrize("prune", [True, False])
def test_runs_equal_plain(least, times, prune):
    texts = list(looping_texts(300, least))
    for a in range(0, len(texts), 5):  # several texts share a tree
        x = runs.Runs(pa.array(texts[a : a + 5]), least, times, prune=prune)
        for t, text in enumerate(texts[a : a + 5]):
            got = [(int(s), int(n), int(q)) for of, s, n, q in zip(x.text, x.start, x.length, x.period) if of == t]
            assert got == plain_runs(text.split(), least, times)


def test_extensions_equal_plain():
    rng = random.Random(4)
    for _ in range(20):
        s = [rng.randint(1, 3) for _ in range(rng.randint(2, 200))] + [0]
        tree = runs.SuffixTree(s, 1)
        assert tree.order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        assert tree.inverse.tolist() == sorted(range(len(s)), key=lambda i: [-c if c else -9 for c in s[i:]])
        i, j = zip(*[p for p in itertools.product(range(len(s)), repeat=2) if p[0] != p[1]])
        want = [next(k for k in range(len(s)) if max(a, b) + k >= len(s) or s[a + k] != s[b + k]) for a, b in zip(i, j)]
        assert tree.extension(np.array(i), np.array(j)).tolist() == want


def test_runs_query_equals_plain(spark, sf_small, tmp_path):
    rows = [(i, t) for i, t in enumerate(looping_texts(300, 8))] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect() if len(r["text"] or "") < 3000]
    rows.append((None, "x " * 9))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.QUERIES["op13_runs"](spark, str(tmp_path)).collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 5000]
    want = {(i, t): plain_summary(i, t) for i, t in short}
    assert len(got) == len(rows) and Counter(g for g in got if g[0] in {i for i, _ in short}) == Counter(want[r] for r in short)


def test_runs_edges(spark):
    assert runs.summary(edge_docs(spark)).count() == edge_docs(spark).count()
    assert runs.summary(empty_docs(spark)).count() == 0 and runs.find(empty_docs(spark)).count() == 0
    texts = ["go a b a b a b a b stop", None, "a a a"]
    assert [tuple(r) for r in runs.find(docs_of(spark, texts)).collect()] == [(0, 1, 8, 2)]
    assert {r["doc_id"]: r["text"] for r in runs.collapse(docs_of(spark, texts)).collect()} == {0: "go a b stop", 1: "", 2: "a a a"}
    long = docs_of(spark, [" ".join(str(i % 5000) for i in range(25_000))])
    assert [tuple(r) for r in runs.find(long).collect()] == [(0, 0, 25_000, 5000)]


# -- toxicity -------------------------------------------------------------------------------------


def plain_kernel(a, b):
    """Normalised weight of all common subsequences of three symbols, by trying all places."""

    def places(s):
        out = Counter()
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i < toxicity.SPAN:
                out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    x, y = places(a), places(b)
    dot = lambda u, v: sum(w * v[t] for t, w in u.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def joined(words):
    return np.frombuffer(b"".join(words), np.uint8), np.r_[0, np.cumsum([len(w) for w in words])]


def test_kernel_equals_plain():
    x = toxicity.Segments(pa.array(["banana bananna Nana idiot i-d-i-o-t id1ot aaaaaaaaa über q " + "xy" * 40]))
    words = [x.symbol[a:b].tobytes() for a, b in zip(x.start, x.stop)]
    assert words[3] == words[4]  # marks inside a word count for nothing
    got = toxicity.kernel(*joined(words), *joined(words))
    for i, j in itertools.product(range(len(words)), repeat=2):
        assert got[i, j] == pytest.approx(plain_kernel(words[i], words[j]), abs=1e-5)


def test_segments():
    def words(text):
        x = toxicity.Segments(pa.array([text], pa.string()))
        return [(int(s), x.symbol[a:b].tobytes()) for s, a, b in zip(x.sentence, x.start, x.stop)]

    assert [w for _, w in words("He is an i d i o t today.")] == [w for _, w in words("he is an IDIOT today")]
    assert [s for s, _ in words("One two. Three!\nfour\n\nfive six")] == [0, 0, 1, 2, 3, 3]
    assert [len(w) for _, w in words("z" * 40)] == [24, 24, 18] and words(None) == words("... -- !") == []


def insults(seed, n=400):
    rng = random.Random(seed)
    syllables = ["ta", "re", "lo", "mi", "sen", "dor", "pa", "ku", "li", "bo"]
    rows, marks = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["gwexfrip", "Zhuckvin!", "vrexhog"])
        if rng.random() < 0.5:
            words[10] += "."
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    return rows, marks


def test_toxicity_learns_and_bears_changed_words(spark):
    rows, marks = insults(1)
    changed = ["talo gwexxfrip mire", "lo z h u c k v i n pa", "sen vr-ex-hog dor", "mi gwekxfrip lo"]
    clean = ["talo mire sen dorpa", "kuli bota remi losen"]
    rows += [(10_000 + i, t) for i, t in enumerate(changed + clean)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, machine).collect()}
    held = [(got[i]["predicted"], t) for i, t in marks if got[i]["held_out"]]
    assert len(held) > 50 and sum(p == t for p, t in held) >= 0.97 * len(held)
    assert [got[10_000 + i]["predicted"] for i in range(6)] == [1, 1, 1, 1, 0, 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    # the folded table gives what the landmarks say, and the same rows train the same machine
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert np.allclose(machine.table, again.table, atol=1e-6) and machine.middle == pytest.approx(again.middle, abs=1e-6)


def test_held_out_labels_are_never_read(spark):
    rows, marks = insults(2, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.train(docs, labels).table, toxicity.train(docs, flipped).table)


def test_toxicity_edges(spark):
    rows, marks = insults(3, 120)
    machine = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    out = toxicity.score(edge_docs(spark), machine)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == edge_docs(spark).count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.collect())
    assert toxicity.score(empty_docs(spark), machine).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(edge_docs(spark), no_labels) is None
    assert {r["score"] for r in toxicity.score(edge_docs(spark), None).collect()} == {toxicity.UNSEEN}


def test_squared_hinge_is_at_its_minimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 4)), rng.choice([-1.0, 1.0], 60)
    c = rng.random(60)
    w = toxicity._squared_hinge(x, y, c, np.zeros(5))

    def loss(v):
        return (c * np.maximum(1 - y * (x @ v[:4] + v[4]), 0) ** 2).sum() + toxicity.PENALTY * (v[:4] ** 2).sum() + 1e-8 * v[4] ** 2

    for k in range(5):
        step = np.zeros(5)
        step[k] = 1e-5
        assert abs(loss(w + step) - loss(w - step)) / 2e-5 < 1e-4
