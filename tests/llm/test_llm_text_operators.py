"""BPE, quality rules, language ID, fingerprints and licenses against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
from llm_cases import EXTRA, LOWER, TEXTS, base_quality, docs_of, edge_docs, edge_rows, empty_docs, sha

from finlake.llm import bpe, chunks, langid, licenses, quality

MIXED = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x250), *range(0x300, 0x330), *range(0x370, 0x400), 9, 10, 13, 0x1C, 0, 0x2028, 0x3000, 0x1F600, 0x4E00, 0xFB01]]


# ---------------------------------------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))


def _random_texts(n=1500):
    rng = random.Random(3)
    texts = ["".join(rng.choice(MIXED) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    texts += ["".join(rng.choice("aehinorstl") for _ in range(rng.randint(1, 70))) for _ in range(n)]
    texts += ["".join(rng.choice(["th", "he", "in", "er", "!", "<|", "|>", "startoftext", "<|endoftext|>", " "]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return texts


def test_codec_equals_library(library):
    codec = bpe.codec(bpe.tokenizer_file())
    texts = [t or "" for t in TEXTS] + _random_texts()
    for text, (n, ids, decoded) in zip(texts, codec.written(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert [int(i) for i in ids.split()] == want and n == len(want)
        assert decoded == library.decode(want, skip_special_tokens=False) == codec.decode(want)


def test_automaton_accepts_one_path():
    """A small alphabet, all strings up to seven symbols, against merging by rank."""
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("aa", "aa"), ("ab", "ba"), ("b", "b</w>"), ("a", "bb</w>")]
    vocab = {}
    for name in ["a", "b", "a</w>", "b</w>", *[x + y for x, y in merges]]:
        vocab.setdefault(name, len(vocab))
    machine = bpe.Automaton(vocab, merges)
    rank = {m: r for r, m in reversed(list(enumerate(merges)))}

    def merged(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if best is None:
                return [vocab[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = ["".join("ab"[k >> b & 1] for b in range(n)) for n in range(1, 8) for k in range(1 << n)]
    want = [merged(w) for w in words]
    assert machine.encode_all([w.encode() for w in words]) == want
    assert [machine.encode_long(w.encode()) for w in words] == want


def test_bpe_tables(spark, library):
    got = bpe.encode(edge_docs(spark), outputs=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    texts = sorted([(str(r[0]), r[1] or "") for r in edge_rows()])
    assert len(got) == len(texts)
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == sha(" ".join(map(str, r["ids"]))) and r["decoded_sha256"] == sha(r["decoded"])
    want = sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    assert bpe.encode(empty_docs(spark)).count() == 0


# ---------------------------------------------------------------------------------------------- quality


def test_quality_base(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    got = {r["doc_id"]: r for r in quality.judge(docs_of(spark, texts), None).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, copies, again = base_quality(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, copies, again)
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n)
        assert r["kept"] == (not r["base_failed"])  # without a field every line is content


def _best_path(field, features):
    import itertools

    score = field.scores(features)
    return max(itertools.product((0, 1), repeat=len(features)), key=lambda y: (round(field.start[y[0]] + sum(score[k, v] for k, v in enumerate(y)) + sum(field.step[a, b] for a, b in zip(y, y[1:])), 9)))


def test_viterbi_is_the_best_path():
    import numpy as np

    rng = np.random.default_rng(8)
    field = quality.Field(6)
    field.emit, field.step, field.start = rng.normal(size=(6, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    sizes = [1, 5, 3, 8, 1, 2]
    features = rng.integers(0, 6, (sum(sizes), 3))
    got = field.viterbi(features, np.repeat(np.arange(len(sizes)), sizes))
    at = 0
    for n in sizes:
        assert tuple(got[at : at + n]) == _best_path(field, features[at : at + n])
        at += n


def test_quality_learns_from_labels(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("not base_failed")
    good = got.filter("quality = 1")
    assert good.filter("kept").count() >= 0.99 * good.count()
    bad = got.filter("quality = 0")
    assert bad.filter("kept").count() <= 0.25 * bad.count()


def test_quality_edges(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, none) is None
    assert quality.judge(docs, None).count() == len(edge_rows())
    assert quality.judge(empty_docs(spark), None).count() == 0


# ---------------------------------------------------------------------------------------------- language


def test_language(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    network = langid.train(docs)
    got = langid.predict(docs, network).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.keep_known(docs, network, 0.3).count() >= 0.99 * docs.count()
    edges = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(edge_docs(spark), network).collect() if r["lang_pred"] == "und"}
    assert edges == {(0, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0), (6, "und", 0.0), (None, "und", 0.0)}
    kept = langid.keep_known(edge_docs(spark), network, 0.0)
    assert kept.columns == [*docs.columns, *EXTRA] and kept.filter("doc_id in (0, 1, 2, 6)").count() == 0


def test_language_without_labels(spark):
    docs = empty_docs(spark)
    assert langid.train(docs) is None
    assert langid.predict(docs, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edge_docs(spark), None).collect()} == {"und"}


def test_only_text_is_an_input(spark, sf_small):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    network = langid.train(docs)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    one, two = (sorted(map(tuple, langid.predict(d, network).collect())) for d in (docs, other))
    assert one == two


# ---------------------------------------------------------------------------------------------- fingerprints


def _next_texts(rows):
    from pyspark.sql import functions as F  # noqa: F401

    return [rows[(k + 1) % len(rows)][1] or "" for k in range(len(rows))]


@pytest.mark.parametrize("n", [1, 2, 7, 120])
def test_edited_texts(spark, n):
    rng = random.Random(n)
    rows = [(i * 3, None if i % 11 == 5 else "".join(rng.choice("abc dé\U0001f642") for _ in range(rng.randint(0, 900)))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(chunks.compare_with_edits(docs).collect())
    follow = _next_texts(rows)
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    for r, (_, text), after in zip(got, rows, follow):
        text = text or ""
        k = len(text) // 4
        new = text[: len(text) - k] + after[:k]
        own, edit, other = (_fingerprint(t) for t in (text, new, after))
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), sha(new), chunks.written(own), chunks.written(edit))
        assert r["near_edited"] == chunks.likeness(own, edit) and r["near_next"] == chunks.likeness(own, other)


def _fingerprint(text):
    """Chunk by chunk, with the gear hash taken byte by byte."""
    import xxhash

    data, out, start, h = text.encode(), {}, 0, 0
    gear = chunks._GEAR.tolist()
    cuts = []
    for b in data:
        h = (2 * h + gear[b]) & 0xFFFF
        cuts.append(h)
    zero = gear[0]  # a text is preceded by zero bytes
    lead = 0
    for _ in range(chunks.REACH):
        lead = (2 * lead + zero) & 0xFFFF
    h = lead
    hashes = []
    for b in data:
        h = (2 * h + gear[b]) & 0xFFFF
        hashes.append(h)
    while start < len(data):
        end = min(start + chunks.MOST, len(data))
        for place in range(start + chunks.LEAST, end):
            bits = chunks.LOOSE if place > start + chunks.USUAL else chunks.STRICT
            if hashes[place - 1] >> (16 - bits) == 0:
                end = place
                break
        digest = xxhash.xxh3_64_hexdigest(data[start:end])[:12]
        out[digest] = out.get(digest, 0) + end - start
        start = end
    return out


def test_fingerprints_resist_shifts():
    import pyarrow as pa
    from llm_cases import LONG

    from finlake.llm.common import utf8

    a, b, c = chunks.fingerprints(*utf8(pa.array([LONG, "inserted " + LONG, LONG[::-1]])))
    assert chunks.likeness(a, b) > 0.99 and chunks.likeness(a, c) < 0.05
    assert chunks.likeness({}, {}) == 1.0 and chunks.likeness(a, {}) == 0.0
    assert chunks.read(chunks.written(a)) == a


def test_fingerprint_edges(spark):
    got = chunks.compare_with_edits(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    assert {r["fingerprint"] for r in got if r["n_chars"] == 0} == {""}
    assert chunks.compare_with_edits(empty_docs(spark)).count() == 0
    assert chunks.fingerprint(edge_docs(spark)).count() == len(edge_rows())
    large = spark.createDataFrame([(None, "x y"), ((1 << 62) + 1, "a"), ((1 << 62) + 2, "b"), (-5, "c")], "doc_id long, text string")
    assert {r["doc_id"] for r in chunks.compare_with_edits(large).collect()} == {None, (1 << 62) + 1, (1 << 62) + 2, -5}


# ---------------------------------------------------------------------------------------------- licenses

LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _licenses(text):
    text = (text or "").translate(LOWER)
    words = LICENSE_WORD.findall(text)
    base = [(label, i) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels, best = {label for label, _ in base}, 0.0
    for line in text.split("\n"):
        own = LICENSE_WORD.findall(line)
        for at in range(0, max(1, len(own) - licenses.BLOCK_WORDS // 2), licenses.BLOCK_WORDS // 2):
            block = set(own[at : at + licenses.BLOCK_WORDS])
            for label, template in licenses.TEMPLATES:
                wanted = set(template.split())
                share = len(wanted & block) / len(wanted)
                if share >= licenses.CONTAINED:
                    labels.add(label)
                    best = max(best, share)
    starts = [i for _, i in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted(labels)), 1.0 if base else best


def test_licenses(spark):
    rng = random.Random(9)
    pool = [w for _, t in licenses.TEMPLATES for w in t.split()]
    texts = list(TEXTS) + ["MIT\nLicense", "the MIT  license, apache-license GENERAL public\tLicense mit license", "mit licenses", "all\nrights reserved", "All rights (c) reserved!"]
    for _ in range(300):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice([lambda: rng.choice(licenses.TEMPLATES)[1].split(), lambda: [rng.choice(pool) for _ in range(rng.randint(1, 90))], lambda: ["\n"]])()
        texts.append(" ".join(w.upper() for w in words if rng.random() > 0.1))
    got = {r["doc_id"]: r for r in licenses.summary(licenses.scan(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        n, base, first, last, labels, every, score = _licenses(t)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == (n, base, first, last, labels, every), t
        assert r["score"] == pytest.approx(score)


def test_wrapped_licenses(spark, tmp_path):
    """Every template, wrapped at 72 columns (the short ones after every second word), wherever it begins in the text."""
    import textwrap

    from finlake.llm import queries

    texts, want = [], []
    for label, template in licenses.TEMPLATES:
        for before in range(0, 70, 3):
            words = template.split()
            notice = textwrap.fill(template, 72) if len(template) > 72 else "\n".join(" ".join(words[i : i + 2]) for i in range(0, len(words), 2))
            texts.append("filler " * before + "\n" + notice + "\nfiller" * 9)
            want.append(label)
    path = str(tmp_path)
    docs_of(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long").write.parquet(f"{path}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_licenses"](spark, path).collect()}
    for i, label in enumerate(want):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0, texts[i]
    plain = {r["doc_id"]: r["labels"] for r in licenses.summary(licenses.scan(docs_of(spark, texts))).collect()}
    assert any(label not in plain[i].split(",") for i, label in enumerate(want))  # lines alone miss some


def test_license_edges(spark):
    assert licenses.summary(licenses.scan(edge_docs(spark))).count() == len(edge_rows())
    assert licenses.scan(empty_docs(spark)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == sha("")
