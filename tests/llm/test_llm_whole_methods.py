"""Whole methods: long templates, bootstrapping to its end, mixed line labels, exact sets, all languages."""

import random
import re
import textwrap
from collections import defaultdict
from math import exp, log

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import WORD, docs_of
from test_llm_spans import _personal

from finlake.llm import langid, licenses, linededup, pii, quality

# ------------------------------------------------------------------------------------------- line dedup


def _lines(words, of):
    x = linededup.Lines(pa.array(["a"]))
    x.words, x.of = np.array(words, np.uint64), np.array(of)
    x.doc = x.number = np.arange(max(of) + 1)
    return x


def test_words_alike_in_the_low_bits_stay_apart():
    """Lines whose words differ above the 37 low bits of their hashes have other digests, and other sizes."""
    levels = np.zeros(1 << linededup.TABLE_BITS, np.uint8)
    a, b = 5, 5 | 1 << 40
    x = _lines([a, b, a, b, a, b, a, 9, b, 9], [0, 1, 2, 2, 2, 2, 2, 3, 4, 4])
    (lines, size, own, check, *_) = next(linededup._prefixes(x, levels, 0.8, 1))
    assert size.tolist() == [1, 1, 2, 1, 2]
    assert len(set(own.tolist())) == 5 and len(set(check.tolist())) == 5
    again = next(linededup._prefixes(_lines([b, a, a], [0, 0, 0]), levels, 0.8, 1))
    assert (again[2][0], again[3][0]) == (own[2], check[2])


def test_digests_of_words_and_of_lines_agree():
    x = linededup.Lines(pa.array(["the cat sat on the mat\none\n\ntwo two"]))
    own = next(linededup._prefixes(x, np.zeros(1 << linededup.TABLE_BITS, np.uint8), 0.8, 1))[2]
    edge = np.searchsorted(x.of, np.arange(4))
    want = [linededup._sums(np.unique(x.words[a:b]), np.zeros(1, np.int64))[0][0] for a, b in zip(edge, edge[1:])]
    assert own.tolist() == want


# --------------------------------------------------------------------------------------------- licenses


def test_templates_of_any_length(spark):
    """Templates of 20 to 500 words, verbatim on one line, wrapped, and with words left out, wherever they begin."""
    rng = random.Random(3)
    templates = [(f"t{n}", " ".join(rng.choice("abcdefgh") + str(rng.randrange(n)) + f"x{n}" for _ in range(n))) for n in (20, 33, 64, 65, 100, 200, 500)]
    texts = []
    for _, template in templates:
        for before in (0, 7, 31, 50, 131, 260):
            words = [w for w in template.split() if before % 2 == 0 or rng.random() > 0.15]
            texts.append("filler " * before + "\n" + textwrap.fill(" ".join(words), 72) + "\nfiller" * 9)
            texts.append("filler " * before + " ".join(words) + " filler" * 700)
            texts.append(" ".join(words[: len(words) // 2]))
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in licenses.summary(licenses.scan(docs_of(spark, texts), templates=templates, across=True)).collect()}
    for i, text in enumerate(texts):
        words = text.split()
        for label, template in templates:
            wanted, n = set(template.split()), len(template.split())
            holds = lambda size: any(len(wanted & set(words[a : a + size])) >= licenses.CONTAINED * len(wanted) - 1e-9 for a in range(max(1, len(words) - size + 1)))
            if holds(n):
                assert label in got[i]
            elif not holds(len(words)):
                assert label not in got[i]


# ----------------------------------------------------------------------------------------- personal data


def _bootstrapped(texts):
    """All spans by contexts, as a plain loop."""
    shaped = lambda w: re.sub("[0-9]", "0", w.lower())
    after = lambda before: [shaped(before[-1])] + ([f"{shaped(before[-2])} {shaped(before[-1])}"] if len(before) > 1 else []) if before else []
    sown, seeds, degree, met, places = defaultdict(int), set(), defaultdict(int), defaultdict(int), []
    sown_kinds = set()
    for i, text in enumerate(texts):
        words = [(m.group(), m.start()) for m in WORD.finditer(text or "")]
        for kind, a, b in _personal(text):
            before = [w for w, s in words if s + len(w) <= a]
            if a and re.match(r"[\x20\x09-\x0D]", text[a - 1]):
                for p in after(before):
                    sown[p, text[a:b].lower()] += 1
                    sown_kinds.add((kind, text[a:b].lower()))
        for k, (w, start) in enumerate(words):
            for p in after([v for v, _ in words[max(0, k - 2) : k]]):
                degree[p] += 1
                core = re.search(pii._CORE, w)
                if core and re.search("[0-9@]", core.group()):
                    met[p, core.group().lower()] += 1
                    places.append((i, p, core.group(), start + core.start()))
    seeds = sown_kinds
    graph = {e: max(sown.get(e, 0), met.get(e, 0)) for e in {*sown, *met}}
    known = {value: {} for _, value in seeds}
    for kind, value in seeds:
        known[value][kind] = 1.0
    while True:
        total, support = defaultdict(float), defaultdict(int)
        for (p, value), n in graph.items():
            for kind, score in known.get(value, {}).items():
                total[p, kind] += score * n
                support[p, kind] += 1
        accepted = {k: min(1.0, s / degree[k[0]]) for k, s in total.items() if support[k] >= pii.SUPPORT and degree[k[0]] and s / degree[k[0]] >= pii.CONFIDENCE}
        doubt = defaultdict(float)
        for p, value in graph:
            for (q, kind), c in accepted.items():
                if p == q and value not in known:
                    doubt[value, kind] += log(max(1e-6, 1 - c))
        new = defaultdict(list)
        for (value, kind), d in doubt.items():
            if 1 - exp(d) >= pii.SCORE:
                new[value].append((-(1 - exp(d)), kind))
        if not new:
            break
        for value, found in new.items():
            known[value] = {min(found)[1]: -min(found)[0]}
    spans = defaultdict(set)
    for i, p, core, at in places:
        for (q, kind) in accepted:
            if p == q and kind in known.get(core.lower(), {}) and not any(a < at + len(core) and at < b for _, a, b in _personal(texts[i])):
                spans[i].add(f"{kind}:{at}:{at + len(core)}")
    return spans


def _spans(spark, texts):
    got = {r["doc_id"]: set(filter(None, r["spans"].split(","))) for r in pii.summary(docs_of(spark, texts)).collect()}
    return {i: s - {f"{k}:{a}:{b}" for k, a, b in _personal(texts[i])} for i, s in got.items()}


def test_found_instances_induce_patterns(spark):
    """Seeds teach a context; what stands there teaches a second one, and that a third: no seed stands there."""
    names = [[f"agent{k}-{i}x" for i in range(n)] for k, n in enumerate((20, 6, 1))]
    texts = [f"please write mail: u{i}@site.com now" for i in range(200)]
    texts += [f"please write mail: {v} now" for v in names[0]]
    texts += [f"signed by handle= {v} today" for v in names[0] + names[1]]
    texts += [f"the badge# {v} opens" for v in names[1] + names[2]] + ["the badge# last99z opens", "a word last99z here"]
    got = _spans(spark, texts)
    assert got == {i: _bootstrapped(texts)[i] for i in range(len(texts))}
    assert all(got[i] for i in range(200, len(texts) - 1)) and not got[len(texts) - 1]


def test_bootstrapping_equals_a_plain_loop(spark):
    rng = random.Random(21)
    contexts = ["mail:", "write to", "call", "id", "ref no", "the", "of"]
    values = [f"u{i}@site.com" for i in range(12)] + [f"+1 222 333 44{i:02d}" for i in range(8)] + [f"10.0.0.{i}" for i in range(8)] + [f"acct-{i}q" for i in range(25)]
    mates = {c: rng.sample(values[:12] if k % 2 else values[20:28], 8) + rng.sample(values[28:], 2) for k, c in enumerate(contexts[:5])} | {c: values + ["plain", "words"] * 30 for c in contexts[5:]}
    for _ in range(3):
        texts = [" ".join(f"{(c := rng.choice(contexts))} {rng.choice(mates[c])} filler" for _ in range(rng.randint(1, 4))) for _ in range(250)]
        texts += ["", None, texts[0], texts[0]]
        want = _bootstrapped(texts)
        assert any(want.values())
        assert _spans(spark, texts) == {i: want[i] for i in range(len(texts))}


# --------------------------------------------------------------------------------------------- line labels


def test_line_labels():
    one, two = np.array([1, 2, 3, 9], np.uint64), np.array([4, 5, 9, 0], np.uint64)
    keys = [one, two, np.array([6, 9], np.uint64), one[:3], one[:3]]
    words = [np.array([5, 5, 5, 4]), np.array([5, 5, 4, 0]), np.array([3, 4]), np.array([5, 5, 5]), np.array([5, 5, 5])]
    got = [y.tolist() for y in quality.line_labels(np.array([1, 1, 1, 0, 0]), keys, words)]
    # 9 is in three runs; in the third it holds most words, and so do 1, 2 and 3 in the first
    assert got == [[1, 1, 1, 1], [1, 1, 0, 1], [1, 1], [0, 0, 0], [0, 0, 0]]


def test_a_pasted_footer_gets_its_own_label(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    field = quality.train(docs, labels)
    rows = docs.join(labels, "doc_id").filter("quality in (0, 1) and text is not null").select("text", "quality").orderBy("doc_id").collect()
    good = [r["text"].split("\n") for r in rows if r["quality"] == 1 and r["text"].count("\n") >= 3][:40]
    bad = [r["text"].split("\n") for r in rows if r["quality"] == 0 and r["text"].strip()][:40]
    texts = ["\n".join(g + b[:3]) for g, b in zip(good, bad)]
    got = quality.judge(docs_of(spark, texts), field).collect()
    assert sum(0 < r["content_share"] < 1 for r in got) >= 0.5 * len(texts)
    assert field.step[0, 0] + field.step[1, 1] > field.step[0, 1] + field.step[1, 0]


def test_runs_are_drawn_from_the_whole_text(spark):
    """Low-quality lines that only stand behind the first lines of a text are learned too."""
    good = "\n".join(f"A plain and rather ordinary sentence, number {i}, tells of things." for i in range(30))
    bad = good + "\n" + "\n".join("$$$ !!! CLICK $$$ NOW !!! ###" for _ in range(400))
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r["doc_id"]: r["content_share"] for r in quality.judge(docs_of(spark, [bad, good]), quality.train(docs, labels)).collect()}
    assert got[0] < quality.CONTENT < got[1]


# ----------------------------------------------------------------------------------------------- language


def test_convolution_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    network = langid.Network(["a", "b", "c"])
    network.p["bias"] = rng.normal(size=len(network.p["bias"])).astype(np.float32)
    x = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    for row, got in zip(x, network.probabilities(x)):
        embedded, top = network.p["embed"][row], []
        for f in range(langid.FILTERS * len(langid.WIDTHS)):
            width = langid.WIDTHS[f // langid.FILTERS]
            kernel = network.p["conv"][:, f].reshape(-1, langid.EMBED)[:width]
            places = langid.WINDOW - max(langid.WIDTHS) + 1
            top.append(max(0.0, max((embedded[a : a + width] * kernel).sum() for a in range(places)) + network.p["bias"][f]))
        z = np.array(top) @ network.p["out"] + network.p["out_bias"]
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got == pytest.approx(want, abs=1e-4)


def test_more_languages_than_the_bound_are_an_error(spark):
    docs = spark.createDataFrame([(i, f"text of language {i}", f"l{i}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, languages=3)
    assert len(langid.train(docs).languages) > 3
