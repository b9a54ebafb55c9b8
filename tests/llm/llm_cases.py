"""Cases that every operator must take, and plain versions to compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LONG = " ".join(f"word{i % 997}x" for i in range(30_000))
TEXTS = [
    None,
    "",
    " \t\n\x0b ",
    "one",
    "The Quick brown fox jumps over the lazy dog again and again.",
    "The Quick brown fox jumps over the lazy dog again and again.",
    "12345 -- 67 !!",
    "né à l'été\nça\n\nné à l'été où \U0001f642 est-il",
    LONG,
    "a" * 30_000,
    "x\n" * 500 + "tail of the text\r\nlast",
]
#: Columns with names that the operators use for results and inside.
EXTRA = ["fingerprint", "component_id", "size", "target", "taken", "copies", "n_tokens", "ids", "kept", "lang_pred", "score", "key", "kind", "h", "doc", "line", "lines", "root", "llm_key", "llm_of", "n_words", "spans", "labels", "part", "guard", "rate", "seed"]


def edge_rows():
    rows = []
    for i, t in enumerate(TEXTS):
        rows.append((i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", None if t is None else len(t)))
    rows.append(rows[4])  # a repeated row
    rows.append((4, "another text under the same id", "en", "s1", 30))
    rows.append((None, "no id at all here", "en", "s2", 17))
    rows.append((None, None, None, None, None))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark):
    """Edge cases with extra columns of clashing names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    return docs.select("*", *[F.lit("clash").alias(c) for c in EXTRA])


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    ones = np.array([int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)])
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(h))


def classes(codes: list[int], budget: int) -> list[int]:
    """Class of each code when codes within ``budget`` bits are linked."""
    code, up = np.array(codes, np.uint64), list(range(len(codes)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(code)):
        for j in np.flatnonzero(np.bitwise_count(code[i] ^ code[i + 1 :]) <= budget) + i + 1:
            up[find(int(j))] = find(i)
    return [find(i) for i in range(len(code))]


def base_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            again[i] = again[i + 1] = again[i + 2] = True
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), copies, sum(again)


def later_lines(rows, similar=0.8, least=1):
    """(doc_id, line) of lines that match an earlier one; rows have distinct ids."""
    lines, having, gone = [], defaultdict(list), set()
    for doc, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            words = frozenset(WORD.findall(line.translate(LOWER)))
            if len(words) < least:
                continue
            shared = Counter(m for w in words for m in having[w])
            if any(n >= similar * (len(words) + len(lines[m]) - n) - 1e-9 for m, n in shared.items()):
                gone.add((doc, k))
            for w in words:
                having[w].append(len(lines))
            lines.append(words)
    return gone


def spans_text(spans, order) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, order.index(k), b, k) for k, a, b in spans))
