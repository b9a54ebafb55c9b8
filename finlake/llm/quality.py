"""Quality rules and line labels: a linear-chain conditional random field marks each line as content or
boilerplate (Viterbi), and the share of words in content lines decides whether a document is kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, mixed, record, utf8, word_bounds, word_hashes

#: Rules: fewest words, and largest percentage of words in repeated windows. Share of words in content lines
#: from which a document is kept.
LEAST_WORDS = 50
MOST_REPEATED = 50
CONTENT = 0.5
#: The field is fitted on a bounded sample: at most this many labelled texts (by hash), and of each one run
#: of at most this many lines, drawn by hash among all runs of the text.
TEXTS = 2000
RUN_LINES = 24
STEPS = 100
#: A line that this many texts of the sample have is boilerplate in a good text too, unless such lines hold
#: half of the run's words or more: then the text is a copy.
SHARED = 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _between(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marks lie in each interval."""
    sums = np.zeros(len(marks) + 1, np.int32 if len(marks) < 1 << 31 else np.int64)
    np.cumsum(marks, out=sums[1:])
    return (sums[ends] - sums[starts]).astype(np.int64)


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which values occur twice or more. Values alone in a slot of a counting table are passed over
    before the exact comparison."""
    if not len(key):
        return np.zeros(0, bool)
    bits = max(10, int(len(key)).bit_length() + 2)
    slot = (key >> np.uint64(64 - bits)).astype(np.int64)
    likely = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    out = np.zeros(len(key), bool)
    _, back, n = np.unique(key[likely], return_inverse=True, return_counts=True)
    out[likely] = n[back] > 1
    return out


class Lines:
    """Counts of the texts of a column and of all their lines."""

    def __init__(self, texts: pa.Array):
        data, offsets = utf8(texts)
        n_docs = len(offsets) - 1
        self.n_docs = n_docs
        starts, ends, before = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        doc_of_word = np.repeat(np.arange(n_docs), np.diff(before))
        point = (data & 0xC0) != 0x80
        self.n_words = np.diff(before)
        self.word_chars = np.bincount(doc_of_word, _between(point, starts, ends), n_docs).astype(np.int64)
        self.n_symbols = _between(_SYMBOL[data], offsets[:-1], offsets[1:])

        # words in three-word windows that the text has twice or more
        with np.errstate(over="ignore"):
            window = mixed(words[:-2] * np.uint64(0x9E3779B97F4A7C15) + mixed(words[1:-1] + np.uint64(0x51)) * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(words[2:] ^ np.uint64(0xA5A5))) if len(words) > 2 else np.zeros(0, np.uint64)
            inside = doc_of_word[:-2] == doc_of_word[2:] if len(words) > 2 else np.zeros(0, bool)
            place = np.flatnonzero(inside)
            twice = place[_repeated(mixed(window[place] ^ mixed(doc_of_word[place].astype(np.uint64) + np.uint64(1))))]
        again = np.zeros(len(words), bool)
        for k in range(3):
            again[twice + k] = True
        self.n_repeat_words = np.bincount(doc_of_word[again], minlength=n_docs)

        # lines: between line ends and text bounds; an empty text has one empty line
        stops = np.flatnonzero(data == 10)
        doc_of_stop = np.searchsorted(offsets, stops, side="right") - 1
        line_end, line_doc = np.r_[stops, offsets[1:]], np.r_[doc_of_stop, np.arange(n_docs)]
        order = np.lexsort((line_end, line_doc))
        line_end, line_doc = line_end[order], line_doc[order]
        first = np.diff(line_doc, prepend=-1) > 0
        line_start = np.r_[0, line_end[:-1] + 1] if len(line_end) else line_end
        line_start[first] = offsets[line_doc[first]]
        self.line_doc, self.first = line_doc, first
        w0, w1 = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
        self.line_words = w1 - w0
        with np.errstate(over="ignore"):
            self.line_hash = word_hashes(data, line_start, line_end) if len(data) else np.zeros(len(line_doc), np.uint64)
            line_key = mixed(self.line_hash ^ mixed(line_doc.astype(np.uint64) + np.uint64(7)))
        worded = np.flatnonzero(self.line_words > 0)
        _, earliest = np.unique(line_key[worded], return_index=True)
        copy = np.ones(len(worded), bool)
        copy[earliest] = False
        self.copy = np.zeros(len(line_doc), bool)
        self.copy[worded[copy]] = True
        self.n_dup_lines = np.bincount(line_doc[self.copy], minlength=n_docs)

        # features of the field
        upper = (data >= 65) & (data <= 90)
        letter = upper | ((data >= 97) & (data <= 122))
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])
        same_sum = np.r_[0, np.cumsum(same)]
        n_w = np.maximum(self.line_words, 1)
        count = lambda marks: _between(marks, line_start, line_end)
        shares = {
            "symbol": (count(_SYMBOL[data]) / n_w, (0.0, 0.05, 0.3, 0.8)),
            "bang": (count(data == 33) / n_w, (0.0, 0.1, 0.5)),
            "upper": (count(upper) / np.maximum(count(letter), 1), (0.05, 0.3, 0.7)),
            "digit": (count((data >= 48) & (data <= 57)) / np.maximum(line_end - line_start, 1), (0.0, 0.1, 0.4)),
            "comma": (count(data == 44) / n_w, (0.0, 0.1, 0.3)),
            "stop": (count(data == 46) / n_w, (0.0, 0.1, 0.3)),
            "again": ((same_sum[w1] - same_sum[w0]) / n_w, (0.0, 0.1, 0.5)),
            "long": (count(point & ~np.isin(data, [32, 9])) / n_w, (2.5, 4.0, 8.0, 14.0)),
            "words": (self.line_words.astype(float), (0.0, 3.0, 9.0, 30.0)),
            "copy": (self.copy.astype(float), (0.5,)),
        }
        columns, width = [np.zeros(len(line_doc), np.int64)], 1  # column 0 always counts
        for value, edges in shares.values():
            columns.append(width + np.searchsorted(np.array(edges), value, side="left"))
            width += len(edges) + 1
        #: For each line the indices of its features, one of each kind.
        self.features, self.width = np.stack(columns, axis=1), width


class Field:
    """Linear-chain conditional random field over labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, width: int):
        self.emit = np.zeros((width, 2))
        self.step = np.zeros((2, 2))
        self.start = np.zeros(2)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(axis=1)

    def viterbi(self, features: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Best labels of all lines; ``doc`` (ascending) tells the texts apart. Line by line, all texts at once."""
        n = len(doc)
        label = np.zeros(n, np.int64)
        if not n:
            return label
        score = self.scores(features)
        head = np.flatnonzero(np.diff(doc, prepend=-1))
        size = np.diff(np.r_[head, n])
        order = np.argsort(-size, kind="stable")
        head, size = head[order], size[order]
        back = np.zeros((n, 2), np.int8)
        best = self.start + score[head]
        for k in range(1, size[0]):
            m = int(np.searchsorted(-size, -k, side="left"))  # texts with more than k lines
            paths = best[:m, :, None] + self.step[None]
            back[head[:m] + k] = paths.argmax(axis=1)
            best[:m] = paths.max(axis=1) + score[head[:m] + k]
        now = best.argmax(axis=1)
        label[head + size - 1] = now
        for k in range(size[0] - 1, 0, -1):
            m = int(np.searchsorted(-size, -k, side="left"))
            now[:m] = back[head[:m] + k, now[:m]]
            label[head[:m] + k - 1] = now[:m]
        return label

    def fit(self, features: list[np.ndarray], labels: list[np.ndarray], steps: int = STEPS, rate: float = 0.1, penalty: float = 1e-3) -> None:
        """Maximum likelihood by Adam over runs of labelled lines; the expected counts come from forward
        and backward sums over all runs at once."""
        longest = max(len(f) for f in features)
        n, kinds = len(features), features[0].shape[1]
        x = np.zeros((n, longest, kinds), np.int64)
        size = np.array([len(f) for f in features])
        y = np.zeros((n, longest), np.int64)
        for i, (f, own) in enumerate(zip(features, labels, strict=True)):
            x[i, : len(f)], y[i, : len(f)] = f, own
        here = np.arange(longest)[None] < size[:, None]
        total = here.sum()
        truth = np.eye(2)[y] * here[:, :, None]
        changes = np.bincount((2 * y[:, :-1] + y[:, 1:])[here[:, 1:]], minlength=4).reshape(2, 2)
        p = {"emit": self.emit, "step": self.step, "start": self.start}
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v = {k: np.zeros_like(w) for k, w in p.items()}
        for t in range(1, steps + 1):
            score = p["emit"][x].sum(axis=2)
            ahead = np.zeros((n, longest, 2))
            behind = np.zeros((n, longest, 2))
            ahead[:, 0] = p["start"] + score[:, 0]
            for k in range(1, longest):
                new = np.logaddexp(ahead[:, k - 1, 0, None] + p["step"][0], ahead[:, k - 1, 1, None] + p["step"][1]) + score[:, k]
                ahead[:, k] = np.where(here[:, k, None], new, ahead[:, k - 1])
            for k in range(longest - 2, -1, -1):
                after = behind[:, k + 1] + score[:, k + 1]
                new = np.logaddexp(p["step"][:, 0] + after[:, :1], p["step"][:, 1] + after[:, 1:])
                behind[:, k] = np.where(here[:, k + 1, None], new, behind[:, k + 1])
            z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            node = np.exp(ahead + behind - z[:, None, None]) * here[:, :, None]
            pair = ahead[:, :-1, :, None] + p["step"] + (score[:, 1:] + behind[:, 1:])[:, :, None, :]
            pair = np.exp(pair - z[:, None, None, None]) * here[:, 1:, None, None]
            off = node - truth
            g = {"emit": np.zeros_like(p["emit"]), "step": pair.sum(axis=(0, 1)) - changes, "start": off[:, 0].sum(axis=0)}
            for c in range(2):
                g["emit"][:, c] = np.bincount(x.reshape(-1), np.repeat(off[:, :, c].reshape(-1), kinds), len(p["emit"]))
            for k in p:
                grad = g[k] / total + penalty * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def line_labels(quality: np.ndarray, keys: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    """Labels of the lines of runs (one of a text) from their texts' labels, the lines' hashes and numbers of
    words. All lines of a low-quality text are boilerplate; so are lines of a good one that ``SHARED`` runs
    have, as long as they hold less than half of the run's words."""
    runs = [np.unique(k[w > 0]) for k, w in zip(keys, words, strict=True)]
    line, n = np.unique(np.concatenate(runs) if runs else np.zeros(0, np.uint64), return_counts=True)
    shared, out = line[n >= SHARED], []
    for q, k, w in zip(quality.tolist(), keys, words, strict=True):
        again = np.isin(k, shared) & (w > 0)
        rest = 2 * w[again].sum() < w.sum()
        out.append(np.where(again & rest, 0, q) if q else np.zeros(len(k), np.int64))
    return out


def spliced(features: list[np.ndarray], labels: list[np.ndarray], quality: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Runs in which content and boilerplate follow each other: the k-th good run's first half with the
    first half of the k-th low-quality run behind it, or for odd k before it."""
    good, bad = np.flatnonzero(quality == 1).tolist(), np.flatnonzero(quality == 0).tolist()
    x, y = [], []
    for k, (g, b) in enumerate(zip(good, bad, strict=False)):
        pair = (g, b) if k % 2 == 0 else (b, g)
        upto = [-(-len(features[i]) // 2) for i in pair]
        x.append(np.concatenate([features[i][:n] for i, n in zip(pair, upto, strict=True)]))
        y.append(np.concatenate([labels[i][:n] for i, n in zip(pair, upto, strict=True)]))
    return x, y


def train(docs: DataFrame, labels: DataFrame, texts: int = TEXTS) -> Field | None:
    """A field fitted on texts whose ``quality`` label is 0 or 1. Lines are labelled by ``line_labels``, and the
    runs of both labels are also ``spliced``, so that the field learns how labels change within a text. At
    most ``texts`` texts (by hash; of rows that repeat a doc_id the first by hash and content) reach the driver,
    as features and hashes of at most ``RUN_LINES`` lines each. Null if not both labels are there: then every
    line counts as content."""
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("q"), F.max("quality").cast("int").alias("q2"))
    chosen = marks.filter("q = q2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts).select(F.col("doc_id").alias("of"), "q")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["of"]).select("text", "q", F.xxhash64("doc_id").alias("h"))

    def runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(batch.column("text"))
        head = np.flatnonzero(lines.first)
        size = np.diff(np.r_[head, len(lines.line_doc)])
        x, keys, words = [], [], []
        for a, n, h in zip(head.tolist(), size.tolist(), batch.column("h").to_pylist(), strict=True):
            k = h % -(-n // RUN_LINES) * RUN_LINES
            own = slice(a + k, a + min(k + RUN_LINES, n))
            x.append(lines.features[own].astype(np.int16).tobytes())
            keys.append(lines.line_hash[own].tobytes())
            words.append(lines.line_words[own].astype(np.int64).tobytes())
        return record(x=pa.array(x, pa.binary()), q=batch.column("q"), h=batch.column("h"), keys=pa.array(keys, pa.binary()), words=pa.array(words, pa.binary()))

    found = map_texts(rows, runs, "x binary, q int, h long, keys binary, words binary")
    got = found.orderBy("h", "keys", "x").limit(2 * texts).toArrow().to_pydict()
    if len(set(got["q"])) < 2:
        return None
    width, kinds = _shape()
    features = [np.frombuffer(x, np.int16).reshape(-1, kinds).astype(np.int64) for x in got["x"]]
    keys, words = [np.frombuffer(k, np.uint64) for k in got["keys"]], [np.frombuffer(w, np.int64) for w in got["words"]]
    quality = np.array(got["q"])
    marked = line_labels(quality, keys, words)
    more, more_labels = spliced(features, marked, quality)
    field = Field(width)
    field.fit(features + more, marked + more_labels)
    return field


def _shape() -> tuple[int, int]:
    empty = Lines(pa.array([""]))
    return empty.width, empty.features.shape[1]


def judge(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lines, n_content_lines, content_share and kept.

    Null and blank texts have no words and fail the base rules. Repeated rows are judged alike; lines
    and texts of any length are read whole."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = Lines(batch.column("text"))
        label = field.viterbi(x.features, x.line_doc) if field is not None else np.ones(len(x.line_doc), np.int64)
        n = x.n_docs
        content = np.bincount(x.line_doc, x.line_words * label, n)
        share = content / np.maximum(x.n_words, 1)
        failed = (x.n_words < LEAST_WORDS) | (100 * x.n_repeat_words > MOST_REPEATED * x.n_words)
        long = lambda v: np.asarray(v, np.int64)
        return record(
            doc_id=batch.column("doc_id"), n_words=long(x.n_words), word_chars=long(x.word_chars), n_symbols=long(x.n_symbols), n_dup_lines=long(x.n_dup_lines),
            n_repeat_words=long(x.n_repeat_words), base_failed=failed, n_lines=long(np.bincount(x.line_doc, minlength=n)), n_content_lines=long(np.bincount(x.line_doc, label, n)),
            content_share=share, kept=~failed & (share >= CONTENT),
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_lines long, content_share double, kept boolean"
    return map_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")), work, f"doc_id {kind}, {rest}")
