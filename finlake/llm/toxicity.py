"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel.

A sentence is a bag of segments: its words (without punctuation, so that marks put into a word count for
nothing), and runs of single characters read as one word. The kernel of two segments counts their common
subsequences of three symbols, gaps included: each occurrence weighs ``DECAY`` to the symbols it spans, and
spans of more than ``SPAN`` symbols weigh nothing. So words with letters put in, left out or swapped stay
close to what they stand for. Nyström landmarks turn the kernel into a feature space of fixed size, in which a
linear machine is trained on labelled sentences: every segment of a clean text counts against, and of each
toxic text the sentences' strongest segments count for. A sentence scores as its strongest segment, a text as
its strongest sentence.

The machine's decision is linear in the kernel, so all landmarks fold into one table of symbol triples: a
segment's score is the sum of its triples' entries over its norm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, record, utf8, word_bounds, word_hashes

#: Weight of each spanned symbol, most symbols spanned, and landmarks.
DECAY = 0.7
SPAN = 7
LANDMARKS = 400
#: Longer words are read through overlapping windows of this many symbols.
WINDOW = 24
#: So many single characters in a row are one word.
SPELLED = 3
#: The machine is fitted on a bounded sample: at most this many texts of each label, chosen by hash, this
#: many sentences of each (by hash), and this many segments of a sentence (longer ones are several).
TEXTS = 600
SENTENCES = 32
SEGMENTS = 32
ROUNDS = 8
PENALTY = 0.0003
#: The strongest segments of the clean texts weigh this many times as much as all witnesses.
AGAINST = 4.0
#: The first witnesses stand in toxic texts so much more often than by chance (log-likelihood ratio).
EVIDENCE = 7.0
#: The score of texts without any word.
UNSEEN = 0.0

SYMBOLS = 64
EDGE = SYMBOLS - 1
# Symbols: ASCII letters without case, digits, and the bytes of other letters on 27 more; -1 is left out.
_SYMBOL = np.full(256, -1, np.int16)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(26)
_SYMBOL[48:58] = 26 + np.arange(10)
_SYMBOL[128:] = 36 + np.arange(128) % 27
_SINGLE = np.zeros(256, np.uint8)
_SINGLE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_SINGLE[192:] = 1  # first bytes of longer characters
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_WEIGHT = np.array([DECAY ** (b - 2) for _, b in _STEPS])


class Segments:
    """The segments of a column of texts: symbols between edge marks (``symbol``, ``start``, ``stop``), and
    the text and sentence of each."""

    def __init__(self, texts: pa.Array):
        data, offsets = utf8(texts)
        starts, ends, first = word_bounds(data, offsets)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        # a sentence ends behind a word with a stop, at a line end and with the text
        lines = np.r_[0, np.cumsum(data == 10)]
        ended = np.zeros(len(starts), bool)
        if len(starts):
            ended[1:] = _STOPS[data[ends[:-1] - 1]] | (lines[starts[1:]] != lines[ends[:-1]]) | (text[1:] != text[:-1])
        sentence = np.cumsum(ended)
        symbol = _SYMBOL[data]
        kept = symbol >= 0
        place = np.r_[0, np.cumsum(kept)]
        start, stop = place[starts], place[ends]
        some = stop > start
        start, stop, text, sentence = start[some], stop[some], text[some], sentence[some]
        letters = np.r_[0, np.cumsum(_SINGLE[data[kept]])]
        start, stop, text, sentence = _spelled(start, stop, text, sentence, letters[stop] - letters[start] == 1)
        symbol = symbol[kept]
        # marks at both edges, and windows over long words
        size = stop - start + 2
        n = np.where(size > WINDOW, -(-(size - WINDOW) // (WINDOW // 2)) + 1, 1)
        of = np.repeat(np.arange(len(size)), n)
        shift = (np.arange(len(of)) - (np.cumsum(n) - n)[of]) * (WINDOW // 2)
        length = np.minimum(size[of] - shift, WINDOW)
        self.stop = np.cumsum(length)
        self.start = self.stop - length
        at = np.arange(int(length.sum())) - np.repeat(self.start - shift, length)  # place in the marked word
        inner = np.repeat(start[of], length) + at - 1
        edge = (at == 0) | (at == np.repeat(size[of], length) - 1)
        self.symbol = np.where(edge, EDGE, symbol[np.clip(inner, 0, max(len(symbol) - 1, 0))] if len(symbol) else EDGE).astype(np.uint8)
        self.text, self.sentence, self.n_texts = text[of], sentence[of], len(texts)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols and offsets of the distinct segments, and which of them each segment is."""
        _, index, which = np.unique(word_hashes(self.symbol, self.start, self.stop), return_index=True, return_inverse=True)
        start, length = self.start[index], (self.stop - self.start)[index]
        offsets = np.r_[0, np.cumsum(length)]
        return self.symbol[np.arange(int(offsets[-1])) - np.repeat(offsets[:-1] - start, length)], offsets, which


def _spelled(start, stop, text, sentence, single):
    """The segments, with each run of ``SPELLED`` or more single characters of a sentence as one segment."""
    if not single.any():
        return start, stop, text, sentence
    new = np.r_[True, ~(single[1:] & single[:-1] & (sentence[1:] == sentence[:-1]))]
    head = np.flatnonzero(new)
    size = np.diff(np.r_[head, len(start)])
    join = np.repeat(size >= SPELLED, size)
    keep = ~join | new
    last = np.repeat(head + size - 1, size)
    stop = np.where(join, stop[last], stop)
    return start[keep], stop[keep], text[keep], sentence[keep]


def triples(symbol: np.ndarray, offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of segments (first, past the last) with their symbol triples: a matrix of triple codes with one row
    for each segment, filled up with -1, and their weights in order of the columns. Segments come by length,
    through ``by_length``, so the rows of a run are equally long."""
    length = np.diff(offsets)
    edges = np.r_[0, np.flatnonzero(np.diff(length)) + 1, len(length)]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if a == b or length[a] < 3:
            continue
        m = int(length[a])
        steps = [(i, i + p, i + q, w) for (p, q), w in zip(_STEPS, _WEIGHT, strict=True) for i in range(m - q)]
        x, y, z = (np.array(c) for c in list(zip(*steps, strict=True))[:3])
        weight = np.array([s[3] for s in steps])
        rows = max(1, most // len(steps))
        for c in range(a, b, rows):
            d = min(b, c + rows)
            s = symbol[offsets[c] : offsets[d]].reshape(d - c, m).astype(np.int32)
            yield c, d, s[:, x] * (SYMBOLS * SYMBOLS) + s[:, y] * SYMBOLS + s[:, z], weight


def by_length(symbol: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments sorted by length, and where each went."""
    length = np.diff(offsets)
    order = np.argsort(length, kind="stable")
    new = np.r_[0, np.cumsum(length[order])]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return symbol[np.arange(int(new[-1])) - np.repeat(new[:-1] - offsets[:-1][order], length[order])], new, place


def norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The kernel of each segment with itself, under the root: equal triples add up before they are squared."""
    order = np.argsort(codes, axis=1)
    codes = np.take_along_axis(codes, order, axis=1)
    w = weight[order]
    total = (w * w).sum(axis=1)
    # each further place at which equal triples stand side by side adds twice their product
    for k in range(1, codes.shape[1]):
        same = codes[:, k:] == codes[:, :-k]
        if not same.any():
            break
        total += 2 * (w[:, k:] * w[:, :-k] * same).sum(axis=1)
    return np.sqrt(total)


def kernel(symbol: np.ndarray, offsets: np.ndarray, marks: np.ndarray, mark_offsets: np.ndarray) -> np.ndarray:
    """The normalised kernel of every segment with every landmark."""
    n_marks = len(mark_offsets) - 1
    s, o, place = by_length(marks, mark_offsets)
    back = np.argsort(place)
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.unique(codes) for _, _, codes, _ in triples(s, o)]]))
    where = np.zeros(SYMBOLS**3, np.int32)  # row of the table for each triple of a landmark, 0 for others
    where[used] = np.arange(len(used)) + 1
    table = np.zeros((len(used) + 1, n_marks), np.float32)
    for a, b, codes, weight in triples(s, o):
        np.add.at(table, (where[codes], back[a:b, None]), (weight / norms(codes, weight)[:, None]).astype(np.float32))
    out = np.zeros((len(offsets) - 1, n_marks), np.float32)
    s, o, place = by_length(symbol, offsets)
    back = np.argsort(place)
    for a, b, codes, weight in triples(s, o, 1 << 19):
        size, at = norms(codes, weight), where[codes]
        row, column = np.nonzero(at)  # rows in order
        part = np.zeros((b - a, n_marks), np.float32)
        for c in range(0, len(row), 1 << 16):
            r, k = row[c : c + (1 << 16)], column[c : c + (1 << 16)]
            head = np.flatnonzero(np.r_[True, np.diff(r) > 0])
            part[r[head]] += np.add.reduceat(table[at[r, k]] * weight[k, None].astype(np.float32), head, axis=0)
        out[back[a:b]] = part / size[:, None]
    return out


class Machine:
    """Landmarks folded into one table of triples, a bias, and the two numbers that turn the decision into a
    probability."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, middle: float):
        self.table, self.bias, self.slope, self.middle = table.astype(np.float32), bias, slope, middle

    def decisions(self, symbol: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        s, o, place = by_length(symbol, offsets)
        back = np.argsort(place)
        for a, b, codes, weight in triples(s, o, 1 << 19):
            out[back[a:b]] += (self.table[codes] @ weight.astype(np.float32)) / norms(codes, weight)
        return out

    def strongest(self, x: Segments) -> np.ndarray:
        """The highest decision of each text; texts without segments have minus infinity."""
        symbol, offsets, which = x.distinct()
        out = np.full(x.n_texts, -np.inf)
        np.maximum.at(out, x.text, self.decisions(symbol, offsets)[which])
        return out

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(decision), 1 / (1 + np.exp(-np.clip(self.slope * (decision - self.middle), -50, 50))), UNSEEN)


def held_out():
    """Rows that are never learned from: crc32 of the doc_id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, texts: int) -> tuple[dict, float]:
    """Bags of segments of labelled sentences, with text and label, and the share of toxic labels."""
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("q"), F.max("toxic").cast("int").alias("q2"))
    marks = cut(marks.filter("q = q2").select("doc_id", "q"))
    n, toxic = marks.agg(F.count("*"), F.sum("q")).first()
    draw = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.filter("q = 0").orderBy(*draw).limit(texts).union(marks.filter("q = 1").orderBy(*draw).limit(texts)).select(F.col("doc_id").alias("of"), "q")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["of"]).select("text", "q", F.xxhash64("doc_id", "text").alias("h"))

    def bags(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = Segments(batch.column("text"))
        h, q = batch.column("h").to_numpy(), batch.column("q").to_numpy()
        out = {"h": [], "q": [], "k": [], "x": []}
        if len(x.text):
            # bags: sentences, in parts of SEGMENTS
            new = np.r_[True, np.diff(x.sentence) > 0]
            head = np.flatnonzero(new)
            inside = np.arange(len(new)) - np.repeat(head, np.diff(np.r_[head, len(new)]))
            head = np.flatnonzero(inside % SEGMENTS == 0)
            tail = np.r_[head[1:], len(new)]
            owner = x.text[head]
            begin = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            for t in range(batch.num_rows):
                n = int(begin[t + 1] - begin[t])
                for k in sorted(np.random.default_rng(abs(int(h[t]))).permutation(n)[:SENTENCES].tolist()):
                    b = int(begin[t]) + k
                    words = {x.symbol[i:j].tobytes() for i, j in zip(x.start[head[b] : tail[b]].tolist(), x.stop[head[b] : tail[b]].tolist(), strict=True)}
                    out["h"].append(int(h[t]))
                    out["q"].append(int(q[t]))
                    out["k"].append(k)
                    out["x"].append(sorted(words))
        return record(h=pa.array(out["h"], pa.int64()), q=pa.array(out["q"], pa.int32()), k=pa.array(out["k"], pa.int32()), x=pa.array(out["x"], pa.list_(pa.binary())))

    # equal texts under one label are one example, whatever the order of the rows
    got = map_texts(rows, bags, "h long, q int, k int, x array<binary>").dropDuplicates(["h", "q", "k"])
    return got.orderBy("h", "q", "k").limit(4 * texts * SENTENCES).toArrow().to_pydict(), (toxic or 0) / max(n, 1)


def train(docs: DataFrame, labels: DataFrame, texts: int = TEXTS) -> Machine | None:
    """A machine fitted on texts labelled ``toxic`` 0 or 1 (contradicting labels of a doc_id are left out)
    that are not held out. The driver gets at most ``texts`` texts of each label, ``SENTENCES`` sentences of
    each and ``SEGMENTS`` segments of a sentence, whatever the size of ``docs``. Null if a label is missing."""
    got, prior = _sample(docs, labels, texts)
    return fit(got["h"], got["q"], got["x"], prior)


def fit(text: list, label: list[int], bags: list[list[bytes]], prior: float) -> Machine | None:
    """Train on bags of segments: ``text`` says which bags belong together, ``label`` is 0 or 1; ``prior`` is
    the share of toxic ones among all labelled texts."""
    if len(set(label)) < 2:
        return None
    vocabulary = sorted({w for bag in bags for w in bag})
    index = {w: i for i, w in enumerate(vocabulary)}
    _, doc = np.unique(np.array([f"{t}:{q}" for t, q in zip(text, label, strict=True)]), return_inverse=True)
    n_docs = int(doc.max()) + 1
    q = np.zeros(n_docs, np.int64)
    q[doc] = label
    size = np.array([len(b) for b in bags])
    bag = np.repeat(np.arange(len(bags)), size)
    word = np.array([index[w] for b in bags for w in b])
    owner = doc[bag]
    # a fifth of the texts only calibrate the score
    apart = np.zeros(n_docs, bool)
    apart[doc] = np.array([zlib.crc32(f"apart:{t}".encode()) % 5 == 0 for t in text])
    if len(set(q[apart].tolist())) < 2 or len(set(q[~apart].tolist())) < 2:
        apart[:] = False
    learn = ~apart[owner]
    symbol = np.frombuffer(b"".join(vocabulary), np.uint8)
    offsets = np.r_[0, np.cumsum([len(w) for w in vocabulary])]

    # how many toxic and clean texts have each segment
    pairs = np.unique(np.stack([word, owner], axis=1)[learn], axis=0)
    having = np.stack([np.bincount(pairs[:, 0], q[pairs[:, 1]] == c, len(vocabulary)) for c in (0, 1)])
    share = (having + 0.5) / (np.array([(q[~apart] == 0).sum(), (q[~apart] == 1).sum()])[:, None] + 1)
    odds = np.log(share[1] / share[0])
    marks = _landmarks(symbol, offsets, having[1] * odds, having.sum(axis=0))
    chosen = [vocabulary[i] for i in marks]
    mark_symbol, mark_offsets = np.frombuffer(b"".join(chosen), np.uint8), np.r_[0, np.cumsum([len(w) for w in chosen])]
    grams = kernel(symbol, offsets, mark_symbol, mark_offsets)
    values, vectors = np.linalg.eigh(grams[marks].astype(float))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    z = grams @ root.astype(np.float32)
    del grams

    # segments seen in clean texts count against; the witnesses of toxic sentences count for
    against = np.flatnonzero(having[0] > 0)
    base = q[~apart].mean()
    rate = having[1] / np.maximum(having.sum(axis=0), 1)
    ratio = having[1] * np.log(np.maximum(rate, 1e-9) / base) + having[0] * np.log(np.maximum(1 - rate, 1e-9) / (1 - base))
    evident = (rate > base) & (ratio >= min(EVIDENCE, ratio[rate > base].max(initial=0)))
    decision = np.where(evident, odds * np.sqrt(having[1]), -1.0)
    all_words, all_owners = word, owner
    word, bag, owner = word[learn], bag[learn], owner[learn]
    first = witness = _witnesses(decision, word, bag, owner, q)
    weights, hard = np.zeros(z.shape[1] + 1), np.zeros(len(vocabulary))
    for _ in range(ROUNDS):
        words, count = np.unique(word[witness], return_counts=True)
        x = np.concatenate([z[words], z[against]])
        y = np.r_[np.ones(len(words)), -np.ones(len(against))]
        c, d = np.sqrt(count), np.sqrt(having[0][against])
        d = d / d.sum() + (AGAINST * hard[against] / hard.sum() if hard.any() else 0)
        weights = _squared_hinge(x, y, np.r_[c / c.sum(), d], weights)
        decision = (z @ weights[:-1].astype(np.float32)).astype(float) + weights[-1]
        hard = np.maximum(hard, _strongest(decision, word, owner, q))
        witness = np.union1d(first, _witnesses(decision, word, bag, owner, q))

    best = np.full(n_docs, -np.inf)
    np.maximum.at(best, all_owners, decision[all_words])
    slope, middle = _platt(best[apart], q[apart], prior) if apart.any() else _platt(best, q, prior)
    table = np.zeros(SYMBOLS**3)
    fold = root @ weights[:-1]
    s, o, place = by_length(mark_symbol, mark_offsets)
    back = np.argsort(place)
    for a, b, codes, weight in triples(s, o):
        np.add.at(table, codes, fold[back[a:b], None] * weight / norms(codes, weight)[:, None])
    return Machine(table, float(weights[-1]), slope, middle)


def _landmarks(symbol: np.ndarray, offsets: np.ndarray, gain: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Half of the landmarks are the segments that speak most for toxic texts, but for those close to one
    already chosen; the other half are drawn from all segments by frequency."""
    length = np.diff(offsets)
    able = np.flatnonzero((length > 3) & (seen > 0))
    best = able[np.argsort(-gain[able], kind="stable")][: 4 * LANDMARKS]
    best = best[gain[best] > 0]
    words = [symbol[offsets[i] : offsets[i + 1]] for i in best]
    chosen: list[int] = []
    if len(best):
        joined, places = np.concatenate(words), np.r_[0, np.cumsum([len(w) for w in words])]
        close = kernel(joined, places, joined, places)
        for i in range(len(best)):
            if len(chosen) < LANDMARKS // 2 and (not chosen or close[i, chosen].max() < 0.95):
                chosen.append(i)
    first = best[chosen] if chosen else np.zeros(0, np.int64)
    rest = np.setdiff1d(able, first)
    n = min(LANDMARKS - len(first), len(rest))
    weight = np.sqrt(seen[rest])
    drawn = np.random.default_rng(3).choice(rest, n, replace=False, p=weight / weight.sum()) if n else rest[:0]
    return np.r_[first, np.sort(drawn)].astype(np.int64)


def _witnesses(decision, word, bag, owner, q) -> np.ndarray:
    """Where the strongest segment of each sentence of a toxic text is that the decision calls toxic."""
    mine = np.flatnonzero(q[owner] == 1)
    order = mine[np.lexsort((word[mine], -decision[word[mine]], bag[mine]))]
    each = order[np.r_[True, np.diff(bag[order]) > 0]] if len(order) else order
    return np.sort(each[decision[word[each]] > 0])


def _strongest(decision, word, owner, q) -> np.ndarray:
    """How many clean texts have each segment as their strongest one."""
    mine = np.flatnonzero(q[owner] == 0)
    order = mine[np.lexsort((word[mine], -decision[word[mine]], owner[mine]))]
    top = order[np.r_[True, np.diff(owner[order]) > 0]] if len(order) else order
    return np.bincount(word[top], minlength=len(decision)).astype(float)


def _squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, w: np.ndarray, steps: int = 30) -> np.ndarray:
    """Newton steps on the squared hinge loss, example weights ``c``, bias unpenalised (last weight)."""
    x = x.astype(np.float32, copy=False)
    ridge = np.full(x.shape[1] + 1, PENALTY)
    ridge[-1] = 1e-8

    def decide(w: np.ndarray) -> np.ndarray:
        return (x @ w[:-1].astype(np.float32)).astype(float) + w[-1]

    for _ in range(steps):
        gap = 1 - y * decide(w)
        on = np.flatnonzero(gap > 0)
        left, right = np.diag(ridge), np.zeros(len(w))
        for a in range(0, len(on), 4096):  # a block of rows at a time
            i = on[a : a + 4096]
            rows = np.column_stack([x[i].astype(float), np.ones(len(i))])
            some = rows * c[i, None]
            left += some.T @ rows
            right += some.T @ y[i]
        step = np.linalg.solve(left, right) - w
        size, loss = 1.0, (c[on] * gap[on] ** 2).sum() + (ridge * w * w).sum()
        while size > 1e-4:
            new = w + size * step
            over = np.maximum(1 - y * decide(new), 0)
            if (c * over**2).sum() + (ridge * new * new).sum() <= loss:
                break
            size /= 2
        w = new
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def _platt(best: np.ndarray, q: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and middle of a logistic curve through the texts' decisions, with smoothed targets; both labels
    weigh as much as they have in all labelled texts, of which ``prior`` are toxic."""
    seen = np.isfinite(best)
    d, t = best[seen], q[seen]
    up, down = t.sum(), len(t) - t.sum()
    if not up or not down:
        return 1.0, 0.0
    target = np.where(t == 1, (up + 1) / (up + 2), 1 / (down + 2))
    share = np.where(t == 1, prior * len(t) / up, (1 - prior) * len(t) / down)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -50, 50)))
        r, g = share * np.maximum(p * (1 - p), 1e-9), share * (p - target)
        hess = np.array([[(r * d * d).sum() + 1e-3, (r * d).sum()], [(r * d).sum(), r.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * d).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    a = max(a, 1e-3)
    return float(a), float(-b / a)


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, the probability that the text's strongest
    segment speaks for) and predicted (1 if score is 0.5 or more).

    Null and empty texts, and those without a letter or digit, score ``UNSEEN``; so does every text if nothing
    was learned. Texts of any length are read whole, words of any length through overlapping windows; repeated
    rows score alike. Only text is an input of a score."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = np.full(batch.num_rows, UNSEEN) if machine is None else machine.probability(machine.strongest(Segments(batch.column("text"))))
        p = np.round(p, 6)
        return record(doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), score=p, predicted=(p >= 0.5).astype(np.int32))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return map_texts(rows, work, f"doc_id {kind}, held_out boolean, score double, predicted int")
