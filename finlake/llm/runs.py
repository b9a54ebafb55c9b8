"""Periodic runs of words: maximal repetitions found through longest common extensions in suffix trees.

Ukkonen's algorithm builds the suffix tree of the words and the one of their reversal. Tours of the trees
answer the longest common extension of two places, to the right and to the left, in constant time. The
longest Lyndon words that start at each place, under an order of the words and under its inverse, are the
candidate roots; each is extended in both directions.

Trees are only built over stretches that can hold a run long enough: see ``stretches``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, mixed, record, utf8, word_bounds, word_hashes

#: A run has at least this many words, and at least this many times its period.
LEAST = 6
TIMES = 4
#: Stretches go into one pair of trees until they have this many words together; a longer one goes alone.
TREE_WORDS = 60_000
#: Places compared at once by a block of the range minimum.
BLOCK = 32


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of small non-negative integers whose last value is unique.
    ``order`` and ``inverse`` list the suffixes by the values and by the inverted values, where values
    below ``ends`` (the separators) stay the smallest in both."""

    def __init__(self, s: list[int], ends: int):
        self.n, self.ends = len(s), ends
        wide = max(s) + 1
        start, stop, link, edges = [0], [0], [0], {}
        n, at, edge, length, open_ = self.n, 0, 0, 0, 0
        for i, c in enumerate(s):
            last = -1
            open_ += 1
            while open_:
                if not length:
                    edge = i
                key = at * wide + s[edge]
                to = edges.get(key)
                if to is None:
                    edges[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if last >= 0:
                        link[last] = at
                        last = -1
                else:
                    first = start[to]
                    size = (stop[to] if stop[to] <= i else i + 1) - first
                    if length >= size:
                        edge += size
                        length -= size
                        at = to
                        continue
                    if s[first + length] == c:
                        if last >= 0:
                            link[last] = at
                        length += 1
                        break
                    middle = len(start)
                    start += (first, i)
                    stop += (first + length, n)
                    link += (0, 0)
                    edges[key] = middle
                    edges[middle * wide + c] = middle + 1
                    start[to] = first + length
                    edges[middle * wide + s[first + length]] = to
                    if last >= 0:
                        link[last] = middle
                    last = middle
                open_ -= 1
                if at:
                    at = link[at]
                elif length:
                    length -= 1
                    edge = i - open_ + 1
        nodes = len(start)
        key = np.fromiter(edges.keys(), np.int64, len(edges))
        child = np.fromiter(edges.values(), np.int64, len(edges))
        del edges
        self.parent = np.zeros(nodes, np.int64)
        self.parent[child] = key // wide
        self.value = np.zeros(nodes, np.int64)
        self.value[child] = key % wide
        self.own = np.array(stop, np.int64) - np.array(start, np.int64)
        self.leaf = np.array(stop, np.int64) == n
        self.leaf[0] = False

    def _walk(self, value: np.ndarray) -> np.ndarray:
        """All nodes in depth-first order, children by ``value``."""
        nodes = len(self.parent)
        up, value = self.parent[1:], value[1:]
        kids = np.lexsort((-value, up)) + 1  # the stack gives the last one first
        place = np.searchsorted(self.parent[kids], np.arange(nodes + 1)).tolist()
        kids, out, stack = kids.tolist(), [], [0]
        while stack:
            v = stack.pop()
            out.append(v)
            a, b = place[v], place[v + 1]
            if a < b:
                stack += kids[a:b]
        return np.array(out, np.int64)

    @cached_property
    def tour(self) -> np.ndarray:
        return self._walk(self.value)

    @cached_property
    def depth(self) -> np.ndarray:
        """Words on the path from the root to each node."""
        out, up, own = [0] * len(self.parent), self.parent.tolist(), self.own.tolist()
        for v in self.tour.tolist()[1:]:
            out[v] = out[up[v]] + own[v]
        return np.array(out, np.int64)

    def _suffixes(self, walk: np.ndarray) -> np.ndarray:
        return self.n - self.depth[walk[self.leaf[walk]]]

    @cached_property
    def order(self) -> np.ndarray:
        return self._suffixes(self.tour)

    @cached_property
    def inverse(self) -> np.ndarray:
        return self._suffixes(self._walk(np.where(self.value < self.ends, self.value, self.ends + self.value.max() - self.value)))

    @cached_property
    def _lowest(self) -> Minimum:
        # on the tour, the lowest common ancestor of two leaves is the highest parent between them
        return Minimum(self.depth[self.parent[self.tour]])

    @cached_property
    def _place(self) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        leaves = np.flatnonzero(self.leaf[self.tour])
        out[self.order] = leaves
        return out

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values are equal from the places ``i`` and ``j`` on (i and j differ)."""
        a, b = self._place[i], self._place[j]
        return self._lowest.between(np.minimum(a, b) + 1, np.maximum(a, b))


class Minimum:
    """Range minima in constant time: running minima inside blocks, and minima over 2^k blocks."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        self.x = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        self.x[: len(values)] = values
        grid = self.x.reshape(blocks, BLOCK)
        self.head = np.minimum.accumulate(grid, axis=1).reshape(-1)
        self.tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.rows = [grid.min(axis=1)]
        while 2 << (len(self.rows) - 1) <= blocks:
            low, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(low[:-step], low[step:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least value from place a to place b, both included."""
        out = np.minimum(self.tail[a], self.head[b])
        left, right = a // BLOCK, b // BLOCK
        same = np.flatnonzero(left == right)
        if len(same):
            here, stop = a[same], b[same]
            low = self.x[here]
            for k in range(1, BLOCK):
                low = np.minimum(low, self.x[np.minimum(here + k, stop)])
            out[same] = low
        far = np.flatnonzero(right - left > 1)
        if len(far):
            first, size = left[far] + 1, right[far] - left[far] - 1
            level = np.log2(size).astype(np.int64)
            low = np.empty(len(far), np.int64)
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                row = self.rows[k]
                low[at] = np.minimum(row[first[at]], row[first[at] + size[at] - (1 << k)])
            out[far] = np.minimum(out[far], low)
        return out


def lyndon_roots(order: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word from each place on ends: at the next smaller suffix."""
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    rank, out, stack = rank.tolist(), [n] * n, []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def maximal_runs(parts: list[np.ndarray]) -> np.ndarray:
    """All maximal repetitions (two periods or more) of each sequence: rows of sequence, start, length and
    smallest period, in order. The sequences share one pair of trees, each closed by a separator of its own."""
    ends = len(parts)
    sizes = np.array([len(p) for p in parts])
    s = np.empty(int(sizes.sum()) + ends, np.int64)
    head = np.cumsum(sizes + 1) - (sizes + 1)
    for k, (h, p) in enumerate(zip(head, parts, strict=True)):
        s[h : h + len(p)] = p + ends
        s[h + len(p)] = k
    n = len(s)
    forth = SuffixTree(s.tolist(), ends)
    # the reversal starts with a separator; one more of its own closes it
    back = SuffixTree([*(s[::-1] + 1).tolist(), 0], ends + 1)
    found = []
    for order in (forth.order, forth.inverse):
        stop = lyndon_roots(order)
        i = np.flatnonzero((stop < n) & (s >= ends))
        j = stop[i]
        period = j - i
        right = forth.extension(i, j)
        left = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        left[inner] = back.extension(n - i[inner], n - j[inner])
        start, length = i - left, left + period + right
        keep = length >= 2 * period
        found.append(np.stack([start[keep], length[keep], period[keep]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    of = np.searchsorted(head, runs[:, 0], side="right") - 1
    out = np.column_stack([of, runs[:, 0] - head[of], runs[:, 1], runs[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def window_words(least: int, times: int) -> int:
    """Words of the windows that ``stretches`` compares: with a run of ``max(least, times * q)`` words and
    period q, every window in it has an equal one q words further or before inside the run."""
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1)))


def stretches(word: np.ndarray, text: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, stop) of the stretches of words that can hold runs; ``word`` are hashes, ``text`` says which
    text each is in. Nothing is lost: each window in a run of period q has its nearest equal window at most
    q words away, and q is at most a ``times``-th of the stretch of such windows that holds the run. So
    windows without an equal one are left out, then, twice, those whose nearest equal one is too far
    for their stretch. Equal hashes of different windows only add places."""
    w, n = window_words(least, times), len(word)
    if n < w:
        return np.zeros((0, 2), np.int64)
    h = np.zeros(n - w + 1, np.uint64)
    for k in range(w):
        h = mixed(h ^ word[k : n - w + 1 + k])
    h = mixed(h ^ text[: n - w + 1].astype(np.uint64))
    whole = text[: n - w + 1] == text[w - 1 :]
    order = np.argsort(h, kind="stable")
    gap = np.diff(order)
    gap[h[order[1:]] != h[order[:-1]]] = n
    near = np.full(len(h), n, np.int64)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    marked = whole & (near < n)
    for _ in range(3):
        at = np.flatnonzero(marked)
        if not len(at):
            return np.zeros((0, 2), np.int64)
        new = np.r_[True, (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])]
        head = np.flatnonzero(new)
        size = np.diff(np.r_[head, len(at)]) + w - 1
        fits = (times * near[at] <= np.repeat(size, np.diff(np.r_[head, len(at)]))) & np.repeat(size >= least, np.diff(np.r_[head, len(at)]))
        if fits.all():
            break
        marked[at[~fits]] = False
    else:
        at = np.flatnonzero(marked)
        if not len(at):
            return np.zeros((0, 2), np.int64)
        new = np.r_[True, (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])]
        head = np.flatnonzero(new)
    last = np.r_[head[1:], len(at)] - 1
    return np.stack([at[head], at[last] + w], axis=1)


class Runs:
    """The words of a column of texts and their runs: ``text`` (which text), ``start``, ``length`` and
    ``period`` of each run in order; ``first`` (where each text's words begin) and ``dropped`` words."""

    def __init__(self, texts: pa.Array, least: int = LEAST, times: int = TIMES, edit: Callable[[np.ndarray], np.ndarray] | None = None, prune: bool = True):
        self.data, offsets = utf8(texts)
        self.starts, self.ends, self.first = word_bounds(self.data, offsets)
        sizes = np.diff(self.first)
        if edit is not None:
            take = edit(self.first)
            self.starts, self.ends = self.starts[take], self.ends[take]
        of = np.repeat(np.arange(len(sizes)), sizes)
        hashes = word_hashes(self.data, self.starts, self.ends)
        parts = stretches(hashes, of, least, times) if prune else np.stack([self.first[:-1], self.first[1:]], axis=1)[sizes > 0]
        rows, group, held = [np.zeros((0, 3), np.int64)], [], 0
        for k, (a, b) in enumerate(parts.tolist()):
            group.append((a, b))
            held += b - a
            if held >= TREE_WORDS or k + 1 == len(parts):
                rows.append(self._group(group, least, times))
                group, held = [], 0
        found = np.concatenate(rows)
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        place, self.length, self.period = found.T
        self.text = of[place] if len(place) else np.zeros(0, np.int64)
        self.start = place - self.first[self.text]
        change = np.zeros(len(of) + 1, np.int64)
        np.add.at(change, place + self.period, 1)
        np.add.at(change, place + self.length, -1)
        self.dropped = np.cumsum(change[:-1]) > 0

    def _group(self, group: list[tuple[int, int]], least: int, times: int) -> np.ndarray:
        ids, parts, raw = {}, [], self.data.tobytes() if len(group) > 64 else None
        for a, b in group:
            cut = zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)
            if raw is None:
                words = [self.data[x:y].tobytes() for x, y in cut]
            else:
                words = [raw[x:y] for x, y in cut]
            parts.append(np.array([ids.setdefault(w, len(ids)) for w in words], np.int64))
        got = maximal_runs(parts)
        got = got[got[:, 2] >= np.maximum(least, times * got[:, 3])]
        head = np.array([a for a, _ in group], np.int64)
        return np.stack([head[got[:, 0]] + got[:, 1], got[:, 2], got[:, 3]], axis=1)

    def collapsed(self) -> list[bytes]:
        """Each text's words but for the dropped ones, joined by one space."""
        keep = ~self.dropped
        starts, size = self.starts[keep], (self.ends - self.starts)[keep] + 1
        places = np.cumsum(size) - size
        room = np.concatenate([self.data, np.zeros(1, np.uint8)])
        out = room[np.arange(int(size.sum())) - np.repeat(places - starts, size)]
        out[places + size - 1] = 32
        first = np.r_[0, np.cumsum(keep)][self.first]
        edge = np.r_[places, int(size.sum())][first]
        out = out.tobytes()
        return [out[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per run: doc_id, start (word number from 0), length and period. A run is a stretch of words
    with smallest period q and at least ``max(least, times * q)`` words that no neighbouring word extends.

    ``times`` is 2 at least. Null, empty and wordless texts have no runs; repeated rows give their runs again;
    texts of any length are read whole."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = Runs(batch.column("text"), least, times)
        return record(doc_id=batch.column("doc_id").take(pa.array(x.text)), start=x.start, length=x.length, period=x.period)

    return map_texts(_rows(docs), work, f"doc_id {_kind(docs)}, start long, length long, period long")


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id and text, the words joined by one space without those that repeat inside a run: of each run
    the first period stays. Null and wordless texts become empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Runs(batch.column("text"), least, times).collapsed()
        return record(doc_id=batch.column("doc_id"), text=pa.array([t.decode() for t in texts], pa.string()))

    return map_texts(_rows(docs), work, f"doc_id {_kind(docs)}, text string")


def summary(
    docs: DataFrame, least: int = LEAST, times: int = TIMES, edit: Callable[[list, np.ndarray], np.ndarray] | None = None, prune: bool = True
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs; start, length, period and exponent_milli of the run with
    the greatest length / period (ties: smallest start, then period; no run: nulls); runs_sha256 of all
    runs' ``start,length,period`` lines, collapsed_sha256 of the collapsed text.

    ``edit`` may name the words to look at: from the doc_ids of some rows and where their words begin it
    gives the word to take at each place. Null, empty and wordless texts have no runs; repeated rows are
    treated alike; a doc_id may be null or of any type. ``prune=False`` builds trees over all words, to the
    same result."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        change = None if edit is None else lambda first: edit(batch.column("doc_id").to_pylist(), first)
        x = Runs(batch.column("text"), least, times, change, prune)
        n = batch.num_rows
        count = np.bincount(x.text, minlength=n)
        edge = np.r_[0, np.cumsum(count)].tolist()
        best: list[int | None] = [None] * n
        for k, (t, length, period) in enumerate(zip(x.text.tolist(), x.length.tolist(), x.period.tolist(), strict=True)):
            b = best[t]
            if b is None or length * int(x.period[b]) > int(x.length[b]) * period:
                best[t] = k
        lines = [f"{a},{b},{c}\n" for a, b, c in zip(x.start.tolist(), x.length.tolist(), x.period.tolist(), strict=True)]
        pick = pa.array(best, pa.int64())
        milli = pa.array(1000 * x.length // np.maximum(x.period, 1), pa.int64())
        return record(
            doc_id=batch.column("doc_id"), n_runs=np.asarray(count, np.int64), start=pa.array(x.start, pa.int64()).take(pick), length=pa.array(x.length, pa.int64()).take(pick),
            period=pa.array(x.period, pa.int64()).take(pick), exponent_milli=milli.take(pick),
            runs_sha256=pa.array([hashlib.sha256("".join(lines[a:b]).encode()).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.string()),
            collapsed_sha256=pa.array([hashlib.sha256(t).hexdigest() for t in x.collapsed()], pa.string()),
        )

    rest = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_texts(_rows(docs), work, f"doc_id {_kind(docs)}, {rest}")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()
