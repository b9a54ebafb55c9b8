"""Line dedup: an exact set-similarity self-join of all lines of all texts. A line's distinct words are
ordered by rarity; lines that reach the similarity share one of their first (rarest) words, and the
lengths of two lines, the places of the shared word and a parity sketch bound what they can share. What is left
is verified on the lines' words (their 64-bit hashes); that two sets are equal is told by 96 bits, two sums
over all these hashes. Of two lines that match, the later one is removed.

Lines are in order of doc_id, then (for rows with the same doc_id) a hash of the text, then the line's
number; a line is removed if it matches any line before it, removed or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_released
from .common import BROADCAST_BYTES, LOWER, broadcast_if_small, cut, fresh, give_back, map_texts, mixed, pieces, record, text_of, utf8, word_bounds, word_hashes

#: Jaccard similarity of the sets of words from which two lines match, and the fewest distinct words of a
#: line that can be removed or match.
SIMILAR = 0.8
LEAST_WORDS = 1
#: Rarity comes from a table of hashed counts of fixed size (a power of two). Any order is right; the
#: better the counts, the fewer candidates.
TABLE_BITS = 20
BLOCKS = 64
#: Lines that one task compares under one word; commoner first words are dealt out in parts.
CELL_ROWS = 8192
#: In the first round a line's closest candidate is verified, of at most LOOK that it meets under one
#: word; lines that it does not settle are looked at again with MORE times as many, and so on.
LOOK = 64
MORE = 32
#: Lines looked at to find common first words.
SAMPLE_LINES = 60_000
#: Entries that a task packs together, and that it unpacks at once, about.
PACKED = 250_000

#: Bytes of text handled at once.
PIECE = 1 << 20

_NO_ID = (1 << 63) - 1
_LINE = [("doc", "<i8"), ("h", "<u4"), ("line", "<u4")]
#: A line under one of its first words (a sketch of 96 bits, a digest of its set of words, its size, the
#: word's place) and a line under its whole set of words.
_PREFIX = np.dtype([("key", "<u4"), *_LINE, ("hi", "<u4"), ("lo", "<u8"), ("own", "<u4"), ("size", "<u4"), ("pos", "<u4"), ("side", "u1")])
_EXACT = np.dtype([("key", "<u8"), ("check", "<u4"), *_LINE])
_KINDS = (_PREFIX, _EXACT)


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def _rows(docs: DataFrame, keyed: bool) -> DataFrame:
    """What the passes read: the text, and a document's key: doc_id, and a hash of the text where
    ``keyed``, that is where one doc_id has several texts."""
    return docs.select(_doc().alias("doc"), _hash(keyed).alias("h"), F.col("text").cast("string").alias("text"))


def _keyed(docs: DataFrame) -> bool:
    """Whether some doc_id has several texts. If none has, doc_id alone is the key, which is less to move."""
    rows = _rows(docs, True).groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    return not rows.filter("a <> b").isEmpty()


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


def _hash(keyed: bool) -> Column:
    return F.xxhash64(text_of()).bitwiseAND(0xFFFFFFFF) if keyed else F.lit(0).cast("long")


class Lines:
    """Lower-cased words of all lines of a column of texts that have a word."""

    def __init__(self, texts: pa.Array):
        data, offsets = utf8(texts)
        data = LOWER[data]
        starts, ends, before = word_bounds(data, offsets)
        self.words = word_hashes(data, starts, ends)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
        stops = np.flatnonzero(data == 10)
        line = np.searchsorted(stops, starts)
        new = np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])] if len(line) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        #: Index of each word's line; for each line its text and its number in that text.
        self.of = np.cumsum(new) - 1
        self.doc = doc[head]
        self.number = line[head] - np.searchsorted(stops, offsets[:-1])[self.doc]

    def sets(self, rarity: np.ndarray, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``(lines, first, tokens, words)``: for runs of lines their indices, where each one's words begin, and
        all words, distinct within a line, by rarity and then by hash: 43 bits that tell their order, and the
        whole hashes."""
        for a in range(0, len(self.doc), step):
            b = min(a + step, len(self.doc))
            lo, hi = np.searchsorted(self.of, a), np.searchsorted(self.of, b)
            words, of = self.words[lo:hi], (self.of[lo:hi] - a).astype(np.uint64)
            level = rarity[words >> np.uint64(64 - TABLE_BITS)].astype(np.uint64)
            raw = of << np.uint64(43) | level << np.uint64(37) | words & np.uint64((1 << 37) - 1)
            order = np.argsort(raw)
            key, words = raw[order], words[order]
            if (words[1:] != words[:-1])[key[1:] == key[:-1]].any():  # two words of a line that are alike in 37 bits
                order = np.lexsort((self.words[lo:hi], raw))
                key, words = raw[order], self.words[lo:hi][order]
            new = np.r_[True, (key[1:] != key[:-1]) | (words[1:] != words[:-1])] if len(key) else np.zeros(0, bool)
            key, words = key[new], words[new]
            of = (key >> np.uint64(43)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
            yield np.arange(a, b), first, key & np.uint64((1 << 43) - 1), words


def _sums(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent digests of each set of words, 64 bits each."""
    size = np.diff(np.r_[first, len(words)]).astype(np.uint64)
    one, two = mixed(words), mixed(words ^ np.uint64(0x9E3779B97F4A7C15))
    if len(first):
        one, two = np.add.reduceat(one, first), np.add.reduceat(two, first)
    return mixed(one + size), mixed(two + size)


def _pack(rows: np.ndarray) -> bytes:
    """An array, or a structured one column by column, compressed."""
    if rows.dtype.names:
        raw = b"".join([np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names])
    else:
        raw = rows.tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, kind: np.dtype, n: int) -> np.ndarray:
    raw = pa.decompress(blob, n * kind.itemsize, codec="zstd", asbytes=True)
    if not kind.names:
        return np.frombuffer(raw, kind)
    out, at = np.empty(n, kind), 0
    for c in kind.names:
        width = kind[c].itemsize * n
        out[c] = np.frombuffer(raw[at : at + width], kind[c])
        at += width
    return out


def rarity(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Levels (twice the binary logarithm) of hashed word counts over all texts, and how many lines and words there are.
    Counts are summed in Spark; the driver gets one table of fixed size."""
    size = 1 << (TABLE_BITS - 6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lines, words = np.zeros(1 << TABLE_BITS, np.int64), 0, 0
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                x = Lines(piece.column("text"))
                n += np.bincount((x.words >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(n))
                lines += len(x.doc)
        if lines:
            own = np.where(np.arange(BLOCKS) == 0, lines, 0).astype(np.int64)
            yield record(block=np.arange(BLOCKS, dtype=np.int32), n=pa.array([_pack(v) for v in n.reshape(BLOCKS, size)], pa.binary()), lines=own)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lines = {}, {}
        for batch in batches:
            for block, n, k in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                total[block] = total.get(block, 0) + _unpack(n, np.dtype(np.int64), size)
                lines[block] = lines.get(block, 0) + k
        if total:
            yield record(block=pa.array(list(total), pa.int32()), n=pa.array([_pack(v) for v in total.values()], pa.binary()), lines=pa.array(list(lines.values()), pa.int64()))

    schema = "block int, n binary, lines long"
    own = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, schema)
    got = own.repartition(BLOCKS, "block").mapInArrow(add, schema).collect()
    table, lines = np.zeros((BLOCKS, size)), 0
    for r in got:
        table[r["block"]] = _unpack(r["n"], np.dtype(np.int64), size)
        lines += r["lines"]
    return np.minimum(63, 2 * np.log2(1 + table.reshape(-1))).astype(np.uint8), lines, int(table.sum())


def _prefixes(x: Lines, levels: np.ndarray, similar: float, least: int):
    """For runs of lines with ``least`` or more distinct words: their indices, sizes, digests of their sets (64
    and 32 bits), parity sketches (32 and 64 bits), and for all prefix words their line (index into these),
    place and token."""
    for lines, first, tokens, words in x.sets(levels):
        size = np.diff(np.r_[first, len(tokens)])
        own, check = _sums(words, first)
        spread = mixed(tokens)
        place = (spread >> np.uint64(8)) % np.uint64(96)
        bit = np.uint64(1) << (place & np.uint64(63))
        high = place >> np.uint64(6)
        hi = np.bitwise_xor.reduceat(bit * high, first) if len(first) else bit
        lo = np.bitwise_xor.reduceat(bit * (np.uint64(1) - high), first) if len(first) else bit
        big = np.flatnonzero(size >= least)
        # lines so short that only an equal set reaches the similarity meet by their whole sets alone
        n = np.where(size[big] >= similar * (size[big] + 1) - 1e-9, size[big] - _ceil(similar * size[big]) + 1, 0)
        of = np.repeat(np.arange(len(big)), n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        yield lines[big], size[big], own[big], (check[big] >> np.uint64(32)).astype(np.uint32), hi[big], lo[big], of, place, tokens[first[big][of] + place] & np.uint64((1 << 37) - 1)


def common_first_words(docs: DataFrame, levels: np.ndarray, lines: int, similar: float, least: int, cell_rows: int) -> dict[int, int]:
    """Prefix words that many lines share, with the number of parts they are dealt out in, estimated on a
    sample of the texts. The estimate only balances work: any number of parts gives the same pairs."""
    every = max(1, lines // SAMPLE_LINES)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [p[-1] for p in _prefixes(Lines(batch.column("text")), levels, similar, least)]
        token, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return record(token=token.astype(np.int64), n=n.astype(np.int64))

    rows = docs.select(F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0) if every > 1 else rows
    counts = map_texts(rows.select("text"), work, "token long, n long", most=PIECE).groupBy("token").agg((F.sum("n") * every).alias("n"))
    return {r["token"]: -(-r["n"] // cell_rows) for r in counts.filter(F.col("n") > cell_rows).collect()}


def entries(rows: DataFrame, levels: np.ndarray, parts: dict[int, int], similar: float, least: int, n_parts: int, only: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``(part, kind, n, rows)``: packed entries of the lines, dealt out by the keys under which lines
    meet: kind 0 by first words, kind 1 by the whole set of words, and kind -1 of lines that are settled: of
    lines with one set of words in a piece only the first enters. With ``only`` (see ``_first_words``) lines
    enter by these first words alone, if their size and place allow a match with a line that has them."""
    hot = np.array(sorted(parts), np.uint64)
    n_cells = np.array([parts[int(t)] for t in hot], np.int64)

    def dealt(e: np.ndarray, key: np.ndarray, kind: int) -> pa.RecordBatch:
        part = (mixed(key + np.uint64(0x9E37)) % np.uint64(n_parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        e, part = e[order], part[order]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        stop = np.r_[first[1:], len(e)]
        return record(part=part[first], kind=np.full(len(first), kind, np.int32), n=(stop - first).astype(np.int32), rows=pa.array([_pack(e[i:j]) for i, j in zip(first, stop, strict=True)], pa.binary()))

    def enter(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        x = Lines(batch.column("text"))
        docs_, hashes = batch.column("doc").to_numpy(), batch.column("h").to_numpy()
        for lines, size, own, check, hi, lo, of, place, token in _prefixes(x, levels, similar, least):
            e = np.zeros(len(lines), _PREFIX)
            e["doc"], e["h"], e["line"] = docs_[x.doc[lines]], hashes[x.doc[lines]], x.number[lines]
            e["hi"], e["lo"], e["size"], e["own"] = hi, lo, size, own & np.uint64(0xFFFFFFFF)
            order = np.lexsort((e["line"], e["h"], e["doc"], check, own))
            a, b = e[order][:-1], e[order][1:]
            same = (own[order][:-1] == own[order][1:]) & (check[order][:-1] == check[order][1:])
            stays, twin = np.ones(len(lines), bool), np.zeros(len(lines), bool)
            stays[order[1:][same]] = False
            # a document in two rows is one document: a line does not come after itself
            twin[order[1:][same & (a["doc"] == b["doc"]) & (a["h"] == b["h"]) & (a["line"] == b["line"])]] = True
            exact = np.zeros(len(lines), _EXACT)
            exact["key"], exact["check"] = own, check
            for c in ("doc", "h", "line"):
                exact[c] = e[c]
            keep = stays[of]
            if only is not None:
                at = np.minimum(np.searchsorted(only["token"], token), len(only["token"]) - 1)
                keep &= (only["token"][at] == token) & (e["doc"][of] <= only["last"][at])
                keep &= (size[of] >= similar * only["least"][at] - 1e-9) & (similar * size[of] <= only["most"][at] + 1e-9)
            p, place, token = e[of[keep]], place[keep], token[keep]
            p["pos"], key = place, mixed(token)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                split = hot[at] == token
                n = np.where(split, n_cells[at], 1)
                k = np.repeat(np.arange(len(p)), n)
                other = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                part = (mixed(p["doc"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + p["line"] + (p["h"].astype(np.uint64) << np.uint64(20))) % n.astype(np.uint64)).astype(np.int64)[k]
                p, split, key = p[k], split[k], key[k]
                low, high = np.minimum(part, other), np.maximum(part, other)
                key = np.where(split, mixed(key + mixed(low.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64))), key)
                p["side"] = np.where(split & (part != other), np.where(part < other, 1, 2), 0)
            p["key"] = key >> np.uint64(32)
            if only is None:
                yield (p, key), (exact[stays], own[stays]), (exact[~stays & ~twin], own[~stays & ~twin])
            else:
                yield (p, key), (exact[:0], own[:0]), (exact[:0], own[:0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            for rows, kind in zip(held, (0, 1, -1), strict=True):
                e, key = (np.concatenate(x) for x in zip(*rows, strict=True))
                if len(e):
                    yield dealt(e, key, kind)
                rows.clear()

        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                for found in enter(piece):
                    for rows, e in zip(held, found, strict=True):
                        rows.append(e)
                    size += len(found[0][0])
                if size > PACKED:
                    yield from packed()
                    size = 0
        if held[0]:
            yield from packed()
        give_back()

    return rows.mapInArrow(work, "part int, kind int, n int, rows binary")


def _later(e: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether entry j comes after entry i."""
    a, b = e[i], e[j]
    return (b["doc"] > a["doc"]) | (b["doc"] == a["doc"]) & ((b["h"] > a["h"]) | (b["h"] == a["h"]) & (b["line"] > a["line"]))


def _first_of_equals(key: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Entries without those that repeat the set of words of an earlier one under the same key: these are
    settled where whole sets meet."""
    with np.errstate(over="ignore"):
        same = mixed((key.astype(np.uint64) << np.uint64(32) | e["own"]) + mixed(e["lo"] + (e["hi"].astype(np.uint64) << np.uint64(21)) + e["size"]) + e["side"])
    order = np.argsort(same)
    repeats = same[order][1:] == same[order][:-1]
    among = order[np.r_[False, repeats] | np.r_[repeats, False]] if len(order) else order
    among = among[np.lexsort((e["line"][among], e["h"][among], e["doc"][among], same[among]))]
    again = among[1:][same[among][1:] == same[among][:-1]]
    keep = np.ones(len(e), bool)
    keep[again] = False
    return np.flatnonzero(keep)


def candidates(key: np.ndarray, e: np.ndarray, similar: float, most: int, only: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """``(later, earlier, differ, more)``: pairs of entries under one key that may reach the similarity:
    for each later entry its closest by sketch (``most`` 1) or up to ``most``; by how many bits they
    differ; and whether the later entry has others. ``only`` (sorted digests of sets) names the later
    lines that matter.

    Entries are sorted by size under each key and compared with the next, the one after it, and so on,
    until sizes differ too much."""
    order = _first_of_equals(key, e)
    order = order[np.lexsort((e["size"][order], key[order]))]
    n, key, e = len(order), key[order], e[order]
    size, pos = e["size"].astype(np.int64), e["pos"].astype(np.int64)
    indexed = size - _ceil(2 * similar / (1 + similar) * size) + 1  # prefix that suffices for the smaller line
    by_place = np.lexsort((e["line"], e["h"], e["doc"]))
    place = np.empty(n, np.int64)
    place[by_place] = np.arange(n)
    mine = np.ones(n, bool)
    if only is not None:
        at = np.minimum(np.searchsorted(only, e["own"]), len(only) - 1)
        mine = only[at] == e["own"]
    limit = LOOK if most == 1 else most
    had = np.zeros(n, np.int64)
    best = np.full(n, 1 << 62)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    d, none = 1, np.zeros(0, np.int64)
    # the smaller entries of the pairs, and with ``only`` the entries that matter, as the smaller and as the larger ones
    up, down = (np.flatnonzero(pos < indexed), none) if only is None else (np.flatnonzero(mine), np.flatnonzero(mine))
    looking = mine.copy()
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1 if n else none
    while True:
        up, down = up[up + d < n], down[down >= d]
        up = up[(key[up + d] == key[up]) & (size[up] >= similar * size[up + d] - 1e-9)]
        down = down[(key[down - d] == key[down]) & (size[down - d] >= similar * size[down] - 1e-9)]
        if not len(up) and not len(down):
            break
        i = up
        if only is not None:
            i = np.concatenate([up, (down - d)[~looking[down - d]]])
            i = i[pos[i] < indexed[i]]
        j = i + d
        need = _ceil(similar / (1 + similar) * (size[i] + size[j]))
        ok = np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need
        ok &= (e["side"][i] == 0) | (e["side"][i] != e["side"][j])
        a, b = i[ok], j[ok]
        differ = np.bitwise_count(e["hi"][a] ^ e["hi"][b]).astype(np.int64) + np.bitwise_count(e["lo"][a] ^ e["lo"][b])
        close = differ <= size[a] + size[b] - 2 * need[ok]
        a, b, differ = a[close], b[close], differ[close]
        if len(a):
            after, before = _later(e, a, b), _later(e, b, a)
            late, early = np.where(after, b, a), np.where(after, a, b)
            use = (after | before) & mine[late] & (had[late] <= limit)
            late, early, differ = late[use], early[use], differ[use]
            np.add.at(had, late, 1)
            if most == 1:
                np.minimum.at(best, late, differ << 40 | place[early])
            else:
                out.append((late, early, differ))
        d += 1
        if d % 64 == 0:
            looking = mine & (had <= limit)
            if only is None:  # keys where every line but the earliest, which none precedes, has met enough are finished
                waiting = np.bincount(group, looking)
                up = up[waiting[group[up]] > 1]
            else:  # here the earliest need not be among the lines that matter: each stops for itself
                up, down = up[looking[up]], down[looking[down]]
    if most == 1:
        late = np.flatnonzero(had)
        early, differ = by_place[best[late] & ((1 << 40) - 1)], best[late] >> 40
        return order[late], order[early], differ, had[late] > 1
    if not out:
        return none, none, none, none.astype(bool)
    late, early, differ = (np.concatenate(x) for x in zip(*out, strict=True))
    return order[late], order[early], differ, had[late] > limit


def _pairs(found: DataFrame, similar: float, most: int, tasks: int, only: np.ndarray | None = None) -> DataFrame:
    """``(doc, h, line, doc2, h2, line2, differ, more)``: lines that are settled as equal to an earlier one
    (doc2 null), and lines with a candidate before them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, bytes]]] = {}
        for batch in batches:
            for part, kind, n, rows in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "n", "rows")), strict=True):
                held.setdefault(part, []).append((kind, n, rows))
        while held:  # packed entries of a part are few bytes; they are unpacked part by part
            _, blobs = held.popitem()
            own = {k: [_unpack(rows, _KINDS[abs(k)], n) for kind, n, rows in blobs if kind == k] for k in (0, 1, -1)}
            prefix, exact, done = (np.concatenate([np.zeros(0, _KINDS[abs(k)]), *own[k]]) for k in (0, 1, -1))
            yield _out(done, None, False)
            x = exact[np.lexsort((exact["line"], exact["h"], exact["doc"], exact["check"], exact["key"]))]
            if len(x):
                first = np.flatnonzero(np.r_[True, (x["key"][1:] != x["key"][:-1]) | (x["check"][1:] != x["check"][:-1])])
                of = np.repeat(first, np.diff(np.r_[first, len(x)]))
                yield _out(x[_later(x, of, np.arange(len(x)))], None, False)
            late, early, differ, more = candidates(prefix["key"], prefix, similar, most, only)
            for at in range(0, len(late), 100_000):
                to = slice(at, at + 100_000)
                yield _out(prefix[late[to]], prefix[early[to]], more[to], differ[to])

    return found.repartition(tasks, "part").mapInArrow(work, "doc long, h long, line long, doc2 long, h2 long, line2 long, differ long, more boolean")


def _out(late: np.ndarray, early: np.ndarray | None, more, differ=0) -> pa.RecordBatch:
    def place(e: np.ndarray | None, mark: str) -> dict:
        if e is None:
            return {c + mark: pa.nulls(len(late), pa.int64()) for c in ("doc", "h", "line")}
        return {c + mark: e[c].astype(np.int64) for c in ("doc", "h", "line")}

    def column(v, kind) -> np.ndarray:
        return np.broadcast_to(np.asarray(v, kind), (len(late),)).copy()

    return record(**place(late, ""), **place(early, "2"), differ=column(differ, np.int64), more=column(more, bool))


def _line_words(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc, h, line, words)`` of the wanted lines: the sorted hashes of their distinct words."""
    by_doc = cut(wanted.groupBy("doc", "h").agg(F.collect_set("line").alias("lines")))
    rows = rows.withColumnRenamed("doc", "d").withColumnRenamed("h", "dh")
    side = broadcast_if_small(by_doc, 64 + 8 * F.size("lines"))
    rows = rows.join(side, (F.col("d") == F.col("doc")) & (F.col("dh") == F.col("h"))).select("doc", "h", "lines", "text").dropDuplicates(["doc", "h"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = Lines(batch.column("text"))
        lists = batch.column("lines")
        want_doc = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        want_line = pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False)
        mine = np.isin(x.doc * (1 << 32) + x.number, want_doc * (1 << 32) + want_line)
        doc, h, line, words = [], [], [], []
        docs_, hashes = batch.column("doc").to_numpy(), batch.column("h").to_numpy()
        edge = np.searchsorted(x.of, np.arange(len(x.doc) + 1))
        for k in np.flatnonzero(mine).tolist():
            doc.append(docs_[x.doc[k]])
            h.append(hashes[x.doc[k]])
            line.append(x.number[k])
            words.append(np.unique(x.words[edge[k] : edge[k + 1]]).tobytes())
        return record(doc=pa.array(doc, pa.int64()), h=pa.array(h, pa.int64()), line=pa.array(line, pa.int64()), words=pa.array(words, pa.binary()))

    return map_texts(rows, work, "doc long, h long, line long, words binary", most=PIECE)


def _verified(words: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """``(doc, h, line)`` of later lines with a pair that reaches the similarity."""
    second = words.select(F.col("doc").alias("doc2"), F.col("h").alias("h2"), F.col("line").alias("line2"), F.col("words").alias("words2"))
    both = pairs.join(words, ["doc", "h", "line"]).join(second, ["doc2", "h2", "line2"]).select("doc", "h", "line", "words", "words2")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("words").to_pylist(), batch.column("words2").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                ok.append(shared >= similar * (len(a) + len(b) - shared) - 1e-9)
            yield batch.select(["doc", "h", "line"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(work, "doc long, h long, line long").distinct()


def _first_words(wanted: DataFrame, levels: np.ndarray, similar: float) -> tuple[dict[str, np.ndarray] | None, np.ndarray | None]:
    """First words of the wanted lines (sorted tokens, with the least and most size and the last doc of the
    lines that have them) and the sorted digests of their sets, for the driver to hand out; none if there
    are too many."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column("doc").to_pylist(), batch.column("words").to_pylist(), strict=True):
                words = np.frombuffer(raw, np.uint64)
                level = levels[words >> np.uint64(64 - TABLE_BITS)].astype(np.uint64)
                tokens = np.sort(level << np.uint64(37) | words & np.uint64((1 << 37) - 1))
                n = len(tokens)
                own = _sums(words, np.zeros(1, np.int64))[0] & np.uint64(0xFFFFFFFF)
                first = np.unique(tokens[: n - int(np.ceil(similar * n - 1e-9)) + 1] & np.uint64((1 << 37) - 1))
                v = np.concatenate([first, own]).astype(np.int64)
                kind = np.r_[np.zeros(len(first), np.int32), np.ones(1, np.int32)]
                yield record(kind=kind, v=v, size=np.full(len(v), n, np.int64), doc=np.full(len(v), doc, np.int64))

    found = wanted.select("doc", "words").mapInArrow(work, "kind int, v long, size long, doc long")
    found = cut(found.groupBy("kind", "v").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.max("doc").alias("last")))
    if found.count() * 32 > BROADCAST_BYTES:
        return None, None
    got = found.toArrow().to_pandas().sort_values("v")
    first = got[got.kind == 0]
    words = {"token": first.v.to_numpy(np.uint64), **{c: first[c].to_numpy(np.int64) for c in ("least", "most", "last")}}
    return words, got[got.kind == 1].v.to_numpy(np.uint32)


def later_matches(docs: DataFrame, similar: float = SIMILAR, least: int = LEAST_WORDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(doc, h, line)`` of all lines that match an earlier one; ``doc`` is the doc_id (null: the largest
    long), ``h`` a hash of the text, or 0 if doc_id alone tells all texts apart."""
    return _matches(docs, _keyed(docs), similar, least, cell_rows)


def _matches(docs: DataFrame, keyed: bool, similar: float, least: int, cell_rows: int) -> DataFrame:
    # each step ends in a checkpoint or on the driver, so its shuffle files can go with it
    with shuffles_released(docs.sparkSession):
        return _rounds(docs, keyed, similar, least, cell_rows)


def _rounds(docs: DataFrame, keyed: bool, similar: float, least: int, cell_rows: int) -> DataFrame:
    levels, lines, words = rarity(docs)
    parts = common_first_words(docs, levels, lines, similar, least, cell_rows)
    rows = _rows(docs, keyed)
    # first words are about one word in five; four parts for each task even out their sizes
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), words // 5 // (4 * PACKED))
    key = ["doc", "h", "line"]
    pairs = cut(_pairs(entries(rows, levels, parts, similar, least, 4 * tasks), similar, 1, tasks))
    settled = cut(pairs.filter("doc2 is null").select(key).distinct())
    # the closest candidate over all words that a line shares with any other
    earlier = F.struct("doc2", "h2", "line2")
    near = pairs.filter("doc2 is not null").groupBy(key).agg(
        F.min(F.struct("differ", "doc2", "h2", "line2")).alias("c"), (F.max("more") | (F.min(earlier) != F.max(earlier))).alias("more")
    )
    near = cut(near.join(settled, key, "left_anti"))
    most = 1
    while not near.isEmpty():
        tried = cut(near.select(*key, "c.doc2", "c.h2", "c.line2"))
        held = cut(_line_words(rows, tried.select(key).union(tried.select("doc2", "h2", "line2")).distinct()))
        settled = cut(settled.union(_verified(held, tried, similar)))
        open_lines = cut(near.filter("more").select(key).distinct().join(settled, key, "left_anti"))
        if open_lines.isEmpty():
            break
        # lines with other candidates: the same again with more of them, by these lines' first words alone
        most *= MORE
        first, sets = _first_words(held.join(open_lines, key, "left_semi"), levels, similar)
        pairs = _pairs(entries(rows, levels, parts, similar, least, 4 * tasks, first), similar, most, tasks, sets)
        near = pairs.filter("doc2 is not null").select(*key, F.struct("doc2", "h2", "line2").alias("c"), "more").distinct()
        near = cut(near.join(open_lines, key, "left_semi"))
    return settled


def dedup(docs: DataFrame, similar: float = SIMILAR, least: int = LEAST_WORDS, cell_rows: int = CELL_ROWS, counts: bool = False) -> DataFrame:
    """``docs`` with the later ones of matching lines taken out of their texts; all rows and columns stay.
    With ``counts`` also ``n_lines`` and ``n_removed``.

    Lines end at line feeds; lines with fewer than ``least`` distinct words always stay. Null and empty
    texts stay as they are; a text may end up empty. Rows that repeat a doc_id with the same text count
    as one document and are treated alike."""
    keyed = _keyed(docs)
    flagged = _matches(docs, keyed, similar, least, cell_rows)
    by_doc = cut(flagged.groupBy("doc", "h").agg(F.collect_set("line").alias("lines")))
    doc, h, lines, removed, n_lines = fresh(docs, "doc", "h", "lines", "n_removed", "n_lines")
    side = broadcast_if_small(by_doc.select(F.col("doc").alias(doc), F.col("h").alias(h), F.col("lines").alias(lines)), 96 + 8 * F.size(lines))
    on = (_doc() == F.col(doc)) & (_hash(keyed) == F.col(h))
    plain = docs.join(side, on, "left_anti")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count(F.col("text").cast("string"), F.lit("\n")) + 1).cast("long")
    cutting = docs.join(side, on).drop(doc, h).withColumn(n_lines, n).withColumn(removed, F.size(lines).cast("long"))
    schema = cutting.drop(lines).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = []
                for text, gone in zip(piece.column("text").to_pylist(), piece.column(lines).to_pylist(), strict=True):
                    out = set(gone)
                    texts.append("\n".join([x for k, x in enumerate(text.split("\n")) if k not in out]))
                at = piece.schema.get_field_index("text")
                yield piece.set_column(at, "text", pa.array(texts, pa.string())).drop_columns([lines])

    done = cutting.mapInArrow(work, schema)
    plain = plain.withColumn(n_lines, n).withColumn(removed, F.lit(0).cast("long"))
    both = plain.unionByName(done)
    if not counts:
        return both.select(*docs.columns)
    return both.select(*docs.columns, F.col(n_lines).alias("n_lines"), F.col(removed).alias("n_removed"))
