"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of a binary trie.

Pairs of trie nodes go down together; a pair collects an error wherever its nodes take different
bits and is dropped once the errors exceed the budget. To deal the work out, the 64 bits are cut into
``blocks`` blocks: two fingerprints within ``budget`` bits agree on ``blocks - budget`` of them, so for
each choice of that many blocks one trie is rooted at each value of the chosen bits, and only nodes
under one root meet. More blocks are taken as the number of fingerprints grows, so that roots stay
small; the links found are the same.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, broadcast_if_small, cut, fresh, map_texts, record, utf8, word_bounds
from .components import components

BITS = 64
SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints under one root that one task joins at once; larger roots are dealt out as pairs of parts.
CELL_ROWS = 8192
#: Node pairs that are expanded at once.
FRONT = 1 << 18
#: Bytes of text, and shingles, that are handled at once.
PIECE = 1 << 20
SHINGLES = 1 << 16


def _single_spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased text whose white-space runs are one blank each, with the new offsets."""
    space = SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    out = LOWER[data]
    out[space] = 32
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out[keep], kept[offsets]


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprint of each text: bit i is 1 if set in over half of its shingles' hashes."""
    data, offsets = _single_spaced(data, offsets)
    starts, ends, before = word_bounds(data, offsets)
    n_words = np.diff(before)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    of = np.repeat(np.arange(len(n_words)), n_shingles)
    first_shingle = np.cumsum(n_shingles) - n_shingles
    first = before[:-1][of] + np.arange(len(of)) - first_shingle[of]
    last = np.minimum(first + words, before[1:][of]) - 1
    ones = np.zeros((len(n_words), BITS), np.int64)
    raw, digest = data.tobytes(), xxhash.xxh64_digest
    step = SHINGLES
    for at in range(0, len(of), step):
        a, b = starts[first[at : at + step]].tolist(), ends[last[at : at + step]].tolist()
        joined = b"".join([digest(raw[i:j], SEED) for i, j in zip(a, b, strict=True)])
        bits = np.unpackbits(np.frombuffer(joined, np.uint8).reshape(-1, 8), axis=1)
        here = of[at : at + step]
        runs = np.flatnonzero(np.diff(here, prepend=-1))
        ones[here[runs]] += np.add.reduceat(bits, runs, axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > n_shingles[:, None], axis=1)
    return packed.view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, row_key, fp)`` for every row; ``fp`` is the fingerprint as a signed long and
    ``row_key`` a hash of the text. Null and wordless texts have fingerprint zero."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column("text"))
        return record(doc_id=batch.column("doc_id"), row_key=batch.column("row_key"), fp=fingerprints_of(data, offsets, words).view(np.int64))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("row_key"))
    return map_texts(rows, work, f"doc_id {kind}, row_key long, fp long", most=PIECE)


# --------------------------------------------------------------------------------------- the trie join


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; ``label`` holds each item's smallest member again after."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def trie_links(root: np.ndarray, left: np.ndarray, code: np.ndarray, budget: int = MAX_BITS, front: int = FRONT) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(i, j)`` that connect all codes with the same root which differ in ``budget`` bits or
    fewer (a spanning forest of those links). With ``left`` (0, 1 or 2 for each item) a root's items of
    side 0 meet each other; items of sides 1 and 2 only meet across.

    Each root's sorted codes are a binary trie: a node is a range of them and its children are found
    by counting zeros of the next bit. Pairs of ranges go down together."""
    n = len(code)
    order = np.lexsort((code, left, root))
    code, group = code[order], root[order]
    side = left[order]
    zeros = np.empty(n + 1, np.int64)
    label = np.arange(n)
    heads = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])]) if n else np.zeros(0, np.int64)
    tails = np.r_[heads[1:], n] if n else heads
    alone = side[heads] == 0
    a0 = heads[alone], tails[alone]
    cross = np.flatnonzero(side[heads] == 1)
    cross = cross[(cross + 1 < len(heads))]
    cross = cross[(group[heads[cross + 1]] == group[heads[cross]]) & (side[heads[cross + 1]] == 2)] if len(cross) else cross
    lo1, hi1 = np.r_[a0[0], heads[cross]], np.r_[a0[1], tails[cross]]
    lo2, hi2 = np.r_[a0[0], heads[cross + 1]] if len(cross) else a0[0], np.r_[a0[1], tails[cross + 1]] if len(cross) else a0[1]
    counts: dict[int, np.ndarray] = {}

    def zero_sums(bit: int) -> np.ndarray:
        if bit not in counts:
            zeros[0] = 0
            np.cumsum((code >> np.uint64(BITS - 1 - bit)) & np.uint64(1) == 0, out=zeros[1:])
            counts[bit] = zeros.astype(np.int32)
        return counts[bit]

    stack = [(0, lo1, hi1, lo2, hi2, np.zeros(len(lo1), np.int64))]
    while stack:
        bit, lo1, hi1, lo2, hi2, err = stack.pop()
        if len(lo1) > front:  # later parts wait: what the first parts join prunes them
            half = len(lo1) // 2
            stack.append((bit, lo1[half:], hi1[half:], lo2[half:], hi2[half:], err[half:]))
            stack.append((bit, lo1[:half], hi1[:half], lo2[:half], hi2[:half], err[:half]))
            continue
        # a node pair whose items are all in one class already has nothing to add
        breaks = np.zeros(n + 1, np.int32)
        np.cumsum(np.r_[False, label[1:] != label[:-1]], out=breaks[1:])
        done = (label[lo1] == label[lo2]) & (breaks[hi1] == breaks[lo1 + 1]) & (breaks[hi2] == breaks[lo2 + 1])
        one = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        leaf = one & ~done
        if leaf.any():
            u, v = lo1[leaf], lo2[leaf]
            near = np.bitwise_count(code[u] ^ code[v]) <= budget
            _settle(label, u[near], v[near])
        go = ~(done | one)
        if not go.any():
            continue
        lo1, hi1, lo2, hi2, err = lo1[go], hi1[go], lo2[go], hi2[go], err[go]
        if bit == BITS:  # equal codes under one leaf
            wide = np.flatnonzero(lo1 == lo2)
            for i in wide:
                _settle(label, np.arange(lo1[i] + 1, hi1[i]), np.full(hi1[i] - lo1[i] - 1, lo1[i]))
            for i in np.flatnonzero(lo1 != lo2):
                _settle(label, np.arange(lo1[i], hi1[i]), np.full(hi1[i] - lo1[i], lo2[i]))
                _settle(label, np.arange(lo2[i], hi2[i]), np.full(hi2[i] - lo2[i], lo1[i]))
            continue
        c = zero_sums(bit)
        mid1, mid2 = lo1 + c[hi1] - c[lo1], lo2 + c[hi2] - c[lo2]
        same = lo1 == lo2
        parts = []
        for p, q, r, s, more, ok in (
            (lo1, mid1, mid2, hi2, 1, err < budget),
            (mid1, hi1, lo2, mid2, 1, (err < budget) & ~same),
            (mid1, hi1, mid2, hi2, 0, True),
            (lo1, mid1, lo2, mid2, 0, True),
        ):
            live = (p < q) & (r < s) & ok
            parts.append((p[live], q[live], r[live], s[live], err[live] + more))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        stack.append((bit + 1, *joined))
    moved = np.flatnonzero(label != np.arange(n))
    return order[moved], order[label[moved]]


def _layout(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block, from the top."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _block_count(n: int, budget: int) -> int:
    """The fewest blocks for which a root has at most a few hundred of ``n`` evenly spread
    fingerprints."""
    for blocks in range(budget + 1, budget + 5):
        if n >> (BITS * (blocks - budget) // blocks) < 512 or comb(blocks + 1, budget) > 500:
            break
    return blocks


def near_links(fps: DataFrame, budget: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``fp``, cut before) that connect all
    pairs within ``budget`` bits."""
    n = fps.count()
    layout = _layout(_block_count(n, budget))
    choices = list(combinations(range(len(layout)), len(layout) - budget))
    roots = []
    for k, chosen in enumerate(choices):
        value = F.lit(k).cast("long")
        for i in chosen:
            first, width = layout[i]
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(F.shiftleft("fp", first), BITS - width)) if len(chosen) == 1 else F.xxhash64(value, F.lit(i), F.shiftrightunsigned(F.shiftleft("fp", first), BITS - width))
        roots.append(value)
    at_root = fps.select("fp", F.explode(F.array(*roots)).alias("root"))
    # roots with many fingerprints are dealt out: parts meet in pairs, each pair in one cell
    large = cut(at_root.groupBy("root").count().filter(F.col("count") > cell_rows).select("root", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts")))
    if large.isEmpty():
        cells = at_root.select("fp", F.col("root").alias("cell"), F.lit(0).alias("side"))
    else:
        dealt = at_root.join(broadcast_if_small(large, 16), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        low, high = F.least("part", "other"), F.greatest("part", "other")
        cells = dealt.select(
            "fp",
            F.when(F.col("parts") == 1, F.col("root")).otherwise(F.xxhash64("root", low, high)).alias("cell"),
            F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side"),
        )

    def work(batches):
        # one partition's cells: a few cells of bounded size, held as arrays
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        fp, cell, side = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("fp", "cell", "side"))
        i, j = trie_links(cell.view(np.uint64), side, fp.view(np.uint64), budget)
        yield record(a=fp[i], b=fp[j])

    spark = fps.sparkSession
    # about 250,000 rows of 20 bytes in a task
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(choices) // 250_000)
    return cells.repartition(tasks, "cell").mapInArrow(work, "a long, b long")


def groups(docs: DataFrame, words: int = SHINGLE_WORDS, budget: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``row_key`` (hash of the text), ``fp`` (signed long),
    ``fingerprint`` (16 hex digits), ``root`` (a fingerprint that names the component) and
    ``component_id``, the smallest doc_id reachable over links of ``budget`` or fewer differing bits.

    Repeated rows are returned as often as they occur; equal texts share a fingerprint and so a
    component. Rows without doc_id take part; their component's id is the smallest that is not null,
    or null if there is none. An empty table gives an empty table."""
    marked = cut(fingerprints(docs, words))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = cut(components(near_links(distinct.select("fp"), budget)))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(ids, "root")
    return marked.join(of, "fp").select("doc_id", "row_key", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "root", "component_id")


def drop_near_copies(docs: DataFrame, words: int = SHINGLE_WORDS, budget: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (rows without one come
    last, then the smaller hash of the text; of rows alike in both, any one). All columns stay."""
    found = cut(groups(docs, words, budget).select("doc_id", "row_key", "root"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("k"))
    kept = first.select(F.col("k.doc_id").alias("doc_id"), F.col("k.row_key").alias("row_key"))
    dropped = cut(found.select("doc_id", "row_key").join(kept, (found.doc_id.eqNullSafe(kept.doc_id)) & (found.row_key == kept.row_key), "left_anti").distinct())
    # rows that share both keys with a kept row are told apart in their own, usually empty, branch
    again = cut(found.groupBy("doc_id", "row_key").count().filter("count > 1").select("doc_id", "row_key"))
    key, text_key = fresh(docs, "id", "key")
    rows = docs.withColumn(text_key, F.xxhash64("text"))

    def keyed(df: DataFrame) -> DataFrame:
        return broadcast_if_small(df.select(F.col("doc_id").alias(key), F.col("row_key").alias(text_key)), 24)

    def without(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        k = keyed(keys)
        return df.join(k, (df["doc_id"].eqNullSafe(k[key])) & (df[text_key] == k[text_key]), how)

    rows = without(rows, dropped, "left_anti")
    if again.isEmpty():
        return rows.select(*docs.columns)
    single = without(rows, again, "left_anti")
    repeated = without(rows, again, "left_semi").dropDuplicates(["doc_id", text_key])
    return single.unionByName(repeated).select(*docs.columns)
