"""Document fingerprints by content-defined chunking: a gear hash over the bytes proposes boundaries,
normalised around a usual size, and a text's fingerprint is the set of its chunks' digests with the
length that each covers. Likeness is containment: the length that both share over the smaller of the two
lengths."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, pieces, record, text_of, utf8

#: Chunk sizes in bytes: least, usual, most. A boundary needs STRICT zero bits of the gear hash before the
#: usual size and LOOSE after it.
LEAST, USUAL, MOST = 16, 48, 192
STRICT, LOOSE = 7, 4
#: Bytes that the judged bits of the gear hash depend on; also how many bits it keeps.
REACH = 16

_GEAR = np.random.default_rng(20240607).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i - 1] + G[byte i], modulo 2^16, for all places: sums over 2, 4, 8 and 16 bytes. What
    is older than 16 bytes has been shifted out."""
    h = _GEAR[data]
    width = 1
    while width < REACH:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint16(width)
        h, width = longer, 2 * width
    return h


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of all texts, and whose they are. Each text is padded apart from the one
    before, so that its boundaries depend on its own bytes only."""
    n = len(offsets) - 1
    shift = np.arange(n) * REACH
    room = np.zeros(len(data) + n * REACH + REACH, np.uint8)
    sizes = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(shift + REACH, sizes)
    room[place] = data
    h = gear(room)[place] if len(data) else np.zeros(0, np.uint16)
    # the upper half of the bits: each depends on nine bytes at least
    loose = np.flatnonzero(h >> np.uint16(16 - LOOSE) == 0)
    strict = (h[loose] >> np.uint16(16 - STRICT) == 0).tolist()
    first = np.searchsorted(loose, offsets).tolist()
    cuts, spots = (loose + 1).tolist(), offsets.tolist()
    ends: list[int] = []
    counts = []
    for i in range(n):
        start, stop, k, had = spots[i], spots[i + 1], first[i], len(ends)
        last = first[i + 1]
        while start < stop:
            end = min(start + MOST, stop)
            low, usual = start + LEAST, start + USUAL
            while k < last and cuts[k] < low:
                k += 1
            j = k
            while j < last and cuts[j] < end:
                if cuts[j] > usual or strict[j]:
                    end = cuts[j]
                    break
                j += 1
            ends.append(end)
            start = end
        counts.append(len(ends) - had)
    return np.array(ends, np.int64), np.repeat(np.arange(n), counts)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[dict[str, int]]:
    """Digest -> bytes covered by the chunks with that digest, for each text."""
    ends, of = boundaries(data, offsets)
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    raw, digest = data.tobytes(), xxhash.xxh3_64_hexdigest
    out: list[dict[str, int]] = [{} for _ in range(len(offsets) - 1)]
    for i, a, b in zip(of.tolist(), starts.tolist(), ends.tolist(), strict=True):
        d = digest(raw[a:b])[:12]
        own = out[i]
        own[d] = own.get(d, 0) + b - a
    return out


def written(fingerprint: dict[str, int]) -> str:
    """Digests in order, each with the bytes it covers: ``digest*bytes``, joined by blanks."""
    return " ".join([f"{d}*{fingerprint[d]}" for d in sorted(fingerprint)])


def read(text: str) -> dict[str, int]:
    return {d: int(n) for d, n in (x.split("*") for x in text.split())}


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Containment: shared length over the smaller total length; two empty texts are alike, an empty
    and another one are not."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    if len(a) > len(b):
        a, b = b, a
    shared = sum([min(n, b[d]) for d, n in a.items() if d in b])
    return shared / min(sum(a.values()), sum(b.values()))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as much of the start of ``following``,
    or by all of it."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` of every whole text; null counts as empty, and an empty text's
    fingerprint is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column("text"))
        return record(doc_id=batch.column("doc_id"), n_chars=pa.array([len(t or "") for t in batch.column("text").to_pylist()], pa.int64()), fingerprint=pa.array(map(written, fingerprints(data, offsets)), pa.string()))

    return map_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")), work, f"doc_id {kind}, n_chars long, fingerprint string")


def _compared(texts: list[str], following: list[str]) -> dict[str, list]:
    """The result columns for texts and the texts that follow them."""
    new = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    own, other, after = (fingerprints(*utf8(pa.array(x, pa.string()))) for x in (texts, new, following))
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
        "fingerprint": [written(f) for f in own],
        "edited_fingerprint": [written(f) for f in other],
        "near_edited": [likeness(a, b) for a, b in zip(own, other, strict=True)],
        "near_next": [likeness(a, b) for a, b in zip(own, after, strict=True)],
    }


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, the SHA-256 of its edited text (see ``edited``; the
    following document is the next one by doc_id, after the last one the first), its fingerprint and
    that of the edited text, and their likeness to each other (near_edited) and to the following
    document's fingerprint (near_next).

    Null texts are empty. Rows without doc_id come first; rows with the same doc_id are ordered by a hash
    of their text. A table of one row follows itself.

    Ranges of doc_id are dealt out, so texts are shuffled once; each range also gets the first row of
    the range after it. Only the bounds and first keys of the ranges, a few numbers for each task, reach
    the driver."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text_of().alias("text"))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / tasks for k in range(1, tasks)] or [0.5])).first()[0]
    bounds = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("int")
    def in_range(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), side="right").astype(np.int32))

    rows = rows.withColumn("h", F.xxhash64("text"))
    if len(bounds):
        rows = rows.withColumn("part", in_range(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))))
    else:
        rows = rows.withColumn("part", F.lit(0))
    heads = rows.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("head")).collect()
    heads = sorted([(r["part"], r["head"]["doc_id"], r["head"]["h"]) for r in heads], key=lambda x: x[0])
    if not heads:
        return spark.createDataFrame([], f"doc_id {kind}, {_SCHEMA}")
    guards = [(heads[(k + 1) % len(heads)][1], heads[(k + 1) % len(heads)][2], part) for k, (part, _, _) in enumerate(heads)]
    wanted = F.broadcast(spark.createDataFrame(guards, f"g_id {kind}, g_h long, g_part int"))
    base = rows.select("doc_id", "text", "h")
    guard = base.join(wanted, base["doc_id"].eqNullSafe(F.col("g_id")) & (base["h"] == F.col("g_h"))).select("doc_id", "text", "h", F.col("g_part").alias("part"), F.lit(True).alias("guard")).dropDuplicates(["part"])
    dealt = rows.select("doc_id", "text", "h", "part", F.lit(False).alias("guard")).union(guard)
    dealt = dealt.repartition(tasks, "part").sortWithinPartitions("part", "guard", F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text", "guard")

    def work(batches):
        held = None
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, texts, guard = (piece.column(c).to_pylist() for c in ("doc_id", "text", "guard"))
                if not ids:
                    continue
                if held is not None:
                    ids, texts, guard = [held[0], *ids], [held[1], *texts], [False, *guard]
                pairs = [k for k in range(len(ids) - 1) if not guard[k]]
                held = None if guard[-1] else (ids[-1], texts[-1])
                if pairs:
                    found = _compared([texts[k] for k in pairs], [texts[k + 1] for k in pairs])
                    yield record(doc_id=pa.array([ids[k] for k in pairs], piece.column("doc_id").type), **_arrays(found))

    return dealt.mapInArrow(work, f"doc_id {kind}, {_SCHEMA}")


_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _arrays(columns: dict[str, list]) -> dict[str, pa.Array]:
    return {c: pa.array(v, _TYPES[c]) for c, v in columns.items()}
