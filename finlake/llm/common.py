"""Helpers that the operators share: whole texts as numpy byte arrays, Arrow maps that work on
bounded pieces, lineage cuts in the shared checkpoint folder, and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# The white space of every word contract, and ASCII lower case.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Text handled at once inside a task; one longer text is a piece of its own.
PIECE_BYTES = 4 << 20

#: Words of more bytes are hashed one by one.
ALONE = 512

#: A side is broadcast only if it was counted and stays below this many bytes.
BROADCAST_BYTES = 16 << 20


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that all executors share and read it from there, so that
    a lost executor never replays what came before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (cut before) with a broadcast hint if its size, added up from ``row_bytes`` (a column where rows
    differ), is below ``limit``; otherwise as it is, for a shuffled join whose skewed partitions Spark splits."""
    size = df.agg(F.sum(row_bytes)).first()[0] or 0 if isinstance(row_bytes, Column) else df.count() * row_bytes
    return F.broadcast(df) if size <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names close to ``names`` that no column of ``df`` has, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"llm_{name}"
        while new.lower() in have:
            new += "_"
        have.add(new.lower())
        out.append(new)
    return out


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; a null text has none."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most ``most`` bytes together, one row at least."""
    _, offsets = utf8(batch.column(text))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Return freed memory to the system: workers are used again by later stages, whose own peaks would
    otherwise come on top of what this one freed but kept."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not with every C library
    _TRIM = None


def map_texts(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch],
    schema: str,
    text: str = "text",
    most: int = PIECE_BYTES,
) -> DataFrame:
    """``work`` over bounded pieces of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, most):
                out = work(piece)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
                del out
        give_back()

    return df.mapInArrow(run, schema)


def word_bounds(data: np.ndarray, offsets: np.ndarray, other: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words (runs of bytes not in ``other``, by default
    ``[^\\x20\\x09-\\x0D]+``) and, for each text, how many words came before it (n + 1 values). Only
    ASCII bytes are in ``other``, and no byte of a longer UTF-8 character is one, so bytes suffice."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~other[data]
    first = np.ones(n, bool)
    first[1:] = ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.ones(n, bool)
    last[:-1] = ~inside[1:]
    stops = offsets[1:][np.diff(offsets) > 0]
    last[stops - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes of all words at a time; very long ones go alone."""
    length = ends - starts
    out = mixed(length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(1))
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(room) - 7, "<u8", room, strides=(1,))
    at, place = np.flatnonzero((length > 0) & (length <= ALONE)), 0
    while len(at):
        left = length[at] - place
        chunk = eight[starts[at] + place]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        out[at] = mixed((out[at] ^ chunk) * np.uint64(0x9E3779B97F4A7C15))
        place += 8
        at = at[left > 8]
    for i in np.flatnonzero(length > ALONE).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def record(schema: str | None = None, **columns) -> pa.RecordBatch:
    """A record batch from named arrays."""
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    value = spark.conf.get(key, None)
    return int(value) if value else default
