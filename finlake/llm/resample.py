"""Target-distribution importance resampling: hashed feature counts of all documents and of the target give
each bucket a gain, a document's weight is the mean gain of its features, and the highest scores (weight plus
a Gumbel draw) are taken. The cutoff key is found by weighted median of medians over the partitions: their
medians, weighted by what remains in each, split the keys so that a sure share is discarded every round."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALONE, LOWER, cut, map_texts, pieces, record, utf8, word_bounds
from .mixing import ranked

#: Buckets of the hashed features, words of the longest feature, words a drawn document needs, hundredths
#: of those documents that are drawn, and the salt of the draw.
BUCKETS = 10_000
MOST_WORDS = 1
LEAST_WORDS = 20
SHARE = 10
SALT = "2024"
#: So many keys are sorted at once when no more remain.
LAST = 4096

# What separates the words of the contract, and the polynomial of crc32.
OTHER = np.zeros(256, bool)
OTHER[0x00:0x30] = OTHER[0x3A:0x61] = OTHER[0x7B:0x80] = True
POLYNOMIAL = 0xEDB88320


def _crc_steps() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1)
    return out.astype(np.uint32)


CRC = _crc_steps()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each stretch of bytes, one byte of all stretches at a time; very long ones go alone."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    at, place = np.flatnonzero((size > 0) & (size <= ALONE)), 0
    while len(at):
        now = out[at]
        out[at] = CRC[(now ^ data[starts[at] + place]) & np.uint32(255)] ^ (now >> np.uint32(8))
        place += 1
        at = at[size[at] > place]
    out = out ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > ALONE).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def features(texts: pa.Array, most_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature, the text it is in, and the number of words of each text. Features are all
    runs of 1 to ``most_words`` words joined by one space."""
    data, offsets = utf8(texts)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, OTHER)
    words = np.diff(first)
    of = np.repeat(np.arange(len(words)), words)
    bucket, text = [crc32(data, starts, ends) % np.uint32(buckets)], [of]
    if most_words > 1 and len(starts):
        size = ends - starts + 1
        places = np.cumsum(size) - size
        joined = np.concatenate([data, np.zeros(1, np.uint8)])[np.arange(int(size.sum())) - np.repeat(places - starts, size)]
        joined[places + size - 1] = 32
        for n in range(2, most_words + 1):
            i = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
            bucket.append(crc32(joined, places[i], places[i + n - 1] + size[i + n - 1] - 1) % np.uint32(buckets))
            text.append(of[i])
    return np.concatenate(bucket).astype(np.int64), np.concatenate(text), words


def bucket_counts(rows: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket. Every task sums its own texts first, and only
    one number for each bucket reaches the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                total += np.bincount(features(piece.column("text"), most_words, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield record(bucket=some, n=total[some])

    sums = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most one row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, with one feature added
    to every bucket on both sides."""
    n = len(source)
    up = (target + 1).astype(float) * float(source.sum() + n)
    down = (source + 1).astype(float) * float(target.sum() + n)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, most_words: int = MOST_WORDS, salt: str = SALT) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of ``docs``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket, of, words = features(batch.column("text"), most_words, len(gain))
        n = np.bincount(of, minlength=batch.num_rows).astype(np.int64)
        total = np.zeros(batch.num_rows, np.int64)
        np.add.at(total, of, gain[bucket])
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        ids = ["" if i is None else str(i) for i in batch.column("doc_id").to_pylist()]
        h = np.array([int(hashlib.sha256(f"{salt}:{i}".encode()).hexdigest()[:8], 16) for i in ids], np.float64)
        draw = np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296.0))).astype(np.int64)
        return record(doc_id=batch.column("doc_id"), n_words=words.astype(np.int64), n_features=n, weight=weight, score=weight + draw)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_texts(rows, work, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


class Keys:
    """Some keys in order: highest score first, then smallest doc_id (null last), then place in the table."""

    def __init__(self, down: np.ndarray, nameless: np.ndarray, doc: np.ndarray, at: np.ndarray):
        order = np.lexsort((at, doc, nameless, down))
        self.columns = [c[order] for c in (down, nameless, doc, at)]

    def __len__(self) -> int:
        return len(self.columns[0])

    def __getitem__(self, k: int) -> tuple[int, int, int, int]:
        return tuple(int(c[k]) for c in self.columns)

    def before(self, key: tuple[int, int, int, int]) -> int:
        """How many keys come before ``key``."""
        low, high = 0, len(self)
        for column, value in zip(self.columns, key, strict=True):
            part = column[low:high]
            low, high = low + int(np.searchsorted(part, value, "left")), low + int(np.searchsorted(part, value, "right"))
        return low


def _keys(batches, after, until) -> Keys:
    parts = [[np.zeros(0, np.int64)] * 4]
    for b in batches:
        doc = b.column("doc_id")
        nameless = doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = doc.cast(pa.int64()).fill_null(0).to_numpy()
        parts.append([-b.column("score").to_numpy(), nameless, doc, b.column("at").to_numpy()])
    keys = Keys(*[np.concatenate(c) for c in zip(*parts, strict=True)])
    low = 0 if after is None else keys.before(after)
    high = len(keys) if until is None else keys.before(until)
    keys.columns = [c[low:high] for c in keys.columns]
    return keys


_PARTS = "n_before long, n_after long, before binary, after binary"


def _halves(rows: DataFrame, after, until, pivot) -> list[tuple]:
    """For each partition with keys from ``after`` to before ``until``: how many come before the pivot and
    how many do not, and the median of either half (the lower one)."""

    def run(batches):
        keys = _keys(batches, after, until)
        if not len(keys):
            return
        m = keys.before(pivot) if pivot is not None else 0
        middle = lambda a, b: np.array(keys[(a + b - 1) // 2], np.int64).tobytes() if b > a else None
        yield record(n_before=[m], n_after=[len(keys) - m], before=pa.array([middle(0, m)], pa.binary()), after=pa.array([middle(m, len(keys))], pa.binary()))

    key = lambda raw: None if raw is None else tuple(np.frombuffer(raw, np.int64).tolist())
    return [(r["n_before"], r["n_after"], key(r["before"]), key(r["after"])) for r in rows.mapInArrow(run, _PARTS).collect()]


def _median_of_medians(parts: list[tuple[tuple, int]]) -> tuple | None:
    """The median of the medians, each weighted by the keys it stands for."""
    parts, seen = sorted(parts), 0
    total = sum(n for _, n in parts)
    for key, n in parts:
        seen += n
        if 2 * seen >= total:
            return key
    return None


def cutoff(rows: DataFrame, count: int, last: int = LAST) -> tuple | None:
    """The key at place ``count`` (from 0) of ``rows``, in order; null if there are no more than ``count``.

    ``rows`` has doc_id (a whole number), score and a unique ``at``, and is cut. A task sorts the remaining
    keys of its own partition; the driver gets one line for each partition, and every round a quarter of the
    keys at least falls away. When half of the stored keys are gone, the rest is stored anew; ``last`` or
    fewer are sorted at once."""
    rows = rows.select("doc_id", "score", "at").coalesce(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    after = until = None
    parts = _halves(rows, None, None, None)
    stored = remaining = sum(p[1] for p in parts)
    if count >= remaining:
        return None
    pivot = _median_of_medians([(p[3], p[1]) for p in parts])
    while remaining > max(last, 8):
        parts = _halves(rows, after, until, pivot)
        before = sum(p[0] for p in parts)
        if count < before:
            until, remaining, pivot = pivot, before, _median_of_medians([(p[2], p[0]) for p in parts if p[0]])
        else:
            count, after, remaining = count - before, pivot, remaining - before
            pivot = _median_of_medians([(p[3], p[1]) for p in parts if p[1]])
        if remaining > last and 2 * remaining <= stored:
            rows, stored = cut(_between(rows, after, until)), remaining
    left = _keys(_between(rows, after, until).toArrow().to_batches(), after, until)
    return left[count]


def _between(rows: DataFrame, after, until) -> DataFrame:
    out = rows
    if after is not None:
        out = out.filter(~_comes_before(after))
    if until is not None:
        out = out.filter(_comes_before(until))
    return out


def _comes_before(key: tuple):
    """Whether a row's key comes before ``key``."""
    down, nameless, doc, at = key
    score, doc_id = F.col("score"), F.col("doc_id")
    if nameless:
        same = doc_id.isNull() & (F.col("at") < at)
        return (score > -down) | ((score == -down) & (doc_id.isNotNull() | same))
    inside = doc_id.isNotNull() & ((doc_id < doc) | ((doc_id == doc) & (F.col("at") < at)))
    return (score > -down) | ((score == -down) & inside)


def draw(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, most_words: int = MOST_WORDS, buckets: int = BUCKETS, salt: str = SALT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score and rank. Of the rows with at least
    ``least_words`` words, floor(share / 100 of them) with the highest scores (ties: smaller doc_id) are drawn
    and ranked 1, 2, 3, ...; the others have a null rank.

    ``docs`` and ``target`` need a text, ``docs`` a whole-number doc_id. Null texts have no features and
    weight 0; a null doc_id draws as an empty one and is the last of a tie; repeated rows count, draw and rank
    as rows of their own. An empty target leaves gains of even smoothing; an empty table gives an empty table."""
    gain = gains(bucket_counts(docs, most_words, buckets), bucket_counts(target, most_words, buckets))
    rows = cut(weighted(docs, gain, most_words, salt).withColumn("at", F.monotonically_increasing_id()))
    able = rows.filter(F.col("n_words") >= least_words)
    count = share * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not count:
        return rows.select(*columns, none)
    edge = cutoff(able, count)
    chosen = F.col("n_words") >= least_words
    if edge is not None:
        chosen = chosen & _comes_before(edge)
    chosen = F.coalesce(chosen, F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at").asc()]
    winners = ranked(rows.filter(chosen).select(*columns, "at"), order, "place").select(*columns, (F.col("place") + 1).alias("rank"))
    return winners.unionByName(rows.filter(~chosen).select(*columns, none))


#: The same for DuckDB; crc32 is folded over the bytes of each distinct word.
SQL = f"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8)::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}::BIGINT) ELSE c >> 1 END, i::BIGINT) AS c FROM range(256) r(i))),
docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
marks AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
words AS (SELECT row, w, count(*) AS n FROM (SELECT row, unnest(w) AS w FROM docs) GROUP BY row, w),
vocabulary AS (
  SELECT w, xor(list_reduce(list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM (SELECT w FROM words UNION SELECT w FROM marks), steps),
source AS (SELECT bucket, sum(n)::DOUBLE AS s FROM words JOIN vocabulary USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*)::DOUBLE AS t FROM marks JOIN vocabulary USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM source) + {BUCKETS}) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM target) + {BUCKETS}))))::BIGINT AS g
  FROM source LEFT JOIN target USING (bucket)),
sums AS (SELECT row, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS g FROM words JOIN vocabulary USING (w) JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('{SALT}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS draw
  FROM docs LEFT JOIN sums USING (row)),
placed AS (
  SELECT doc_id, n_features, weight, weight + draw AS score,
         row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY weight + draw DESC, doc_id NULLS LAST) AS place,
         count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS able
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= {SHARE} * able // 100 THEN place END::BIGINT AS rank FROM placed
"""
