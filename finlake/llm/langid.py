"""Language ID by a small byte convolutional network: filters of several widths over embedded bytes,
maximum over each fixed-length window, softmax. It is trained in numpy on windows of labelled text and
applied to all windows of every text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, map_texts, pieces, record, utf8

#: Bytes of a window; embedding size; filter widths and filters of each.
WINDOW = 128
EMBED = 6
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
#: The classifier is fitted on a bounded sample: at most this many texts of each language, chosen by
#: hash, and this many windows of each.
TEXTS = 500
WINDOWS = 4
#: More languages than this are not learned in part: training stops with an error.
LANGUAGES = 200
EPOCHS = 8
UNKNOWN = "und"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters (ASCII and Latin-1 accents) and other non-ASCII bytes, with one blank for
    each run of anything else; and the new offsets."""
    out = _LETTER[data]
    if len(data):
        accent = np.zeros(len(data), bool)
        accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[accent] += 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out[keep], kept[offsets]


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts (the last of a text is filled up with blanks) and whose they are."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    of = np.repeat(np.arange(len(n)), n)
    start = offsets[:-1][of] + (np.arange(len(of)) - (np.cumsum(n) - n)[of]) * WINDOW
    place = start[:, None] + np.arange(WINDOW)
    inside = place < offsets[1:][of][:, None]
    return np.where(inside, data[np.minimum(place, max(len(data) - 1, 0))], np.uint8(32)) if len(of) else np.zeros((0, WINDOW), np.uint8), of


class Network:
    """Parameters: ``embed`` (256, EMBED), ``conv`` (widest * EMBED, filters), ``bias``, ``out``, ``out_bias``."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        n, wide = FILTERS * len(WIDTHS), max(WIDTHS)
        self.mask = np.concatenate([np.repeat((np.arange(wide) < w)[:, None], FILTERS, 1) for w in WIDTHS], axis=1).repeat(EMBED, axis=0).astype(np.float32)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "conv": (rng.normal(0, 0.35, (wide * EMBED, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.2, (n, len(languages))).astype(np.float32),
            "out_bias": np.zeros(len(languages), np.float32),
        }

    def _rows(self, x: np.ndarray) -> np.ndarray:
        """Embedded bytes under the widest filter at each place of each window."""
        wide, e = max(WIDTHS), self.p["embed"][x].reshape(len(x), -1)
        places = WINDOW - wide + 1
        return np.lib.stride_tricks.as_strided(e, (len(x), places, wide * EMBED), (e.strides[0], EMBED * e.itemsize, e.itemsize))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.ascontiguousarray(self._rows(x))
        act = rows.reshape(-1, rows.shape[2]) @ self.p["conv"]
        act = act.reshape(len(x), -1, act.shape[1])
        return rows, act, act.max(axis=1) + self.p["bias"]

    def probabilities(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        out = np.zeros((len(x), len(self.languages)))
        for a in range(0, len(x), step):
            top = np.maximum(self.pooled(x[a : a + step])[2], 0)
            out[a : a + step] = _softmax(top @ self.p["out"] + self.p["out_bias"])
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross entropy; the gradient goes through the place of each maximum."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t, wide = 0, max(WIDTHS)
        steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                i = order[a : a + batch]
                rows, act, raw = self.pooled(x[i])
                top = np.maximum(raw, 0)
                error = _softmax(top @ self.p["out"] + self.p["out_bias"])
                error[np.arange(len(i)), y[i]] -= 1
                error /= len(i)
                back = (error @ self.p["out"].T) * (raw > 0)
                best = act.argmax(axis=1)
                picked = rows[np.arange(len(i))[:, None], best]  # (batch, filters, wide * EMBED)
                g = {"out": top.T @ error, "out_bias": error.sum(0), "bias": back.sum(0)}
                g["conv"] = np.einsum("bf,bfk->kf", back, picked) * self.mask
                down = back[:, :, None] * self.p["conv"].T[None]  # what reaches each embedded byte
                where = x[i][np.arange(len(i))[:, None, None], best[:, :, None] + np.arange(wide)]
                g["embed"] = np.zeros_like(self.p["embed"])
                np.add.at(g["embed"], where.reshape(-1), down.reshape(-1, EMBED))
                t += 1
                now = rate * (1 - t / (steps + 1))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def held_out():
    """Rows that are never learned from: crc32 of the doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, texts: int = TEXTS, per_text: int = WINDOWS, languages: int = LANGUAGES) -> Network | None:
    """A network for all languages that labelled rows have, from about ``texts`` texts of each (drawn by
    hash) and ``per_text`` windows of a text; of a language at most ``texts * per_text`` windows, first by
    hash, reach the driver, whatever the size of ``docs``. Null if no row is labelled; more than
    ``languages`` languages are an error."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    counts = cut(rows.groupBy("lang").count())
    if (n := counts.count()) > languages:
        raise ValueError(f"{n} languages, more than the {languages} that are learned: raise `languages` or clean `lang`")
    share = F.broadcast(counts.withColumn("share", F.least(F.lit(1.0), F.lit(float(texts)) / F.col("count"))))
    drawn = rows.join(share, "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * float(1 << 30)).select("lang", "text", "h")

    def cut_windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = letters(*utf8(batch.column("text")))
        x, of = windows(data, offsets)
        n, h = np.bincount(of, minlength=batch.num_rows), batch.column("h").to_numpy()
        first = np.cumsum(n) - n
        take = [np.random.default_rng(abs(int(k))).permutation(c)[:per_text] + f for k, c, f in zip(h, n, first, strict=True)]
        take = np.concatenate(take).astype(np.int64) if take else np.zeros(0, np.int64)
        return record(lang=batch.column("lang").take(pa.array(of[take])), h=h[of[take]], x=pa.array([w.tobytes() for w in x[take]], pa.binary()))

    sample = map_texts(drawn, cut_windows, "lang string, h long, x binary").dropDuplicates(["h", "x"])
    turn = Window.partitionBy("lang").orderBy("h", "x")  # about texts * per_text windows of a language
    got = sample.withColumn("r", F.row_number().over(turn)).filter(F.col("r") <= texts * per_text).toArrow().to_pydict()
    if not got["x"]:
        return None
    order = sorted(range(len(got["x"])), key=lambda i: (got["h"][i], got["x"][i], got["lang"][i]))
    names = sorted(set(got["lang"]))
    x = np.frombuffer(b"".join(got["x"][i] for i in order), np.uint8).reshape(-1, WINDOW)
    y = np.array([names.index(got["lang"][i]) for i in order])
    network = Network(names)
    network.fit(x, y)
    return network


def scored(texts: pa.Array, network: Network | None) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of a column."""
    raw, offsets = utf8(texts)
    letter = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122), out=letter[1:])
    known = letter[offsets[1:]] > letter[offsets[:-1]]
    for i in np.flatnonzero(~known & (np.diff(offsets) > 0)):
        known[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if network is None or not known.any():
        return names, score
    x, of = windows(*letters(raw, offsets))
    mean = np.zeros((len(texts), len(network.languages)))
    runs = np.flatnonzero(np.diff(of, prepend=-1))
    mean[of[runs]] = np.add.reduceat(network.probabilities(x), runs, axis=0)
    mean /= np.maximum(np.bincount(of, minlength=len(texts)), 1)[:, None]
    best = mean.argmax(axis=1)
    names[known] = np.array(network.languages, object)[best[known]]
    score[known] = np.round(mean[np.arange(len(best)), best], 6)[known]
    return names, score


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred`` and ``score``, the mean over
    all windows of the text of the chosen language's probability.

    A null text, and one without any letter, is ``und`` with score 0; so is every text if nothing was
    learned. Texts of any length are read whole. Only text is an input of a prediction."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score = scored(batch.column("text"), network)
        return record(doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=pa.array(names, pa.string()), score=score)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return map_texts(rows, work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, network: Network | None, least: float) -> DataFrame:
    """``docs`` without texts that are ``und`` or whose language scores below ``least``; all columns,
    in one pass over the table."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                names, score = scored(piece.column("text").cast(pa.string()), network)
                yield piece.filter(pa.array((names != UNKNOWN) & (score >= least)))
        give_back()

    return docs.mapInArrow(run, docs.schema)
