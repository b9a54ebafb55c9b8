"""BPE encoding and decoding with a deterministic automaton over tokens.

The automaton starts with one state and a loop for each base symbol, which accepts every way to write
a string as symbols. Each merge ``u v -> w``, in order of rank, puts a gadget in: an arc ``w`` goes
wherever the path ``u v`` went, and ``v`` is cut behind ``u``. All arcs with one label lead to one
state, so the gadget splits at most one state off. After the last merge exactly the BPE encodings are
accepted. A split state keeps a link to the state it was copied from and its own cuts, so the whole
automaton takes memory in proportion to the number of merges, and single arcs are worked out when they
are first used and then kept in a transition table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, record

#: Text encoded at once, encoded words that a worker keeps beyond it, slots of its arc table (a power of two),
#: the longest word in bytes that goes through the table with others (longer ones go alone), and the fewest
#: arcs worked out together. A worker's memory follows the first two.
PIECE = 3 << 19
WORDS_HELD = 100_000
ARC_BITS = 20
TOGETHER = 48
FEW = 24
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stays, the others follow
    from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return [names[b] for b in range(256)]


class Automaton:
    """States, arcs and labels compiled from merges. ``vocab`` maps a label to its id."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.label = [""] * (max(vocab.values(), default=-1) + 1)
        for name, i in vocab.items():
            self.label[i] = name
        n = len(self.label)
        self.target = [0] * n  # the state that arcs with this label lead to; -1: no such arcs
        self.left = [-1] * n  # first part of a merged label
        self.made = [-1] * n  # rank of the merge that made the label
        self.parent, self.split = [-1], [-1]  # of each state: what it was copied from, and when
        self.cuts: dict[tuple[int, int], int] = {}
        merged = {a + b for a, b in merges}
        self.base = {name: i for name, i in vocab.items() if name not in merged}
        for name, i in vocab.items():
            if name in merged:
                self.target[i] = -1
        users = {0: len(self.base) + 1}  # labels that lead to a state; the start counts for state 0
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b], users)
        self.made_at, self.left_of, self.leads = (np.array(x, np.int64) for x in (self.made, self.left, self.target))
        self.copied, self.split_at = np.array(self.parent, np.int64), np.array(self.split, np.int64)
        cut = sorted((state << 20 | v, rank) for (state, v), rank in self.cuts.items())
        self.cut_key, self.cut_at = (np.array(x, np.int64) for x in zip(*cut, strict=True)) if cut else (np.zeros(0, np.int64),) * 2
        self.arc_key = np.full(1 << ARC_BITS, -1, np.int64)
        self.arc_there = np.zeros(1 << ARC_BITS, bool)
        self._spell()

    def _gadget(self, rank: int, u: int, v: int, w: int, users: dict[int, int]) -> None:
        after_u = self.target[u]
        if after_u < 0 or self.target[v] < 0 or self.target[w] >= 0 or not self.has_arc(after_u, v):
            return  # the path u v does not occur
        narrowed = after_u
        if users[after_u] > 1 or u == v:
            narrowed = len(self.parent)
            self.parent.append(after_u)
            self.split.append(rank)
            users[after_u] -= 1
            users[narrowed] = 1
            self.target[u] = narrowed
        self.target[w] = after_u if u == v else self.target[v]
        users[self.target[w]] += 1
        self.left[w], self.made[w] = u, rank
        self.cuts[narrowed, v] = rank

    def has_arc(self, state: int, label: int, now: int = NEVER) -> bool:
        """Whether an arc leaves ``state`` before merge ``now``: follow the state back to what it was copied
        from, and the label back to its first part, to the cuts made before."""
        cuts = self.cuts
        while True:
            if cuts.get((state, label), now) < now:
                return False
            made = self.made[label]
            if made < self.split[state]:
                now, state = min(now, self.split[state]), self.parent[state]
            elif made < 0:
                return True
            else:
                now, label = made + 1, self.left[label]

    def has_arcs(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The same for many arcs at once; the few that go on longest are followed one by one."""
        there = np.zeros(len(state), bool)
        at, now = np.arange(len(state)), np.full(len(state), NEVER)
        while len(at) > FEW:
            key = state << 20 | label
            place = np.minimum(np.searchsorted(self.cut_key, key), len(self.cut_key) - 1)
            whole = (self.cut_at[place] >= now) | (self.cut_key[place] != key) if len(self.cut_key) else np.ones(len(at), bool)
            made, split = self.made_at[label], self.split_at[state]
            up = made < split
            there[at[whole & ~up & (made < 0)]] = True
            go = whole & (up | (made >= 0))
            at, up, made, split, state, label, now = at[go], up[go], made[go], split[go], state[go], label[go], now[go]
            now = np.where(up, np.minimum(now, split), made + 1)
            state, label = np.where(up, self.copied[state], state), np.where(up, label, self.left_of[label])
        for k, *arc in zip(at.tolist(), state.tolist(), label.tolist(), now.tolist(), strict=True):
            there[k] = self.has_arc(*arc)
        return there

    def arcs(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """``has_arcs`` through the transition table."""
        key = state << 20 | label
        slot = (key * np.int64(0x5851F42D4C957F2D)).view(np.uint64) >> np.uint64(64 - ARC_BITS)
        there = self.arc_there[slot]
        missed = np.flatnonzero(self.arc_key[slot] != key)
        if len(missed):
            new, first, back = np.unique(key[missed], return_index=True, return_inverse=True)
            found = self.has_arcs(new >> 20, new & ((1 << 20) - 1))
            there[missed] = found[back]
            at = slot[missed[first]]
            self.arc_key[at] = new
            kept = self.arc_key[at] == new  # one of several that share a slot
            self.arc_there[at[kept]] = found[kept]
        return there

    def _spell(self) -> None:
        """The tree of bytes that proposes labels, as tables: next node, label of a node, and label if
        the byte ends the word."""
        byte = {c: b for b, c in enumerate(byte_symbols())}
        kids: list[dict[int, int]] = [{}]
        ends: list[dict[int, int]] = [{}]
        label = [-1]
        self.width = np.zeros(len(self.label), np.int64)
        for i, name in enumerate(self.label):
            if not name or self.target[i] < 0:
                continue
            body = name[: -len(END)] if name.endswith(END) and len(name) > len(END) else name
            raw = [byte[c] for c in body]
            self.width[i] = len(raw)
            node, last = 0, raw[-1] if body != name else None
            for b in raw[: len(raw) - (last is not None)]:
                if b not in kids[node]:
                    kids[node][b] = len(kids)
                    kids.append({})
                    ends.append({})
                    label.append(-1)
                node = kids[node][b]
            if last is None:
                label[node] = i
            else:
                ends[node][last] = i
        self.kids, self.ends, self.node_label = kids, ends, np.array(label, np.int32)

        def table(rows: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
            full = [k for k, row in enumerate(rows) if row]
            row_of = np.zeros(len(rows), np.int32)
            row_of[full] = np.arange(1, len(full) + 1)
            cells = np.full((len(full) + 1, 256), -1, np.int32)
            for k, row in enumerate(full, 1):
                cells[k, list(rows[row])] = list(rows[row].values())
            return row_of, cells

        self.kid_row, self.kid = table(kids)
        self.end_row, self.end = table(ends)

    def encode_all(self, words: list[bytes]) -> list[list[int]]:
        """Label ids of each (not empty) word.

        Every prefix of a word has one accepted path, whose state is kept at the place where it ends.
        From all words' place i at once, the tree proposes the labels that match there, and those
        with an arc carry the state on."""
        out: list[list[int]] = [[]] * len(words)
        together = []
        for k, w in enumerate(words):
            if len(w) > TOGETHER:
                out[k] = self.encode_long(w)
            else:
                together.append(k)
        if not together:
            return out
        together.sort(key=lambda k: -len(words[k]))
        length = np.array([len(words[k]) for k in together])
        data = np.frombuffer(b"".join([words[k] for k in together]), np.uint8)
        first = np.cumsum(length) - length
        base = first + np.arange(len(length))  # place 0 of each word: there is one place more than bytes
        state = np.full(len(data) + len(length), -1, np.int64)
        came = np.full(len(state), -1, np.int64)
        state[base] = 0
        for i in range(length[0]):
            n = int(np.searchsorted(-length, -i, side="left"))  # words with more than i bytes
            word, node = np.arange(n), np.zeros(n, np.int32)
            have = state[base[:n] + i]
            for step in range(1, int(length[0]) - i + 1):
                b = data[first[word] + i + step - 1]
                last = length[word] == i + step
                if last.any():
                    self._advance(word[last], self.end[self.end_row[node[last]], b[last]], have, base, i + step, state, came)
                node = self.kid[self.kid_row[node], b]
                go = (node >= 0) & ~last
                word, node = word[go], node[go]
                if not len(word):
                    break
                self._advance(word, self.node_label[node], have, base, i + step, state, came)
        # back from the ends
        place, word, parts = length.copy(), np.arange(len(length)), []
        while len(word):
            label = came[base[word] + place[word]]
            if (label < 0).any():
                raise ValueError("bytes outside the alphabet")
            parts.append((word, label))
            place[word] -= self.width[label]
            word = word[place[word] > 0]
        at, label = (np.concatenate(x) for x in zip(*reversed(parts), strict=True))
        order = np.argsort(at, kind="stable")
        label, stops = label[order].tolist(), np.cumsum(np.bincount(at, minlength=len(length))).tolist()
        begin = 0
        for k, stop in zip(together, stops, strict=True):
            out[k] = label[begin:stop]
            begin = stop
        return out

    def _advance(self, word, label, have, base, place, state, came) -> None:
        some = np.flatnonzero(label >= 0)
        word, label = word[some], label[some].astype(np.int64)
        ok = self.arcs(have[word], label)
        at = base[word[ok]] + place
        state[at], came[at] = self.leads[label[ok]], label[ok]

    def encode_long(self, word: bytes) -> list[int]:
        """One word of any length: longest label first, going back where no arc fits. At most one path
        reaches each place, so a place that was left again is never tried twice."""
        n, dead, known = len(word), bytearray(len(word) + 1), {}
        path, steps, place, state = [], [], 0, 0
        options = self._options(word, 0)
        while place < n:
            while options:
                stop, label = options.pop()
                if dead[stop]:
                    continue
                there = known.get((state, label))
                if there is None:
                    if len(known) > WORDS_HELD:
                        known.clear()
                    there = known[state, label] = self.has_arc(state, label)
                if there:
                    steps.append((place, state, options))
                    path.append(label)
                    place, state = stop, self.target[label]
                    options = self._options(word, place) if place < n else []
                    break
            else:
                dead[place] = 1
                if not steps:
                    raise ValueError("bytes outside the alphabet")
                place, state, options = steps.pop()
                path.pop()
        return path

    def _options(self, word: bytes, place: int) -> list[tuple[int, int]]:
        """Labels that match from ``place`` on, the longest last."""
        node, found = 0, []
        for stop in range(place, len(word)):
            if stop == len(word) - 1 and word[stop] in self.ends[node]:
                found.append((stop + 1, self.ends[node][word[stop]]))
            node = self.kids[node].get(word[stop])
            if node is None or stop == len(word) - 1:
                break
            if self.node_label[node] >= 0:
                found.append((stop + 1, int(self.node_label[node])))
        return found

    def decode(self, ids) -> str:
        """The labels on the path, as the library joins them without a decoder."""
        label = self.label
        return " ".join([label[i] for i in ids])


END = "</w>"


class Held:
    """For words the ids as text and the decoded text. At most ``most`` words beside those of the last look: first
    those go that were looked for only once."""

    def __init__(self, most: int):
        self.most, self.ids, self.decoded, self.once = most, {}, {}, set()

    def __len__(self) -> int:
        return len(self.ids)

    def missing(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that are not held, for the caller to put in."""
        if len(self) > self.most:
            often = [] if 4 * (len(self) - len(self.once)) > 3 * self.most else [k for k in self.ids if k not in self.once]
            self.ids, self.decoded, self.once = {k: self.ids[k] for k in often}, {k: self.decoded[k] for k in often}, set()
        self.once -= keys
        new = [k for k in keys if k not in self.ids]
        self.once.update(new)
        return new

    def put(self, key: str, ids: str, decoded: str) -> None:
        self.ids[key], self.decoded[key] = ids, decoded


class WordCodec:
    """A tokenizer file of the kind "lower case, byte symbols, word-end mark", as an automaton."""

    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+|\n")
    #: Separators for str.split() that are no white space for the pattern.
    ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = Automaton(model["vocab"], merges)
        label = self.automaton.label
        for name, i in self.special.items():
            label.extend([""] * (i + 1 - len(label)))
            label[i] = name
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.number = [str(i) for i in range(len(label))]
        # of runs without white space, and of the words in them
        self.words, self.parts = Held(WORDS_HELD), Held(WORDS_HELD)

    def _prepare(self, chunks: set[str]) -> None:
        """Encode the runs without white space that are not held yet. Many runs are one word with other
        capitals or signs beside it, so that the words are held as well."""
        new = self.words.missing(chunks)
        # one pass over all of them; no run contains the line end that stands between them
        text = unicodedata.normalize("NFC", "\n".join(new)).replace("\u03a3", "\u03c3").lower()
        pieces = self.SPLIT.findall(text)
        pieces.append("\n")
        number, label, held, known, own = self.number, self.automaton.label, self.words, self.parts, []
        distinct = known.missing(set(pieces) - {"\n"})
        for p, ids in zip(distinct, self.automaton.encode_all([p.encode() for p in distinct]), strict=True):
            known.put(p, " ".join([number[i] for i in ids]), " ".join([label[i] for i in ids]))
        chunk = iter(new)
        for p in pieces:
            if p != "\n":
                own.append(p)
            elif new:
                held.put(next(chunk), " ".join([known.ids[o] for o in own]), " ".join([known.decoded[o] for o in own]))
                own = []

    def _runs(self, text: str) -> list[str]:
        """Runs without white space and special tokens, in order."""
        if self.cut_special is not None and "<|" in text:
            return [r for part in self.cut_special.split(text) for r in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return self.SPLIT_ODD.findall(text) if self.ODD.search(text) else text.split()

    def _all(self, texts: list[str]) -> list[list[str]]:
        """The runs of each text; ``words`` holds all of them then."""
        runs = [self._runs(t) for t in texts]
        self._prepare(set().union(*runs))
        for name, i in self.special.items():
            self.words.put(name, str(i), name)
        return runs

    SPLIT_ODD = regex.compile(r"\P{White_Space}+")

    def encode(self, texts: list[str]) -> list[list[int]]:
        runs, ids = self._all(texts), self.words.ids
        return [[int(i) for run in own for i in ids[run].split()] for own in runs]

    def decode(self, ids) -> str:
        return self.automaton.decode(ids)

    def written(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of tokens, the decimal ids joined by one blank, and the decoded text."""
        out, runs = [], self._all(texts)
        ids_of, decoded_of = self.words.ids.__getitem__, self.words.decoded.__getitem__
        for own in runs:
            ids = " ".join(filter(None, map(ids_of, own)))
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join(filter(None, map(decoded_of, own)))))
        return out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_CODECS: dict[str, WordCodec] = {}


def codec(spec: str) -> WordCodec:
    """The codec of a tokenizer file's content, compiled once in each worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = WordCodec(spec)
    return _CODECS[key]


def tokenizer_file(path: str | None = None) -> str:
    """Content of a tokenizer file (read by the driver, at most a few MB); by default the public
    49,000-token word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


#: What ``encode`` can return besides doc_id and n_tokens.
OUTPUTS = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_tokens`` and the wanted ones of ``ids`` (array of int),
    ``decoded`` (text), and their SHA-256 in hex, ``ids_sha256`` (of the decimal ids joined by one blank)
    and ``decoded_sha256``.

    Null and blank texts have no tokens, an empty id list and an empty decoded text. Words of any
    length are encoded whole. Other columns are not looked at; an empty table gives an empty table."""
    spec = tokenizer_file(path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, decoded = zip(*codec(spec).written([t or "" for t in batch.column("text").to_pylist()]), strict=True)
        make = {
            "ids": lambda: pa.array([np.array(i.split(), np.int32) for i in ids], pa.list_(pa.int32())),
            "decoded": lambda: pa.array(decoded, pa.string()),
            "ids_sha256": lambda: pa.array(map(_sha, ids), pa.string()),
            "decoded_sha256": lambda: pa.array(map(_sha, decoded), pa.string()),
        }
        return record(doc_id=batch.column("doc_id"), n_tokens=pa.array(n, pa.int64()), **{c: make[c]() for c in outputs})

    rest = "".join(f", {c} {OUTPUTS[c]}" for c in outputs)
    return map_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")), work, f"doc_id {kind}, n_tokens long{rest}", most=PIECE)
