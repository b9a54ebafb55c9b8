"""License scans: phrases that stand word by word, and an exact set-similarity join of text blocks with
license templates. Template words are ordered by how rare they are in the whole corpus; a block can hold
the needed share of a template only if it has one of the template's first (rarest) words, and the places
of that word in both orders bound what can still be shared. What is left is verified exactly."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_texts, record, utf8, word_bounds, word_hashes

# What separates words, phrases with their labels, and license notices in their usual words.
_OTHER = np.zeros(256, bool)
_OTHER[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)
#: Share of a template's distinct words that a block must hold.
CONTAINED = 0.8
#: A block is a line; longer lines, and whole texts where blocks go ``across`` line ends, are blocks of this
#: many words, each begun half-way through the one before. For templates of more than half as many words
#: blocks are twice, four times, ... as long, so that some block holds any stretch of a template's length.
BLOCK_WORDS = 64


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = utf8(pa.array(words, pa.string()))
    return word_hashes(data, offsets[:-1], offsets[1:])


class Vocabulary:
    """A bounded word list, found in arrays of word hashes through a slot table without collisions."""

    def __init__(self, words: list[str]):
        self.words = words
        self.hash = _hashes(words)
        bits = 12
        while len(np.unique(self.hash >> np.uint64(64 - bits))) < len(words):
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.slot[self.hash >> self.shift] = np.arange(len(words))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word in the list, or -1."""
        at = self.slot[hashes >> self.shift]
        return np.where((at >= 0) & (self.hash[at] == hashes), at, -1)


def _words(texts: pa.Array):
    """Bytes, and for all lower-cased words their starts, ends, hashes, and how many come before each text."""
    data, offsets = utf8(texts)
    data = LOWER[data]
    starts, ends, before = word_bounds(data, offsets, _OTHER)
    return data, offsets, starts, ends, word_hashes(data, starts, ends), before


def word_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of a bounded list of words stands in all texts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = vocabulary.find(_words(batch.column("text"))[4])
        n = np.bincount(found[found >= 0], minlength=len(words))
        some = np.flatnonzero(n)
        return record(w=some.astype(np.int32), n=n[some].astype(np.int64))

    vocabulary = Vocabulary(words)
    rows = map_texts(docs.select(F.col("text").cast("string").alias("text")), work, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in words} | {words[r["w"]]: r["n"] for r in rows}


class Join:
    """Templates prepared for the join, under one global word order."""

    def __init__(self, templates, counts: dict[str, int], contained: float):
        order = sorted(counts, key=lambda w: (counts[w], w))
        rank = {w: i for i, w in enumerate(order)}
        self.vocabulary = Vocabulary(order)
        #: For each length of blocks the first words of its templates, with template and place.
        self.templates, self.by_prefix = [], {}
        for k, (label, text) in enumerate(templates):
            words = text.split()
            own = sorted({rank[w] for w in words})
            need = max(1, ceil(contained * len(own) - 1e-9))
            self.templates.append((label, own, need, set(own)))
            length = BLOCK_WORDS
            while length < 2 * len(words):
                length *= 2
            for place in range(len(own) - need + 1 if own else 0):
                self.by_prefix.setdefault(length, {}).setdefault(own[place], []).append((k, place))
        self.prefix = {length: np.zeros(len(order) + 1, bool) for length in self.by_prefix}  # the last entry serves words that are in no template
        for length, first in self.by_prefix.items():
            self.prefix[length][list(first)] = True

    def matches(self, block: list[int], size: int, length: int) -> list[tuple[int, float]]:
        """Templates of blocks of this ``length`` that a block (ranks of its template words; ``size`` distinct
        words in all) holds to the needed share."""
        own = sorted(set(block))
        have, seen, out = set(own), set(), []
        for place, w in enumerate(own):
            for k, at in self.by_prefix[length].get(w, ()):
                if k in seen:
                    continue
                label, words, need, whole = self.templates[k]
                seen.add(k)
                if size < need or min(len(words) - at, len(own) - place) < need:  # length, position
                    continue
                shared = len(have & whole)
                if shared >= need:
                    out.append((k, shared / len(words)))
        return out


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, contained: float = CONTAINED, across: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, ``base`` (an array of label and start word for each
    place of a phrase) and ``blocks`` (label, first word, last word and contained share for each block
    that holds a template). With ``across`` windows of words over the whole text are blocks too, so that a
    notice that is wrapped over several lines is found.

    Null texts and texts without words have no places; words are counted from 0 in the whole text;
    repeated rows give the same. Of equal texts each is scanned."""
    counts = word_counts(docs, sorted({w for _, text in templates for w in text.split()}))
    join = Join(templates, counts, contained)
    wanted = [(_hashes(p.split()), label) for p, label in phrases]
    kind = docs.schema["doc_id"].dataType.simpleString()
    base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    block_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets, starts, ends, hashes, before = _words(batch.column("text"))
        n, total = batch.num_rows, len(hashes)
        doc = np.repeat(np.arange(n), np.diff(before))
        base: list[list[dict]] = [[] for _ in range(n)]
        for phrase, label in wanted:
            k = len(phrase)
            if total < k:
                continue
            hit = np.ones(total - k + 1, bool)
            for j in range(k):
                hit &= hashes[j : total - k + 1 + j] == phrase[j]
            for w in np.flatnonzero(hit & (doc[: total - k + 1] == doc[k - 1 :])).tolist():
                base[doc[w]].append({"label": label, "start": w - int(before[doc[w]])})
        blocks: list[list[dict]] = [[] for _ in range(n)]
        ranks = join.vocabulary.find(hashes)
        # lines: a word's line is told by the line ends before it and by its text
        line = np.searchsorted(np.flatnonzero(data == 10), starts)
        edge = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        for length, prefix in join.prefix.items():
            half, hits = length // 2, np.flatnonzero(prefix[ranks])
            spans = set()
            for e in np.unique(np.searchsorted(edge, hits, side="right") - 1).tolist():
                a, b = int(edge[e]), int(edge[e + 1]) if e + 1 < len(edge) else total
                spans.update((at, min(at + length, b)) for at in range(a, max(b - half, a + 1), half))
            if across and len(hits):  # a window holds a template's first word, and each word stands in two at most
                first = before[doc[hits]]
                last = (hits - first) // half
                for k in (last, last - 1):
                    at, end = first + k * half, before[doc[hits] + 1]
                    spans.update(zip(at[k >= 0].tolist(), np.minimum(at + length, end)[k >= 0].tolist(), strict=True))
            for at, stop in sorted(spans):
                own = ranks[at:stop]
                for k, share in join.matches(own[own >= 0].tolist(), len(np.unique(hashes[at:stop])), length):
                    first = int(before[doc[at]])
                    blocks[doc[at]].append({"label": join.templates[k][0], "first": at - first, "last": stop - 1 - first, "share": share})
        return record(doc_id=batch.column("doc_id"), n_words=np.diff(before).astype(np.int64), base=pa.array(base, base_type), blocks=pa.array(blocks, block_type))

    schema = f"doc_id {kind}, n_words long, base array<struct<label:string,start:long>>, blocks array<struct<label:string,first:long,last:long,share:double>>"
    return map_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")), work, schema)


def summary(found: DataFrame) -> DataFrame:
    """Labels and counts of ``scan``. ``score`` is 1 where a phrase stands, otherwise the largest share
    of a template that a block holds, or 0."""

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    starts = F.col("base")["start"]
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("base")["label"]).alias("base_labels"),
        joined(F.concat(F.col("base")["label"], F.col("blocks")["label"])).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("blocks")["share"]), F.lit(0.0))).alias("score"),
    )
