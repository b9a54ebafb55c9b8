"""What a worker of the tokeniser holds is bounded, whatever the texts."""

import numpy as np
import pyarrow as pa

from finlake.llm import bpe
from finlake.llm.common import pieces


def test_held_words_stay_few_and_change_nothing():
    texts = [" ".join(f"{i:x}q{k}" for k in range(20_000)) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    codec, held, got = bpe.WordCodec(bpe.tokenizer_file()), 0, []
    for piece in pieces(batch, "text", getattr(bpe, "PIECE", 4 << 20)):
        got += codec.written(piece.column("text").to_pylist())
        held = max(held, len(codec.words))
    assert held < 420_000
    alone = bpe.WordCodec(bpe.tokenizer_file())
    assert len(got) == len(texts) and got[0] == alone.written(texts[:1])[0] and got[-1] == alone.written(texts[-1:])[0]


def test_words_met_again_are_encoded_once():
    """Words that come back in later pieces stay held beside the many that do not, whatever their capitals and signs."""
    codec, met = bpe.WordCodec(bpe.tokenizer_file()), []
    codec.words.most = codec.parts.most = 40
    whole = codec.automaton.encode_all
    codec.automaton.encode_all = lambda words: met.extend(words) or whole(words)
    often = ["alpha", "Alpha,", "ALPHA!!", "beta's", "beta"]
    pieces = [" ".join(often + [f"{'abcdefghij'[i]}zq{'klmnopqrstuvwxyz'[k]}" for k in range(16)]) for i in range(10)]
    got = [codec.written([p])[0] for p in pieces]
    assert {w: met.count(w) for w in (b"alpha", b"beta", b"'s")} == {b"alpha": 1, b"beta": 1, b"'s": 1}
    assert len(codec.words) <= 40 + 2 * 21 and len(codec.parts) <= 40 + 2 * 21
    assert got == [bpe.WordCodec(bpe.tokenizer_file()).written([p])[0] for p in pieces[:1]] + [codec.written([p])[0] for p in pieces[1:]]


def test_few_arcs_are_followed_like_many():
    a = bpe.WordCodec(bpe.tokenizer_file()).automaton
    at, label = [k % len(a.parent) for k in range(0, 4000, 7)], [k * 31 % len(a.label) for k in range(0, 4000, 7)]
    want = [a.has_arc(s, v) for s, v in zip(at, label, strict=True)]
    assert a.has_arcs(np.array(at), np.array(label)).tolist() == want and len(set(want)) == 2
    assert [bool(a.has_arcs(np.array([s]), np.array([v]))[0]) for s, v in zip(at[:50], label[:50], strict=True)] == want[:50]
