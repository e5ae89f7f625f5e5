"""What a Python worker holds: bytes that stay or peak, by tracemalloc."""

import tracemalloc

import public_tokenizers
import pyarrow as pa

from holdfast.llm import token_files
from holdfast.llm.common import steps


def test_known_pre_tokens_are_held_in_arrays():
    own = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    # words of letters only, as digits are pre-tokens of their own
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(60_000)]
    texts = [" ".join(words[k : k + 10_000]).encode() for k in range(0, 60_000, 10_000)]
    own.encode(texts[:1])
    tracemalloc.start()
    try:
        first = own.encode(texts)
        del first
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(own.size) >= 59_000
    assert held < 120 * len(own.size)


def test_pre_tokens_are_forgotten_and_learned_anew(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [b"one two three", b"four five's  six\n", b"one seven two", b"", b"eight ninety-nine one"]
    whole = token_files.Encoder(path)
    wanted = [whole.whole(t).tolist() for t in texts]
    monkeypatch.setattr(token_files, "_KNOWN", 7)
    monkeypatch.setattr(token_files, "_AT_ONCE", 2)
    own = token_files.Encoder(path)
    for _ in range(2):
        assert [own.encode([t])[0].tolist() for t in texts] == wanted
    assert [x.tolist() for x in own.encode(texts)] == wanted


def test_steps_hold_the_texts_of_one_slice_only():
    texts = [None, b"", *[bytes([65 + k]) * 1_000_000 for k in range(24)], b"z"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(range(len(texts)))], names=["text", "n"])
    tracemalloc.start()
    try:
        met = [(t[:1], len(t), n) for part, own in steps([batch]) for t, n in zip(own, part.column("n").to_pylist(), strict=True)]
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert met == [((t or b"")[:1], len(t or b""), n) for n, t in enumerate(texts)]
    assert most < 8_000_000
