import public_tokenizers
import pytest
from tokenizers import Tokenizer

import numpy as np

from holdfast.llm import super_kmers, token_files, words
from tests.llm.frames import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_words_apart():
    a, b = thue_morse(2048)
    texts = [f"{a} {b} a a\0 \0 {'x' * 16} {'x' * 17} {'x' * 18}".encode()]
    hashes = words.word_hashes(words.split_words(texts, words.SPACES))
    assert len(set(hashes.tolist())) == 8


def test_differing_compares_bytes():
    split = words.split_words([b"one one two " + b"q" * 30 + b" " + b"q" * 29 + b"r " + b"z" * 5000 + b" " + b"z" * 5000 + b" " + b"z" * 4999 + b"y"], words.SPACES)
    lead = np.array([0, 0, 0, 3, 3, 5, 5, 5])
    assert words.differing(split, words.packed(split), lead).tolist() == [False, False, True, False, True, False, False, True]


@pytest.mark.parametrize("room", [None, 50])
def test_ids_equal_the_library_even_where_hashes_collide(monkeypatch, room):
    if room:
        real = words.word_hashes
        monkeypatch.setattr(token_files, "word_hashes", lambda w, spelled=None: real(w, spelled) % np.uint64(room))
    a, b = thue_morse(2048)
    texts = [(t or "")[:3000] for _, t, *_ in documents()] + [a, b, f"{a} {b}"]
    own, library = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    got = own.encode([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_windows_of_words_that_a_polynomial_confuses(spark):
    a, b = thue_morse(2048)
    rows = [(1, " ".join([a] * 13)), (2, " ".join([b] * 13)), (3, " ".join([a] * 13))]
    out = super_kmers.digest(super_kmers.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted((r.doc_id, r.n_removed) for r in out.collect()) == [(1, 0), (2, 0), (3, 13)]
