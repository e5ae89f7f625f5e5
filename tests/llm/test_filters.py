import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.llm import pii, token_counts, token_files, toxicity, url_filter
from holdfast.llm.url_filter import Rule
from tests.llm.frames import SCHEMA, documents, prose

public_tokenizers = pytest.importorskip("public_tokenizers")

RULES = [Rule("allow", "net", "/"), Rule("block", "a.net", "/x"), Rule("block", "b.net", ""), Rule("allow", "com", "/ok/")]
URLS = [
    None, "", "no scheme", "http://", "http://A.net/x/1?q", "https://z.a.net/y", "http://b.net", "http://b.net#f", "http://xb.net/", "ftp://q.com/ok/1", "http://q.com/okay",
    "http://q.com/ok/?u=http://a.net/x", "http://spam.org/1", "http://SPAM.org/2", "http://ham.org/1", "http://ham.org/1",
]


def judged(url):
    m = re.search("://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate(str.maketrans(url_filter._CAPITALS, url_filter._SMALL)), m[2]) if m else ("", "")
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fit, key=lambda r: (-len(r.text), r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "block" if "spam" in host else "allow"


def test_urls_equal_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, key string")
    out = url_filter.judge_urls(pages, RULES, F.col("host").contains("spam"))
    assert set(out.columns) == {"page_id", "url", "key", "host", "path", "rule", "verdict"}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == {k: judged(u) for k, u in enumerate(URLS)}


@pytest.mark.parametrize("segment_keys", [10**6, 150])
def test_cascade_is_exact_on_its_universe(spark, segment_keys):
    rng = random.Random(5)
    rows = [(f"k{i}", rng.random() < 0.2) for i in range(1500)] + [(None, True), ("", True), ("k3", True)]
    universe = spark.createDataFrame(rows, "key string, listed boolean")
    pages = spark.createDataFrame([(r[0],) for r in rows] * 2, "key string")
    out = url_filter.mark_listed(pages, "key", universe, "listed", segment_keys=segment_keys).collect()
    listed = {k for k, on in rows if on and k is not None}
    assert len(out) == 2 * len(rows) and all(r.listed == (r.key in listed) for r in out)


def test_cascade_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, listed boolean")
    pages = spark.createDataFrame([("a",)], "key string")
    assert url_filter.mark_listed(pages, "key", empty, "listed").collect()[0].listed is False
    assert url_filter.mark_listed(pages, "key", spark.createDataFrame([("a", False)], "key string, listed boolean"), "listed").collect()[0].listed is False


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    found = []
    for no, (pattern, ok) in enumerate(PII.values()):
        found += [(m.start(), no, m.end()) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return sorted(found)


TEXTS = [
    None, "", "mail a.b@c.de, x@y, q@w.e_r@t.u.v and 1.2.3.4.5.6.7.8 or 256.1.1.1 001.002.003.0004", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 12",
    "é\U0001f600 +1 (243) 555-5526. +49 1 +1234567890123456 ++12 34 56 78 90-1", "a@b.c" * 50, "1 " * 3000 + "9" * 5000, "x" * 50_000 + "@a.b", "." .join("1" * 3000), "a.b" * 9000 + "@q" + ".z" * 5000,
    "12@12.12.12.12 4111 1111 1111 1111@x.y +1.2.3.4 5 6 7 8 9 0 1 2", "@@ + 4", "7" * 300 + ".1.1.1 " + "0" * 400 + "9.1.1.1",
]


def test_base_spans_equal_brute_force(spark):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS + [TEXTS[2]])] + [(None, TEXTS[2], 1), (None, None, 1), (2, TEXTS[2], 1)]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, row long")).collect()
    got = sorted(((r.doc_id, [tuple(s) for s in r.base]) for r in out), key=str)
    assert got == sorted(((d, base_spans(t)) for d, t, _ in rows), key=str)
    assert all(set(r.base) <= set(r.spans) for r in out)
    shown = pii.digest(spark.createDataFrame(out, "doc_id long, base array<struct<start: long, no: int, end: long>>, spans array<struct<start: long, no: int, end: long>>"))
    assert shown.filter("doc_id = 3").collect()[0].spans == "card:0:19"


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(3)
    rows = [(k, f"{prose(k, 6)} please write to u{k}@host{k}.org {prose(k + 50, 4)}") for k in range(30)]
    rows += [(100, "now please write to bob(at)host7.org7712 soon"), (101, "see 12345678 there"), (102, f"{prose(1, 3)} please write to 99881-x77")]
    rows += [(200 + k, f"total of {rng.randrange(10**6, 10**7)} units") for k in range(20)]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in out[100].spans] == [(20, 0, 40)] and not out[100].base
    assert len(out[102].spans) == 1 and not out[101].spans and not any(out[200 + k].spans for k in range(20))


def test_pii_of_nothing(spark):
    assert pii.digest(pii.find_pii(spark.createDataFrame([], SCHEMA))).collect() == []


def test_token_files_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(d, t) for d, t, *_ in documents() if d != 12 or len(t) < 1000]
    rows += [(k, t) for k, t in enumerate(["a  b   c \n\n d", "don't  can't 've", "x　y \x1c z\x85", "漢字 teßt", "<|endoftext|> q", "1234 $$$ ''s  ", "͸x ", " "], 50)]
    out = token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).collect()
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    want = sorted((d if d is not None else -1, len(ids(t)), token_files.crc(b"".join(i.to_bytes(4, "little") for i in ids(t)))) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    in_order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(out, key=lambda r: r.start)]
    assert in_order == sorted(in_order)


def test_token_files_of_nothing(spark):
    assert token_files.round_trip(spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_codes_of_every_length():
    import numpy as np

    ranks = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], dtype=np.uint32)
    for counts in ([9], [0, 9], [1, 0, 5, 3], [4, 4, 1, 0], []):
        counts = np.array(counts, dtype=np.int64)
        own = ranks[: counts.sum()]
        control, room, data, edge = token_files.pack(own, counts)
        assert np.diff(room).tolist() == (-(-counts // 4)).tolist() and len(edge) == len(counts) + 1 and edge[-1] == len(data)
        assert token_files.unpack(control, data, counts).tolist() == own.tolist()


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text(alphabet="ab d'stmrevl1²ªñ!-\n\r\t ", max_size=14), min_size=1, max_size=5))
def test_pre_tokens_equal_the_tokenizer(texts):
    own = token_files.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in own.encode([t.encode() for t in texts])] == want


def best_segmentation(token, pieces, byte):
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        n = len(token[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, -(best[end - 1][1] + n))]
        options += [(best[b][0] + pieces[token[b:end]], -(best[b][1] + 1)) for b in range(end) if token[b:end] in pieces]
        score, used = max(options)
        best.append((score, -used))
    return best[-1]


def near_segmentation(token, pieces, byte):
    """As best_segmentation, looking back no further than the longest piece."""
    longest = max(map(len, pieces))
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        n = len(token[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, -(best[end - 1][1] + n))]
        options += [(best[b][0] + pieces[token[b:end]], -(best[b][1] + 1)) for b in range(max(0, end - longest), end) if token[b:end] in pieces]
        score, used = max(options)
        best.append((score, -used))
    return best[-1]


def test_long_words_take_linear_memory(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.read_pieces(path)
    byte = min(pieces.values()) + math.log(token_counts.BYTE)
    rng = random.Random(5)
    word = "".join(rng.choice(["the", "re", "ing", "/", "9", "Zq", "é", "ж", "\U0001f600"]) for _ in range(700_000))[:1_000_000]
    assert len(word) == 1_000_000
    for n in (63, 64, 65, 5_000):
        own = token_counts.Trie(pieces)
        score, used = own.count(token_counts.MARK + word[:n])
        assert own.nodes <= token_counts.DEPTH + 1
        want = near_segmentation(token_counts.MARK + word[:n], pieces, byte)
        assert n > 100 or want == best_segmentation(token_counts.MARK + word[:n], pieces, byte)
        assert math.isclose(score, want[0], rel_tol=1e-12) and used == want[1]
    rows = [(1, word), (2, "the " + word[:70]), (3, "the")]
    got = {r.doc_id: r for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    score, used = near_segmentation(token_counts.MARK + word, pieces, byte)
    assert got[1].n_words == 1 and got[1].n_tokens == used and math.isclose(got[1].log_prob, score, rel_tol=1e-9)
    assert got[2].n_words == 2 and got[2].n_tokens > got[3].n_tokens


@pytest.mark.parametrize("nodes", [400_000, 40])
def test_token_counts_equal_brute_force(spark, nodes):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.read_pieces(path)
    byte = min(pieces.values()) + math.log(token_counts.BYTE)
    rows = [(d, t[:3000] if t else t, 5) for d, t, *_ in documents()] + [(60, "the theory thereof theory 漢字 \U0001f600 naïve", 5)]
    out = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_words long"), path, nodes=nodes).collect()
    assert [c for c in out[0].asDict()] == ["doc_id", "text", "n_words", "n_tokens", "log_prob"]
    for r in out:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        found = [best_segmentation("▁" + w, pieces, byte) for w in words]
        assert (r.n_words, r.n_tokens) == (len(words), sum(n for _, n in found))
        assert math.isclose(r.log_prob, math.fsum(s for s, _ in found), abs_tol=1e-6)


def labelled(spark, n=600):
    rng, docs, labels = random.Random(11), [], []
    for k in range(n):
        words = prose(2000 + k, 80).split(" ")
        toxic = k % 6 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "grim", "foul"]) + rng.choice(["", "ness", "er", "est"]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs += [(n, None), (n + 1, ""), (None, "vile foul"), (0, docs[0][1])]
    labels += [(None, 1), (1, None), (0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    out = toxicity.score_learned(docs.withColumn("score", F.lit("own")), labels).withColumn("held_out", toxicity.held_out()).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 600]
    right = [r.predicted == int(r.doc_id % 6 == 0) for r in held]
    assert len(held) > 100 and sum(right) / len(right) > 0.97
    found = next(r for r in held if r.predicted)
    words = toxicity.words_of(found.text.encode())
    assert all(any(w.startswith(("vile", "grim", "foul")) for w in words[p.start : p.end]) for p in found.passages)


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 30)
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert len({r.score for r in toxicity.score_learned(docs, some).collect()}) == 1
    assert toxicity.score_learned(docs.limit(0), labels).collect() == []


def all_segments(scores):
    """Ruzzo and Tompa's definition by recursion: the largest run, then left and right of it."""
    best, at = 0.0, None
    for a in range(len(scores)):
        for b in range(a, len(scores)):
            s = sum(scores[a : b + 1])
            if s > best + 1e-12:
                best, at = s, (a, b)
    if at is None:
        return []
    a, b = at
    right = [(x + b + 1, y + b + 1, s) for x, y, s in all_segments(scores[b + 1 :])]
    return all_segments(scores[:a]) + [(a, b, best)] + right


def test_maximal_segments_equal_their_definition():
    rng = random.Random(4)
    for _ in range(200):
        scores = [rng.choice([-0.1, -0.1, rng.uniform(-2, 2)]) for _ in range(rng.randrange(0, 18))]
        at = [i for i, s in enumerate(scores) if s != -0.1]
        got = toxicity.maximal_segments(at, [scores[i] for i in at], 0.1)
        want = all_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(math.isclose(g[2], w[2], abs_tol=1e-9) for g, w in zip(got, want, strict=True))
