import hashlib
import re

import pytest

from holdfast.llm import pii
from tests.llm.frames import documents, prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    return {"email": True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    spans = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m.group()))
    shown = ",".join(f"{list(PATTERNS)[i]}:{s}:{e}" for s, i, e in spans)
    return (*[sum(x[1] == i for x in spans) for i in range(4)], hashlib.sha256(shown.encode()).hexdigest())


def digests(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r.doc_id, (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in pii.digest(pii.find_pii(df)).collect()]


def test_counts_and_base_spans_equal_brute_force(spark, base):
    rows = [(d, t) for d, t, *_ in documents()] + [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    rows += [
        (7001, "a@b.cd c@d.ef 1.2.3.4"), (7002, "1.2.3.4.5.6.7.8 999.1.1.1 😀 x@y.z"), (7003, "4111 1111 1111 1111 4111-1111-1111-1112 +1 (555) 010-9999"),
        (7004, " ".join(f"user{i}@mail{i % 7}.example.com" if i % 3 else f"10.{i % 256}.3.4" for i in range(3000))), (7005, "word" + " " * 30_000 + "+44 20 7946 0000"),
    ]
    assert sorted(digests(spark, rows), key=str) == sorted(((d, brute(t)) for d, t in rows), key=str)


@pytest.mark.parametrize("block", [2, 7])
def test_blocks_change_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(pii, "BLOCK", block)
    rows = [(1, " ".join(f"u{i}@m.org 10.0.0.{i}  {i}" for i in range(23))), (2, "1.2.3.4"), (3, "none"), (4, None)]
    assert sorted(digests(spark, rows)) == sorted((d, brute(t)) for d, t in rows)


def spans_of(spark, texts):
    out = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return {r.doc_id: [(pii.KINDS[s["no"]], s["start"], s["end"]) for s in r.spans] for r in out.collect()}


def test_unseen_identifiers_in_aligned_columns(spark):
    seeds = [f"{prose(k, 4)}\nhome  phone:\t +1 (555) 010-{1000 + k} " for k in range(70)]
    unseen = "home  phone:" + " " * 40 + "5550109999 then"
    found = spans_of(spark, [*seeds, unseen])
    at = unseen.index("555")
    assert found[70] == [("phone", at, at + 10)]


def test_context_reaches_over_a_neighbouring_instance(spark):
    seeds = [f"{prose(k, 4)} card 12{k:02d}55\n4111 1111 1111 1111 end" for k in range(30)]
    context = spark.createDataFrame([(0, seeds[0])], "doc_id long, text string")
    seen = pii.occurrences(pii.scan(context, "doc_id", "text")).select("context", "seed").collect()
    assert [(r.context, r.seed) for r in seen][-1] == ("card 000000", 2)
