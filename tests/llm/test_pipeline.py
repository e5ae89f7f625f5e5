"""Every stage of the pipeline against a brute-force version of its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from holdfast.llm import queries, toxicity
from holdfast.llm.common import table, written
from tests.llm.test_near_dup import shingles
from tests.llm.test_text_ops import contaminated

public_tokenizers = pytest.importorskip("public_tokenizers")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, base):
    """Rows before the first stage and after each."""
    docs, seen = table(spark, base, "documents"), []
    seen.append([tuple(r) for r in docs.collect()])
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, base), name)
        seen.append([tuple(r) for r in docs.collect()])
    return seen


def test_stages_and_columns():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "decontaminate", "mix_sources", "token_files"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxicity_drops_what_it_rejects(spark, base, stages):
    scored = {r.doc_id: r.predicted for r in queries.op2(spark, base).collect()}
    assert Counter(stages[1]) == Counter(r for r in stages[0] if not scored[r[0]])


def test_one_document_of_each_group_stays(stages):
    rows = sorted(stages[1])
    sets = [shingles(r[1], 5) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[max(root(i), root(j))] = min(root(i), root(j))
    assert sorted(stages[2]) == [r for i, r in enumerate(rows) if root(i) == i]


def test_contaminated_documents_go(spark, base, stages):
    items = [tuple(r) for r in table(spark, base, "benchmark").select("item_id", "text").collect()]
    bad = {r[0] for r in contaminated([r[:2] for r in stages[2]], items, 10) if r[-1]}
    assert Counter(stages[3]) == Counter(r for r in stages[2] if r[0] not in bad)


def test_every_document_is_in_the_mix(stages):
    before, after = Counter(stages[3]), Counter(stages[4])
    assert set(before) == set(after) and all(1 <= n <= corpus_pipeline.REPEATS + 1 for n in after.values())
    words = lambda rows: Counter({s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows if r[3] == s) for s in {r[3] for r in rows}})
    old, new = words(stages[3]), words(stages[4])
    times = {s: new[s] / old[s] for s in old}
    biggest = max(old, key=old.get)
    assert times[biggest] == pytest.approx(1.0, abs=0.01) and max(times.values()) <= corpus_pipeline.REPEATS + 0.01


def test_token_files_hold_the_mix(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in stages[4])
    assert Counter((r[0], r[2]) for r in stages[5]) == want
    at = 0
    for doc_id, start, n, _ in sorted(stages[5], key=lambda r: r[1]):
        assert start == at
        at += n
    assert [r[0] for r in sorted(stages[5], key=lambda r: r[1])] == sorted(r[0] for r in stages[5])


def test_run_equals_the_stages(spark, base, stages):
    out = corpus_pipeline.run(spark, base)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and Counter(tuple(r) for r in out.collect()) == Counter(stages[5])


def test_pipeline_of_odd_documents(spark, base, tmp_path):
    """Nulls, empty texts, repeated rows and an empty table pass through all stages."""
    from tests.llm.frames import SCHEMA, documents

    for rows in (documents(), []):
        docs = spark.createDataFrame([r for r in rows if r[0] != 12], SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, base), name)
            assert docs.columns == COLUMNS or name == "token_files"
        got = docs.count()
        assert got > 10 if rows else got == 0


def test_reject_threshold():
    assert toxicity.REJECT == 0.7
