"""The queries opN_<name> with their checking SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Query
from . import burst_trie, decontaminate, importance, mixing, near_dup, part_enum, pii, super_kmers, token_counts, token_files, toxicity, url_filter, vector_search
from .common import table
from .url_filter import Rule

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SMALL_LETTERS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


ENTROPY, REPEATS = 0.95, 4.0


def _mix_round(name: str, before: str, width: int, test: str) -> str:
    return f"""
{name} AS (
  SELECT coalesce(max(m) FILTER (WHERE {test}), any_value(low)) AS low FROM (
    SELECT m, any_value(low) AS low, any_value(total) AS total, ln(sum(pow(p, m / {mixing.GRID}.0))) - m / {mixing.GRID}.0 * sum(pow(p, m / {mixing.GRID}.0) * ln(p)) / sum(pow(p, m / {mixing.GRID}.0)) AS h,
      pow(min(p), m / {mixing.GRID}.0 - 1) / sum(pow(p, m / {mixing.GRID}.0)) AS r, count(*) AS k
    FROM (SELECT DISTINCT low, least({mixing.GRID}, low + i * {width}) AS m FROM {before}, range({mixing.PARTS + 1}) AS t(i)) marks, shares GROUP BY m) at_marks)"""


def _mix_rounds(name: str, test: str) -> str:
    steps, before = [], "zero"
    for step in range(mixing.STEPS):
        steps.append(_mix_round(f"{name}{step}", before, mixing.GRID // mixing.PARTS ** (step + 1), test))
        before = f"{name}{step}"
    return ",".join(steps)


def _number(*parts: str) -> str:
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in (f"'{mixing.SEED}'", *parts))
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


#: Restates mixing.mix for tables with more than one source and a budget as large as the corpus.
MIX_SQL = f"""
WITH facts AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS key,
    coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS document, len(regexp_extract_all(coalesce(text, ''), {SPACED}))::BIGINT AS n FROM documents),
sources AS (SELECT key, sum(n)::BIGINT AS n FROM facts GROUP BY key),
shares AS (SELECT key, n, n / (SELECT sum(n) FROM sources)::DOUBLE AS p, (SELECT sum(n) FROM sources) AS total FROM sources WHERE n > 0),
zero AS (SELECT 0::BIGINT AS low),
{_mix_rounds("e", f"h >= {ENTROPY} * ln(k) - 1e-12")},
{_mix_rounds("r", f"r > {REPEATS}")},
chosen AS (
  SELECT CASE WHEN pow(min(p), e.low / {mixing.GRID}.0 - 1) / sum(pow(p, e.low / {mixing.GRID}.0)) > {REPEATS} THEN least({mixing.GRID}, any_value(r.low) + 1) ELSE e.low END / {mixing.GRID}.0 AS t
  FROM shares, e{mixing.STEPS - 1} e, r{mixing.STEPS - 1} r GROUP BY e.low),
weights AS (SELECT key, n, total, pow(p, t) / sum(pow(p, t)) OVER () AS weight FROM shares, chosen),
plan AS (
  SELECT s.key, s.n, coalesce(weight, 0.0) AS weight, coalesce(floor(weight * total + 1e-6), 0)::BIGINT AS budget,
    CASE WHEN s.n > 0 THEN floor(weight * total + 1e-6)::BIGINT // s.n ELSE 1 END AS epochs,
    greatest(1, least({mixing.BLOCKS}, ceil(s.n / {mixing.BLOCK_TOKENS}.0)))::BIGINT AS blocks FROM sources s LEFT JOIN weights USING (key)),
placed AS (
  SELECT f.*, p.weight, p.budget, p.epochs, p.n AS source_n, CASE WHEN p.n > 0 THEN p.budget - p.epochs * p.n ELSE 0 END AS rest,
    {_number("'block'", "document")} % p.blocks AS block, {_number("'place'", "document")} AS place FROM facts f JOIN plan p USING (key)),
blocks AS (
  SELECT key, block, turn, n, rest, sum(n) OVER (PARTITION BY key ORDER BY turn, block ROWS UNBOUNDED PRECEDING) AS upto
  FROM (SELECT key, block, {_number("key", "any_value(epochs)", "block")} AS turn, sum(n) AS n, any_value(rest) AS rest FROM placed GROUP BY key, block)),
cut AS (
  SELECT key, turn AS cut_turn, block AS cut_block, rest - upto + n AS room FROM blocks WHERE upto > rest
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY turn, block) = 1),
filled AS (
  SELECT key, max(place) AS cut_place FROM (
    SELECT p.key, place, room, sum(p.n) OVER (PARTITION BY p.key ORDER BY place RANGE UNBOUNDED PRECEDING) AS filled
    FROM placed p JOIN cut c ON p.key = c.key AND p.block = c.cut_block) WHERE filled <= room GROUP BY key),
counted AS (
  SELECT p.*, p.epochs + CASE WHEN source_n = 0 OR cut_turn IS NULL THEN 0
      WHEN {_number("p.key", "epochs", "block")} < cut_turn OR ({_number("p.key", "epochs", "block")} = cut_turn AND block < cut_block) THEN 1
      WHEN block = cut_block AND place <= cut_place THEN 1 ELSE 0 END AS copies
  FROM placed p LEFT JOIN cut USING (key) LEFT JOIN filled USING (key))
SELECT doc_id, source, n AS n_tokens, epoch::BIGINT AS epoch, block FROM counted, unnest(range(0, copies::BIGINT)) AS t(epoch)
"""


@query("op1_mix_sources", MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), entropy=ENTROPY, repeats=REPEATS)
    return mixed.select("doc_id", "source", "n_tokens", "epoch", "block")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(PIECES))
    return counted.select("doc_id", "n_words", "n_tokens", "log_prob")


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))


NEAR_DUP_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({SMALL_LETTERS}, {SPACED}) AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON a = doc_id
"""


@query("op5_minhash_near_dedup", NEAR_DUP_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(table(spark, sf_dir, "documents"), size=2, percent=80).drop("row", "group")


@query("op6_vector_search")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20).drop("row")


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


DECONTAMINATE_SQL = f"""
WITH words AS (SELECT doc_id, regexp_extract_all({SMALL_LETTERS}, {ALNUM}) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({SMALL_LETTERS}, {ALNUM}) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, w[i + 1 : i + least(10, len(w))] AS x
  FROM items, unnest(range(0, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
found AS (
  SELECT d.doc_id, d.i, d.size, v.item_id FROM (
    SELECT doc_id, size, i, w[i + 1 : i + size] AS x FROM words, sizes, unnest(range(0, greatest(len(w) - size + 1, 0))) AS t(i)) d
  JOIN windows v ON v.x = d.x AND v.size = d.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list_distinct(list(item_id::VARCHAR))) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@query("op8_decontaminate", DECONTAMINATE_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


#: The block list holds every page of hosts with one of these labels.
BLOCKED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
_LABELS = r"(^|\.)(" + "|".join(BLOCKED_LABELS) + r")(\.|$)"

URL_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}) AS r(verdict, rule_host, rule_path)),
fit AS (
  SELECT host, path, max_by(rule_host || rule_path, len(rule_host || rule_path)) AS rule, max_by(verdict, len(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '{_LABELS}') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fit USING (host, path)
"""


@query("op9_url_filter", URL_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, F.col("host").rlike(_LABELS))
    return judged.select("page_id", "host", "path", "rule", "verdict")


SUBSTRING_SQL = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
windows AS (SELECT doc_id, i, w[i + 1 : i + 13] AS x FROM words, unnest(range(0, greatest(len(w) - 12, 0))) AS t(i)),
owner AS (SELECT x, min(doc_id) AS first_doc FROM windows GROUP BY x HAVING count(*) > 1),
gone AS (
  SELECT doc_id, list_sort(list_distinct(list(p))) AS gone FROM (
    SELECT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN owner USING (x) WHERE first_doc < doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS g,
    CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, k: NOT list_contains(gone, k - 1)) END AS k
  FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, g::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


@query("op10_substring_dedup", SUBSTRING_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_kmers.digest(super_kmers.dedup_substrings(table(spark, sf_dir, "documents")))


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes: byte by byte, then eight shifts each (marked by -1)."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    bits = f"list_prepend(4294967295::BIGINT, flatten(list_transform({codes}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({bits}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"


IMPORTANCE_SQL = f"""
WITH words AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all({SMALL_LETTERS}, {ALNUM}) AS w FROM documents
  UNION ALL SELECT 't', NULL, regexp_extract_all({SMALL_LETTERS}, {ALNUM}) FROM benchmark),
features AS (
  SELECT side, doc_id, array_to_string(w[i : i + n - 1], ' ') AS f, count(*) AS k
  FROM words, range(1, 4) AS s(n), unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i) GROUP BY ALL),
buckets AS (SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features)),
counts AS (SELECT bucket, coalesce(sum(k) FILTER (side = 'd'), 0) AS s, coalesce(sum(k) FILTER (side = 't'), 0) AS t FROM features JOIN buckets USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT doc_id, sum(k) AS n_features, sum(k * gain) AS weight FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE side = 'd'),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


@query("op12_importance_resampling", IMPORTANCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT c.conv_id, 0 AS src, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h),
seqs AS (
  SELECT c.conv_id, coalesce(list([role, text] ORDER BY src, pos) FILTER (pos IS NOT NULL), []) AS s FROM convs c LEFT JOIN parts USING (conv_id) GROUP BY c.conv_id),
paths AS (SELECT conv_id, s, d, s[1 : d] AS path FROM seqs, unnest(range(0, len(s) + 1)) AS t(d)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, count(DISTINCT s[d + 1]) AS n_children,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(path[d][2]) END AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends FROM paths GROUP BY path, d),
below AS (
  SELECT path[1 : k] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM nodes, unnest(range(0, d + 1)) AS t(k) GROUP BY path[1 : k])
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, n.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below USING (path) LEFT JOIN nodes p ON p.path = n.path[1 : n.d - 1] AND p.d = n.d - 1
"""


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_trie.conversation_trie(table(spark, sf_dir, "conversations"))


JACCARD_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({SMALL_LETTERS}, {SPACED}) AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON a = doc_id
"""


@query("op11_ngram_jaccard_join", JACCARD_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_enum.join(table(spark, sf_dir, "documents"), size=5, percent=80).select("doc_id", "n_shingles", "component_id")
