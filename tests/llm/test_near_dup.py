import re
from collections import defaultdict

from holdfast.llm import near_dup
from tests.llm.frames import SCHEMA, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    n = min(size, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in members[root(i)] if x is not None]
        component = d if not sets[i] else (min(ids) if ids else None)
        out.append((d, len(sets[i]), component, component is None or d == component))
    return sorted(out, key=str)


def linked(spark, rows, size, percent=80):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dup.link(df, size=size, percent=percent)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=str)


def test_links_equal_brute_force(spark):
    rows = [(d, t) for d, t, *_ in documents()]
    assert linked(spark, rows, 2) == brute(rows, 2, 80)


def test_chains_of_near_copies(spark):
    words = prose(31, 200).split(" ")
    rows = [(k, " ".join(f"w{k}x{i}" if i < 4 * k else w for i, w in enumerate(words))) for k in range(30)]
    rows += [(100 + k, " ".join(words[: 190 + k])) for k in range(10)] + [(200 + k, prose(300 + k, 60)) for k in range(30)]
    assert linked(spark, rows, 2) == brute(rows, 2, 80)


def test_lists_compared_in_small_blocks(spark, monkeypatch):
    """Without the star rounds and with blocks of three, every link must come from the comparison of whole lists."""
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    words = prose(77, 60).split(" ")
    rows = [(k, " ".join(f"z{k}" if i == k else w for i, w in enumerate(words))) for k in range(25)] + [(50 + k, prose(700 + k, 50)) for k in range(10)]
    rows += [(90, " ".join(words[:55])), (91, " ".join(words[:40])), (92, "")]
    assert linked(spark, rows, 2) == brute(rows, 2, 80)


def test_one_document_of_each_group_stays(spark):
    df = spark.createDataFrame([(*r, "x") for r in documents()], SCHEMA + ", row_key string")
    stay = near_dup.dedup(df, size=5)
    assert stay.columns == df.columns
    ids = [r.doc_id for r in stay.collect()]
    # 13 differs from 1 in capitals beyond A to Z
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 8, 10, 11, 12, 12, 13, 14, 15, 16, 20]


def test_empty_table(spark):
    assert linked(spark, [], 5) == []


def test_components_of_a_long_path(spark):
    keys = [bytes([k * 37 % 251, k]) for k in range(40)]
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(keys[:-1], keys[1:], strict=True)], "a binary, b binary")
    labels = near_dup.components(edges).collect()
    assert len(labels) == 40 and len({bytes(r.label) for r in labels}) == 1


def test_a_place_shares_no_list_by_one_frequent_shingle(spark):
    """Short texts with one word pair in common, every one of another topic: few share a list, though all share coordinates."""
    rows = [(k, "very often " + prose(900 + k, 10)) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near_dup.signatures(df, "doc_id", "text", 2, near_dup.width_of(80))
    nodes = near_dup.numbered_nodes(signed, *[near_dup.F.first(c).alias(x) for c, x in (("n_shingles", "n"), ("lead", "lead"), ("sketch", "sketch"))])
    assert near_dup.postings(nodes, 80).count() < 5 * len(rows)
    assert linked(spark, rows, 2) == brute(rows, 2, 80)


def test_nodes_of_one_class_meet_in_that_class_only(spark):
    df = spark.createDataFrame([(k, 100, list(range(near_dup.POSTED))) for k in range(2)], "node long, n long, lead array<int>")
    lists = near_dup.postings(df, 80).groupBy("list").count().collect()
    assert len(lists) <= near_dup.POSTED and {r["count"] for r in lists} == {2}


def test_nodes_of_neighbouring_classes_meet(spark):
    df = spark.createDataFrame([(1, 90, list(range(near_dup.POSTED))), (2, 110, list(range(near_dup.POSTED)))], "node long, n long, lead array<int>")
    met = near_dup.postings(df, 80).groupBy("list").count().filter("count = 2")
    assert 0 < met.count() <= near_dup.POSTED


def test_low_thresholds_post_single_coordinates(spark):
    assert [near_dup.width_of(p) for p in (100, 80, 70, 60, 30)] == [2, 2, 2, 1, 1]
    words = prose(55, 60).split(" ")
    rows = [(k, " ".join(f"y{k}x{i}" if i % 12 == k else w for i, w in enumerate(words))) for k in range(8)]
    assert linked(spark, rows, 1, 60) == brute(rows, 1, 60)


def test_what_most_of_a_list_has_joined_is_sent_once(spark, monkeypatch):
    """Rows grow with a list in proportion while few are outside its largest component, and all pairs of labels still meet."""
    monkeypatch.setattr(near_dup, "BLOCK", 50)
    labels = [0] * 1500 + [k // 2 for k in range(2, 42)]
    rows = [(7, len(labels), 0, 40, k, x, 1, b"") for k, x in enumerate(labels)] + [(8, 90, 0, 60, 5000 + k, max(0, k - 30), 1, b"") for k in range(90)]
    rest = spark.createDataFrame(rows, "list long, members long, most long, others long, node long, label long, n long, sketch binary")
    dealt = [r for r in near_dup.in_blocks(rest).collect() if r["list"] == 7]
    assert len(dealt) <= 1500 + 40 * 31
    groups = defaultdict(list)
    for r in dealt:
        groups[r.i, r.j].append(r)
    met = [(min(a.node, b.node), max(a.node, b.node)) for (i, j), g in groups.items() for x, a in enumerate(g) for b in g[x + 1 :] if a.label != b.label and (i == j or a.own != b.own)]
    assert len(met) == len(set(met)) == sum(labels[a] != labels[b] for a in range(1540) for b in range(a))
    # a list of two blocks is one group
    assert near_dup.in_blocks(rest.filter("list = 8")).count() == 90
