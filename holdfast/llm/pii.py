"""PII by bootstrapped contextual extraction.  DataFrame functions only.

Base spans come from four patterns with checks (email, ip, card, phone).  They seed a graph of patterns and instances: an
instance is a run of neighbouring tokens with digits or an @, a pattern the two words before it.  Round by round
 * a pattern's confidence in a kind is the sum of its instances' confidence in that kind over its number of instances
   (plus SMOOTH), and
 * an instance's confidence is 1 for seeds, else one minus the product of (1 - confidence) over its patterns.
At the end, every identifier-like instance in a pattern of at least CONFIDENT confidence and SUPPORT different seeds becomes a
span of the pattern's kind, as does one whose own confidence reaches CONFIDENT.

Matches and their places are found inside the row: the text is split by the pattern and the lengths of pieces and matches
are summed up, block by block, so a text with very many matches takes little more than linear time.  The patterns are written so that no text takes them more than linear time or deep recursion: a run is entered
at its first character only (or where the last match ended), and loops are possessive where giving back can't help.

Shuffled are only edges of the graph, counted per task first; the text is read once.

Defined cases: a null or empty text has no spans; a span of the method that overlaps a base span is not added; rows that
repeat (doc_id, text) get equal spans; rows with a null doc_id are scanned like others; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sha_list, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a text has no match, where there is one.
NEEDED = {"email": "@", "phone": "+"}
#: Tokens with a digit or an @, joined by single spaces.
INSTANCE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)*+"
#: The white space at the end of the text before an instance, and its last two words.
AFTER_WORD = r"(?<![\x20\x09-\x0D])[\x20\x09-\x0D]++$"
LAST_WORDS = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++)?[^\x20\x09-\x0D]++$"
#: Matches that one step of a running sum, and one search for overlaps, take together.
BLOCK = 256

ROUNDS = 3
SMOOTH = 1.0
SUPPORT = 5
CONFIDENT = 0.9
#: Digits that make an instance identifier-like; one with an @ always is.
DIGITS = 4


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        n = F.length(digits_of(m))
        return (n >= 14) & (n <= 19) & F.call_function("luhn_check", digits_of(m))
    if kind == "phone":
        return F.length(digits_of(m)).between(10, 15)
    return F.lit(True)


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def block_numbers(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))


def block(items: Column, k: Column) -> Column:
    return F.slice(items, k * BLOCK + 1, F.lit(BLOCK))


def places(text: Column, pattern: str, keep, make, move, kind: str) -> Column:
    """An array of make(start, end, x) of the matches that `keep` lets pass; `kind` is its element type.

    x has found and piece (the text before it), and the same of the match before it as found_before and piece_before.  Places
    are running sums inside blocks of matches; move(m, by) shifts an element by the length of the blocks before.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    late = lambda items: F.concat(F.array(F.lit("")), items)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["found"])
        one = F.when(keep(x["found"]), F.concat(acc["out"], F.array(make(begin, end, x).cast(kind)))).otherwise(acc["out"])
        return F.struct(F.coalesce(end, begin).cast("long").alias("at"), F.when(x["found"].isNull(), acc["out"]).otherwise(one).alias("out"))

    def summed(blocks: Column) -> Column:
        nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("before"))
        add = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before"))
        before = F.aggregate(blocks, nothing, add, lambda acc: acc["before"])
        return F.flatten(F.zip_with(blocks, before, lambda x, by: F.transform(x["out"], lambda m: move(m, by).cast(kind))))

    def whole(parts: Column) -> Column:
        zipped = F.arrays_zip(parts["pieces"].alias("piece"), parts["found"].alias("found"), late(parts["pieces"]).alias("piece_before"), late(parts["found"]).alias("found_before"))
        # the zip is one longer than the pieces
        return bound(F.slice(zipped, F.lit(1), F.size(parts["pieces"])), lambda z: bound(F.transform(block_numbers(z), lambda k: F.aggregate(block(z, k), start, step)), summed))

    return bound(F.struct(pieces.alias("pieces"), found.alias("found")), whole)


_SPAN = "struct<start: bigint, no: int, end: bigint>"
_SEEN = "struct<start: bigint, end: bigint, value: string, context: string>"


def moved_span(m: Column, by: Column) -> Column:
    return F.struct((m["start"] + by).alias("start"), m["no"].alias("no"), (m["end"] + by).alias("end"))


def base_spans(text: Column) -> Column:
    """Spans (start, number of the kind, end), sorted."""
    every = []
    for no, kind in enumerate(KINDS):
        spans = places(text, PATTERNS[kind], lambda m, kind=kind: valid(kind, m), lambda s, e, x, no=no: F.struct(s.alias("start"), F.lit(no).alias("no"), e.alias("end")), moved_span, _SPAN)
        every.append(F.when(F.contains(text, F.lit(NEEDED[kind])), spans).otherwise(F.array().cast(f"array<{_SPAN}>")) if kind in NEEDED else spans)
    return F.sort_array(F.concat(*every))


def context_of(x: Column) -> Column:
    """The two words before an instance, small and with 0 for every digit; a neighbouring instance gives words too."""
    two = lambda text: F.regexp_extract(F.regexp_replace(text, AFTER_WORD, ""), LAST_WORDS, 0)

    def across(own: Column) -> Column:
        words = F.concat_ws(" ", two(x["piece_before"]), x["found_before"], own)
        return F.when(own.rlike(r"[\x20\x09-\x0D]") | (F.length(x["found_before"]) == 0), own).otherwise(two(words))

    words = F.split(F.regexp_replace(F.lower(bound(two(x["piece"]), across)), "[0-9]", "0"), r"[\x20\x09-\x0D]+")
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def instances(text: Column) -> Column:
    """Instances (start, end, value, two words before), trimmed of marks around them."""

    def make(start: Column, end: Column, x: Column) -> Column:
        match = x["found"]
        lead = F.length(F.regexp_extract(match, r"^[^0-9A-Za-z+]*", 0))
        rest = F.length(F.regexp_extract(match, r"(?<![^0-9A-Za-z])[^0-9A-Za-z]++$|(?<=[0-9A-Za-z])[^0-9A-Za-z]++$", 0))
        rest = F.least(rest, F.length(match) - lead - 1)
        value = F.substring(match, lead + 1, F.length(match) - lead - rest)
        return F.struct((start + lead).alias("start"), (end - rest).alias("end"), value.alias("value"), context_of(x).alias("context"))

    def move(m: Column, by: Column) -> Column:
        return F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value"), m["context"].alias("context"))

    return places(text, INSTANCE, lambda m: F.contains(m, F.lit("@")) | (F.length(digits_of(m)) >= DIGITS), make, move, _SEEN)


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, row (hash of the text), base spans and instances with the kinds of base spans inside them."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64(whole).alias("row"), base_spans(whole).alias("base"), instances(whole).alias("instances"))


def occurrences(scanned: DataFrame) -> DataFrame:
    """A row per instance: where it is, its context, and the kind of the first base span that overlaps it, if any.

    The kinds are found inside the row, for a block of instances among the base spans it reaches, so rows carry one each.
    """
    meets = lambda b, first, last: (b["start"] < last["end"]) & (b["end"] > first["start"])

    def kinds(part: Column) -> Column:
        near = F.filter("base", lambda b: meets(b, F.get(part, F.lit(0)), F.element_at(part, -1)))
        one = lambda i, found: F.struct(i["start"].alias("start"), i["end"].alias("end"), i["value"].alias("value"), i["context"].alias("context"), F.get(F.filter(found, lambda b: meets(b, i, i)), F.lit(0))["no"].alias("seed"))
        return bound(near, lambda found: F.transform(part, lambda i: one(i, found)))

    seeded = F.flatten(F.transform(block_numbers(F.col("instances")), lambda k: bound(block(F.col("instances"), k), kinds)))
    one = scanned.select("doc_id", "row", F.explode(seeded).alias("i"))
    return one.select("doc_id", "row", "i.start", "i.end", F.xxhash64("i.value").alias("value"), "i.context", "i.seed")


def bootstrap(seen: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confident patterns (context, no) and confident instances (value, no)."""
    edges = written(seen.filter("context != ''").groupBy("context", "value").agg(F.min("seed").alias("seed")), "pii_edges")
    # patterns without a seed can only matter through instances they share with others
    trust = edges.filter("seed is not null").groupBy("value", F.col("seed").alias("no")).agg(F.lit(1.0).alias("c"), F.lit(True).alias("given"))
    trust = written(trust, "pii_trust")
    size = edges.groupBy("context").agg(F.count("*").alias("n"))
    for _ in range(rounds):
        held = edges.join(trust, "value").groupBy("context", "no").agg(F.sum("c").alias("c"), F.sum(F.col("given").cast("int")).alias("seeds"))
        patterns = written(held.join(size, "context").select("context", "no", (F.col("c") / (F.col("n") + SMOOTH)).alias("p"), "seeds"), "pii_patterns")
        useful = patterns.filter((F.col("p") > 0.01) & (F.col("seeds") >= 2))
        again = edges.join(useful, "context").groupBy("value", "no").agg((1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999)))))).alias("c"))
        given = trust.filter("given").select("value", "no", "given")
        both = again.join(given, ["value", "no"], "full").select("value", "no", F.when(F.col("given"), 1.0).otherwise(F.col("c")).alias("c"), F.coalesce("given", F.lit(False)).alias("given"))
        trust = written(both, "pii_trust")
    strong = patterns.filter((F.col("p") >= CONFIDENT) & (F.col("seeds") >= SUPPORT))
    best = F.max_by("no", F.struct("p", "seeds", (-F.col("no")).alias("first"))).alias("no")
    surest = F.max_by("no", F.struct("c", (-F.col("no")).alias("first"))).alias("no")
    return strong.groupBy("context").agg(best), trust.filter(F.col("c") >= CONFIDENT).groupBy("value").agg(surest)


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base and spans: arrays of (start, number of the kind in KINDS, end), sorted."""
    scanned = written(scan(docs, doc_id, text), "pii_scan")
    seen = occurrences(scanned)
    patterns, values = bootstrap(seen, rounds)
    fresh = seen.filter("seed is null")
    by_pattern = fresh.join(patterns, "context").select("doc_id", "row", "start", "end", F.lit(0).alias("way"), "no")
    by_value = fresh.join(values, "value").select("doc_id", "row", "start", "end", F.lit(1).alias("way"), "no")
    found = by_pattern.unionByName(by_value).groupBy("doc_id", "row", "start", "end").agg(F.min(F.struct("way", "no"))["no"].alias("no"))
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct("start", "no", "end")).alias("more"))
    met = scanned.join(found, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    none = F.array().cast(f"array<{_SPAN}>")
    return met.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce(F.col("more").cast(f"array<{_SPAN}>"), none))).alias("spans"))


def spelled(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"].cast("string"), s["end"].cast("string")))


def number_of(spans: str, no: int) -> Column:
    # the condition must take one argument: with a second one Spark passes the element's index
    return F.size(F.filter(spans, lambda s: s["no"] == no)).cast("long")


def digest(found: DataFrame) -> DataFrame:
    counts = [number_of("base", no).alias(f"n_{kind}") for no, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, sha_list(spelled("base")).alias("base_sha256"), F.array_join(spelled("spans"), ",").alias("spans"))
