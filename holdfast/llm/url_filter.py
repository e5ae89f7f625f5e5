"""URL filters: host and path rules, and exact list membership by a cascade of Bloom filters.  DataFrame functions only.

The universe is every key of the corpus, some of them listed.  Level 1 encodes the listed keys; keys outside the list that
it lets through are encoded by level 2; listed keys that level 2 lets through by level 3, and so on until a level lets
nothing wrong through.  A key's first miss tells what it is: at an odd level it is not listed, at an even level it is; a key
that passes all levels belongs to what the last level encodes.  For keys of the universe this is exact, and judging a page
needs no join with the list.

A level is an array of 64-bit words that reaches the tasks as the value of a scalar subquery.  Keys are dealt into segments
by hash so that a level has at most SEGMENT_KEYS keys (about 6 bits each), and one reading of the pages takes at most
SEGMENTS of them; a longer list is judged in several readings with the rows written in between.

Defined cases: a null url, or one without `://`, has an empty host and path; an empty key is a key like others; a null key is
not listed; repeated pages and keys change nothing; an empty list or an empty universe has no levels and lists nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

SEGMENT_KEYS = 4_000_000
SEGMENTS = 16
#: Bits of a key at each level; false positives are about one in 2 ** BITS.
BITS = 4

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class Level(NamedTuple):
    number: int
    words: int
    bits: DataFrame


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), _URL, 1), F.lit("")), _CAPITALS, _SMALL)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), _URL, 2), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    own = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
    return own & F.startswith(path, F.lit(rule.path))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equally long ones the first in the alphabet), else nulls."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(ranked):
        met = fits(rule, host, path)
        text, verdict = F.when(met, rule.text).otherwise(text), F.when(met, rule.verdict).otherwise(verdict)
    return text, verdict


def position(key: Column, level: int, i: int, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(words * 64))


def encode(keys: DataFrame, key: str, level: int, n: int) -> Level:
    """The filter of `n` keys: a row with an array of words."""
    words = max(1, math.ceil(n * BITS / math.log(2) / 64))
    places = keys.select(F.explode(F.array(*[position(F.col(key), level, i, words) for i in range(BITS)])).alias("p"))
    set_words = places.select((F.col("p") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w"))
    dense = every.join(set_words, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return Level(level, words, dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits")))


def passes(level: Level, key: Column) -> Column:
    bits = level.bits.scalar()
    out = F.lit(True)
    for i in range(BITS):
        p = position(key, level.number, i, level.words)
        out = out & (F.getbit(F.get(bits, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
    return out


def build_cascade(keys: DataFrame, key: str, listed: str) -> list[Level]:
    """`keys` has each key of the universe once."""
    inside = keys.filter(F.col(listed)).select(key)
    outside = keys.filter(~F.col(listed)).select(key)
    levels: list[Level] = []
    n = inside.count()
    while n:
        level = encode(inside, key, len(levels) + 1, n)
        level = level._replace(bits=written(level.bits, "bloom_level"))
        levels.append(level)
        wrong = written(outside.filter(passes(level, F.col(key))), "bloom_rest")
        n = wrong.count()
        inside, outside = wrong, inside
    return levels


def is_listed(levels: Sequence[Level], key: Column) -> Column:
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(passes(level, key), out).otherwise(F.lit(level.number % 2 == 0))
    return out


def mark_listed(pages: DataFrame, key: str, universe: DataFrame, listed: str, out: str = "listed", segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """`pages` with a boolean column: whether `key` is listed in `universe` (columns `key` and `listed`)."""
    keys = written(universe.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.coalesce(F.col(listed), F.lit(False))).alias(listed)), "url_keys")
    segments = max(1, math.ceil(keys.count() / segment_keys))
    segment = lambda k: F.pmod(F.xxhash64(F.lit(0), k), F.lit(segments))
    df = pages.withColumn(out, F.lit(False))
    for first in range(0, segments, SEGMENTS):
        if first:
            df = written(df, "url_pages")
        answer = F.col(out)
        for s in range(first, min(segments, first + SEGMENTS)):
            levels = build_cascade(keys.filter(segment(F.col(key)) == s) if segments > 1 else keys, key, listed)
            found = is_listed(levels, F.col(key))
            answer = F.when(segment(F.col(key)) == s, found).otherwise(answer) if segments > 1 else found
        df = df.withColumn(out, F.coalesce(answer, F.lit(False)) & F.col(key).isNotNull())
    return df


def judge_urls(pages: DataFrame, rules: Sequence[Rule], listed: Column, *, url: str = "url", segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """`pages` with host, path, rule and verdict.

    A page's key is its host and path.  `listed`, an expression on host and path, says which keys of the corpus the block
    list holds; a fitting rule decides, else membership in that list.
    """
    taken = {c: fresh(pages, c) for c in ("key", "listed")}
    k, m = taken["key"], taken["listed"]
    plain = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    df = plain.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn(k, F.concat("host", "path"))
    universe = df.select(k, listed.alias(m))
    df = mark_listed(df, k, universe, m, m, segment_keys)
    text, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    own = F.when(F.col(m), "block").otherwise("allow")
    return df.withColumn("rule", text).withColumn("verdict", F.coalesce(verdict, own)).drop(k, m)
