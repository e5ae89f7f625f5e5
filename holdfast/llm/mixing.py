"""Mixing sources to target weights: tempered shares, realised as budgeted block permutations.

With token shares p of the sources, the weights are p ** t, normalised.  Lower exponents t bring the sources nearer to equal
weights: entropy rises, and small sources repeat more.  t is the largest, 1 at most, that reaches the target entropy, raised as far as the
repetition limit asks, found by repeated bisection into 32 parts on a grid of 2 ** -20 with one aggregate per step, so the
driver sees 33 pairs of numbers however many sources there are.

A source with weight w gets w * budget tokens: so many whole epochs, and a part of one more.  Its documents lie in blocks by
hash, at least about BLOCK_TOKENS tokens and at most BLOCKS of them; each epoch visits the blocks in another order by hash.  The part takes
blocks in the last epoch's order while they fit, and from the first that does not, documents in hash order while they fit.
So what decides about a document is one row per source, and texts are never shuffled; running sums go over a source's blocks
and over one block's documents.

`position` places each copy between 0 and 1: sorted by it, every source's blocks lie evenly over the whole mix.

Defined cases: a null source is a source of its own; a null or empty text has no tokens and costs nothing: it comes with its
block, and in a source without any tokens once; rows equal in id and text stand or fall together, for which a budget may be
left unfilled; an empty table gives an empty mix; budget None is the least budget at which every document comes once.
Columns not named here are kept; extra columns may have any name, result columns replace those of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

PARTS = 32
STEPS = 4
GRID = PARTS**STEPS
BLOCK_TOKENS = 20_000
BLOCKS = 10_000
SEED = "mix"
_WORD = r"[^\x20\x09-\x0D]+"


def number(*parts: Column | str) -> Column:
    """The first 60 bits of the md5 of the parts, joined by |."""
    text = F.concat_ws("|", F.lit(SEED), *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def document_key(doc_id: str, text: str) -> Column:
    return F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def n_tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def best_exponent(sources: DataFrame, budget_share: float | None, entropy: float, repeats: float) -> float:
    """Largest t on the grid whose weights reach `entropy` (a share of the largest possible), or if that repeats a source
    more than `repeats` times, the smallest t that does not.  `sources` has n (tokens, positive)."""
    total = sources.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max("n").alias("most"), F.min("n").alias("least")).first()
    if not total["n"] or total["k"] < 2:
        return 1.0
    p = F.col("n") / F.lit(float(total["n"]))
    big, small = total["most"] / total["n"], total["least"] / total["n"]

    def at(ts: list[float]) -> list[tuple[float, float]]:
        """Entropy and most repetitions for each exponent."""
        row = sources.agg(*[F.sum(F.pow(p, F.lit(t))).alias(f"z{i}") for i, t in enumerate(ts)], *[F.sum(F.pow(p, F.lit(t)) * F.log(p)).alias(f"l{i}") for i, t in enumerate(ts)]).first()
        out = []
        for i, t in enumerate(ts):
            z, logs = row[f"z{i}"], row[f"l{i}"]
            share = budget_share if budget_share is not None else z * big ** (1 - t)
            out.append((math.log(z) - t * logs / z, share * small ** (t - 1) / z))
        return out

    def largest(good) -> int:
        """The largest grid point for which `good` holds; it holds below any point where it does, and at 0 it is taken to."""
        low, width = 0, GRID
        for _ in range(STEPS):
            width //= PARTS
            marks = [min(GRID, low + i * width) for i in range(PARTS + 1)]
            held = [m for m, x in zip(marks, at([m / GRID for m in marks]), strict=True) if good(x)]
            low = max(held, default=low)
        return low

    t = largest(lambda x: x[0] >= entropy * math.log(total["k"]) - 1e-12)
    if at([t / GRID])[0][1] > repeats:
        t = min(GRID, largest(lambda x: x[1] > repeats) + 1)
    return t / GRID


def plan_sources(measured: DataFrame, budget_share: float | None, entropy: float, repeats: float) -> DataFrame:
    """A row per source: tokens, weight, budget, epochs, rest (tokens of the started epoch), blocks."""
    sources = written(measured.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("docs")), "mix_sources")
    full = sources.filter("n > 0")
    t = best_exponent(full, budget_share, entropy, repeats)
    total = full.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    n = float(total["n"] or 1)
    z = full.agg(F.sum(F.pow(F.col("n") / n, F.lit(t))).alias("z")).first()["z"] or 1.0
    budget = n * budget_share if budget_share is not None else n * z * ((total["most"] or 1) / n) ** (1 - t)
    weight = F.when(F.col("n") > 0, F.pow(F.col("n") / n, F.lit(t)) / z).otherwise(0.0)
    planned = sources.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * budget + 1e-6))
    if budget_share is None:
        # every source has its tokens at least, whatever the product above was rounded to
        planned = planned.withColumn("budget", F.greatest("budget", "n"))
    epochs = F.when(F.col("n") > 0, F.floor(F.col("budget") / F.col("n"))).otherwise(1)
    planned = planned.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.when(F.col("n") > 0, F.col("budget") - F.col("epochs") * F.col("n")).otherwise(0))
    return planned.withColumn("blocks", F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.ceil(F.col("n") / BLOCK_TOKENS))).cast("long"))


def cuts(placed: DataFrame, planned: DataFrame) -> DataFrame:
    """Per source, the block of the started epoch that does not fit, its place in the order, and the last document place that fits."""
    sums = placed.groupBy("key", "block").agg(F.sum("n").alias("n"), F.max("epochs").alias("epochs"), F.max("rest").alias("rest"))
    ordered = sums.withColumn("turn", number("key", "epochs", "block"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    beyond = ordered.withColumn("upto", upto).filter("upto > rest")
    cut = beyond.groupBy("key").agg(F.min(F.struct("turn", "block", "upto", "n", "rest")).alias("c"))
    cut = cut.select("key", F.col("c.turn").alias("cut_turn"), F.col("c.block").alias("cut_block"), (F.col("c.rest") - F.col("c.upto") + F.col("c.n")).alias("room"))
    inside = placed.join(cut.withColumnRenamed("cut_block", "block"), ["key", "block"]).select("key", "place", "n", "room")
    filled = F.sum("n").over(Window.partitionBy("key").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("filled", filled).filter("filled <= room").groupBy("key").agg(F.max("place").alias("cut_place"))
    return planned.join(cut.drop("room"), "key", "left").join(last, "key", "left")


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget_share: float | None = 1.0, entropy: float = 0.95, repeats: float = 4.0,
) -> DataFrame:
    """A row per copy: the columns of `docs` with n_tokens, weight (of the source), epoch, block and position.

    `budget_share` is the budget in parts of all tokens, `entropy` the target in parts of the largest, `repeats` the most
    epochs of a source.
    """
    results = ("n_tokens", "weight", "epoch", "block", "position")
    kept = [c for c in docs.columns if c not in results or c in (doc_id, text, source)]
    facts = docs.select(source_key(source).alias("key"), document_key(doc_id, text).alias("document"), n_tokens(text).alias("n"))
    measured = written(facts, "mix_facts")
    planned = written(plan_sources(measured, budget_share, entropy, repeats), "mix_plan")
    at_block = F.pmod(number(F.lit("block"), "document"), F.col("blocks"))
    placed = measured.join(planned.select("key", "blocks", "epochs", "rest"), "key").withColumn("block", at_block).withColumn("place", number(F.lit("place"), "document"))
    cut = written(cuts(placed, planned), "mix_cuts").select(
        "key", "weight", "epochs", "blocks", "cut_turn", "cut_block", "cut_place", (F.col("budget") / F.greatest("n", F.lit(1))).alias("rounds"), (F.col("n") == 0).alias("without")
    )
    own = docs.select(
        F.struct(*kept).alias("row"), source_key(source).alias("key"), document_key(doc_id, text).alias("document"), n_tokens(text).alias("n_tokens")
    ).join(cut, "key")
    own = own.withColumn("block", F.pmod(number(F.lit("block"), "document"), F.col("blocks"))).withColumn("place", number(F.lit("place"), "document"))
    turn = number("key", "epochs", "block")
    before = (turn < F.col("cut_turn")) | ((turn == F.col("cut_turn")) & (F.col("block") < F.col("cut_block")))
    inside = (F.col("block") == F.col("cut_block")) & F.coalesce(F.col("place") <= F.col("cut_place"), F.lit(False))
    more = F.when(F.col("without"), 0).when(F.col("cut_turn").isNull(), 0).when(before | inside, 1).otherwise(0)
    copies = (F.col("epochs") + more).cast("int")
    # explode() drops rows without a copy
    spread = own.withColumn("copies", copies).withColumn("epoch", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1))))
    share = number("key", F.col("epoch").cast("long"), "block") / F.lit(float(1 << 60))
    position = F.when(F.col("without"), share).otherwise((F.col("epoch") + share) / F.greatest(F.col("rounds"), F.col("copies")))
    return spread.select("row.*", "n_tokens", "weight", F.col("epoch").cast("long").alias("epoch"), "block", position.alias("position"))
