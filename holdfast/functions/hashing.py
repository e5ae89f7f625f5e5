"""Deterministic pseudo-random numbers from row keys.

A value depends on the key and the seed only, never on partitioning, so a lost executor that recomputes
its rows makes the same choice again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ref


def key_text(keys: str | Sequence[str]) -> Column:
    names = [keys] if isinstance(keys, str) else list(keys)
    return F.concat_ws("|", *[ref(n).cast("string") for n in names])


def hash32(key: Column, seed: int | str = 42) -> Column:
    """First 32 bits of md5(key | seed) as a long."""
    digest = F.md5(F.concat(key, F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash60(key: Column, seed: int | str = 42) -> Column:
    """First 60 bits: collisions stay unlikely beyond billions of rows."""
    digest = F.md5(F.concat(key, F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def uniform(key: Column, seed: int | str = 42) -> Column:
    """A double in [0, 1)."""
    return hash32(key, seed) / F.lit(4294967296.0)
