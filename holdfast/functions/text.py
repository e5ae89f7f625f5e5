"""Parsing and formatting of text measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ref(name: str) -> Column:
    """A column by its literal name, whatever characters it contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def parse_number(text: Column) -> Column:
    """Text to double; blank or invalid text and NaN give null.

    Java's parser also takes type suffixes ("12d", "3f"), which are not numbers here.  Looking at the last
    letter is much cheaper than a pattern, and every row is cast once.
    """
    trimmed = F.trim(text.cast("string"))
    odd = F.lower(F.right(trimmed, F.lit(1))).isin("d", "f", "n") & ~F.lower(trimmed).isin("inf", "+inf", "-inf")
    return F.when(~odd, trimmed).try_cast("double")


def nan_to_null(number: Column) -> Column:
    return F.when(~F.isnan(number), number)


def parse_months(text: Column) -> Column:
    bare = F.regexp_replace(text.cast("string"), r"\s*months\s*$", "")
    return F.trim(bare).try_cast("int")


def parse_money(text: Column) -> Column:
    return parse_number(F.replace(text.cast("string"), F.lit("$"), F.lit("")))


def parse_percent(text: Column) -> Column:
    """ "33.63%" to 0.3363; the percent sign is required. """
    t = F.trim(text.cast("string"))
    return F.when(t.endswith("%"), parse_number(F.rtrim(t, F.lit("%"))) / F.lit(100.0))


def _plain(number: Column, digits: int) -> Column:
    return F.replace(F.format_number(number, digits), F.lit(","), F.lit(""))


def format_percent(fraction: Column, digits: int = 0) -> Column:
    return F.concat(_plain(fraction.cast("double") * F.lit(100.0), digits), F.lit("%"))


def format_rate(percent: Column, digits: int = 1) -> Column:
    """A value that already counts in percent."""
    return F.concat(_plain(percent.cast("double"), digits), F.lit("%"))


def format_money(amount: Column, digits: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount.cast("double"), digits))


def format_count(n: Column) -> Column:
    return F.format_number(n.cast("double"), 0)


def clean_feature_name(name: Column, width: int = 30) -> Column:
    return F.substring(F.replace(name, F.lit("_"), F.lit(" ")), 1, width)


def flag_by_pattern(value: Column, pattern: str = "churn|1|yes") -> Column:
    """Case-insensitive search; null never matches.  The default pattern also hits any "1"."""
    return F.coalesce(value.cast("string").rlike("(?i)" + pattern), F.lit(False))


def flag_strict(value: Column, positives: tuple[str, ...] = ("will churn", "churn", "yes", "1", "true")) -> Column:
    """Whole-value variant of :func:`flag_by_pattern`."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*positives), F.lit(False))


def null_to_list(*items: Column, limit: int = 5) -> Column:
    return F.slice(F.array_compact(F.array(*items)), 1, limit)
