"""Scalar helpers shared by the operators; all are plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldcount.design import SINGLE_MALE_CODES, SWAN


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL for a zero divisor, under ANSI mode too."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def sum0(value: Column) -> Column:
    """Sum that is 0 over an empty or all-NULL group."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def sum_if(condition: Column, value: Column) -> Column:
    """Sum of ``value`` where ``condition`` holds; NULL when no row does."""
    return F.sum(F.when(condition, value))


def pct_change(new: Column, old: Column) -> Column:
    return (ratio(new, old) - 1) * 100


def decimal_text(value: Column, places: int = 1) -> Column:
    """Half-even rounding to a fixed number of decimals, as text; NULL stays NULL."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", F.bround(value, places)))


def percent_text(value: Column, places: int = 1) -> Column:
    return F.concat(decimal_text(value, places), F.lit("%"))


def comma_text(value: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(F.bround(value, 0), 0)


def snake_text(value: Column) -> Column:
    """A label as a snake_case name: ``Ring-necked Duck`` -> ``ring_necked_duck``."""
    words = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_")
    return F.regexp_replace(words, "^_+|_+$", "")


def day_text(date: Column) -> Column:
    """A date without its year: ``May 3``."""
    return F.date_format(date, "MMMM d")


# ---------------------------------------------------------------- bird indices


def _tally(double_males: bool, with_groups: bool) -> Column:
    males = F.col("flockdrake") + F.col("lonedrake")
    birds = F.col("pairs") * 2 + (males * 2 if double_males else males)
    return birds + F.col("groups") if with_groups else birds


def seen_birds() -> Column:
    """Birds actually seen."""
    return _tally(double_males=False, with_groups=True)


def indicated_birds() -> Column:
    """Birds indicated: a lone male stands for a pair, except in the single-male species."""
    single = F.col("species").isin(*SINGLE_MALE_CODES)
    return F.when(single, _tally(False, True)).otherwise(_tally(True, True))


def indicated_birds_without_groups() -> Column:
    single = F.col("species").isin(*SINGLE_MALE_CODES)
    return F.when(single, _tally(False, False)).otherwise(_tally(True, False))


def ratio_birds() -> Column:
    """The index of the ratio and population estimators: swan groups are left out."""
    return F.when(F.col("species") == SWAN, _tally(False, False)).otherwise(indicated_birds())
