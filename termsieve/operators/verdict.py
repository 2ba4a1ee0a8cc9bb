"""What matches amount to: counts, categories, risk, decision, mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termsieve.config import Policy
from termsieve.functions.text import mask_ranges, severity_name, severity_rank


def hit_count(matches: Column) -> Column:
    return F.size(matches).cast("long")


def unique_terms(matches: Column) -> Column:
    """Distinct terms in order of first occurrence."""
    return F.array_distinct(F.transform(matches, lambda m: m["term"]))


def categories(matches: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["category"])))


def risk_level(matches: Column) -> Column:
    return severity_name(F.coalesce(F.array_max(F.transform(matches, lambda m: severity_rank(m["severity"]))), F.lit(0)))


def _in(value: Column, names: tuple[str, ...]) -> Column:
    return value.isin(*names) if names else F.lit(False)


def without_allowed(matches: Column, policy: Policy) -> Column:
    """Matches outside the categories that the policy allows."""
    return F.filter(matches, lambda m: ~_in(m["category"], policy.allow_categories))


def decide(matches: Column, policy: Policy) -> Column:
    """allow without relevant matches; block from the policy's count of blocking ones on; else review."""
    relevant = lambda m: ~_in(m["category"], policy.allow_categories)
    blocks = lambda m: _in(m["severity"], policy.block_severities) | _in(m["category"], policy.block_categories)
    n = F.size(F.filter(matches, lambda m: relevant(m) & blocks(m)))
    return F.when(~F.exists(matches, relevant), "allow").when((n > 0) & (n >= policy.block_min_hit_count), "block").otherwise("review")


def mask_matches(text: Column, matches: Column, mask_char: str = "*") -> Column:
    return mask_ranges(text, F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))), mask_char)
