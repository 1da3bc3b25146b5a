"""Statistics as column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95, Z95_ONE_SIDED = 1.959963984540054, 1.6448536269514722


def rate(count: Column, total: Column) -> Column:
    """A ratio that is null on an empty denominator."""
    return F.try_divide(count.cast("double"), total.cast("double"))


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Both ends of the interval, held to 0..1; null without trials."""
    p = rate(successes, total)
    n = F.nullif(total.cast("double"), F.lit(0.0))
    middle = (p + z * z / (F.lit(2.0) * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (F.lit(4.0) * n * n))
    some = total > 0  # greatest and least pass over nulls
    return F.when(some, F.greatest(F.lit(0.0), middle - half)), F.when(some, F.least(F.lit(1.0), middle + half))


def wilson_upper(failures: Column, total: Column) -> Column:
    return wilson(failures, total, Z95_ONE_SIDED)[1]


def kappa(both_yes: Column, yes_no: Column, no_yes: Column, both_no: Column) -> Column:
    """Cohen's kappa of two raters' table; degenerate chance agreement gives 1 or 0, no pairs null."""
    n = (both_yes + yes_no + no_yes + both_no).cast("double")
    observed = F.try_divide(both_yes + both_no, n)
    chance = F.try_divide((both_yes + yes_no) * (both_yes + no_yes) + (both_no + no_yes) * (both_no + yes_no), n * n)
    return F.when(chance == 1.0, F.when(observed == 1.0, 1.0).otherwise(0.0)).otherwise(F.try_divide(observed - chance, 1 - chance))


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k as a sum, exact enough for the few discordant pairs of a test."""
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda acc, i: acc + F.log((n - k + i).cast("double")) - F.log(i.cast("double")))


def mcnemar_p(wins: Column, losses: Column) -> Column:
    """The exact two-sided p of the discordant pairs; 1 without any."""
    n, k = (wins + losses).cast("long"), F.least(wins, losses).cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda acc, i: acc + F.exp(log_choose(n, i) - n.cast("double") * F.log(F.lit(2.0))))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))
