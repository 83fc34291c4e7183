"""How strong the evidence of a release is: counts, chance, level and outcome as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the scales, weakest first, and the counts and chances of the ladder.
STATUSES = ("absent", "location-only", "tag-confirmed", "exact-rendering")
LEVELS = ("NONE", "WEAK", "MODERATE", "STRONG", "VERY_STRONG")
MODERATE_FRAGMENTS = 2
STRONG_FRAGMENTS, STRONG_FILES, STRONG_ALONE = 4, 2, 6
VERY_STRONG_FRAGMENTS, VERY_STRONG_FILES = 8, 3
CHANCE_ABOVE_WEAK, CHANCE_STRONG, CHANCE_VERY_STRONG = 1e-3, 1e-5, 1e-8


def site_chance(draws: Column, width: Column | int) -> Column:
    """Probability that one of ``draws`` accidental codes of ``width`` bits is the expected one."""
    rate = F.pow(F.lit(0.5), F.lit(width).cast("double") if isinstance(width, int) else width.cast("double"))
    return F.when(draws == 0, F.lit(0.0)).otherwise(1 - F.pow(1 - rate, draws.cast("double")))


def union_bound(probes: Column, width: int) -> Column:
    return probes.cast("double") * 0.5**width


def poisson_tail(mean: Column, events: Column) -> Column:
    """Probability of ``events`` or more where ``mean`` are expected."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    step = lambda a, i: F.struct(
        F.when(i == 0, a["term"]).otherwise(a["term"] * mean / i.cast("double")).alias("term"),
        (a["total"] + F.when(i == 0, a["term"]).otherwise(a["term"] * mean / i.cast("double"))).alias("total"),
    )
    lower = F.aggregate(F.sequence(F.lit(0), (events - 1).cast("int")), start, step, lambda a: F.exp(-mean) * a["total"])
    return F.when(events <= 0, F.lit(1.0)).when(mean <= 0, F.lit(0.0)).otherwise(F.least(F.greatest(1 - lower, F.lit(0.0)), F.lit(1.0)))


def ladder(fragments: Column, files: Column) -> Column:
    """Rank of the level that counts alone earn, 0 to 4."""
    return (
        F.when(fragments == 0, 0)
        .when((fragments >= VERY_STRONG_FRAGMENTS) & (files >= VERY_STRONG_FILES), 4)
        .when((fragments >= STRONG_ALONE) | ((fragments >= STRONG_FRAGMENTS) & (files >= STRONG_FILES)), 3)
        .when(fragments >= MODERATE_FRAGMENTS, 2)
        .otherwise(1)
    )


def chance_cap(probability: Column) -> Column:
    return F.when(probability < CHANCE_VERY_STRONG, 4).when(probability < CHANCE_STRONG, 3).when(probability < CHANCE_ABOVE_WEAK, 2).otherwise(1)


def level_rank(fragments: Column, files: Column, fingerprint_match: Column, probability: Column) -> Column:
    return F.when(fingerprint_match, 4).otherwise(F.least(ladder(fragments, files), chance_cap(probability)))


def level_word(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (rank + 1).cast("int"))


def clears_chance(rank: Column, fingerprint_match: Column, probability: Column) -> Column:
    return fingerprint_match | ((probability < CHANCE_ABOVE_WEAK) & (rank >= 2))


def outcome(rank: Column, clears: Column, partial: Column) -> Column:
    """The verdict over the strongest release; a level above NONE is a lead."""
    return F.when((rank >= 1) & clears, "PROVENANCE_DETECTED").when((rank >= 1) | partial, "INCONCLUSIVE").otherwise("NO_PROVENANCE_DETECTED")


def partial_level(confirmed: Column, total: Column) -> Column:
    """Level of what is covered, by whole thirds."""
    return F.when(total == 0, "NONE").when(confirmed * 3 >= total * 2, "STRONG").when(confirmed * 3 >= total, "MODERATE").otherwise("WEAK")


def verify_verdict(confirmed: Column, expected: Column, partial: Column) -> Column:
    return F.when(confirmed == expected, "INTACT").when(partial, "INCONCLUSIVE").otherwise("INCOMPLETE")


def compliance_grade(sites: Column, fragments: Column, complete: Column, beyond_chance: Column) -> Column:
    return F.when((sites == 0) | (fragments == 0), "NONE").when(fragments < sites, "PARTIAL").when(complete & beyond_chance, "FULL").otherwise("PARTIAL")
