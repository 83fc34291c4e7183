"""Rules that documents of a store must keep, agreements between them, and the codes that say how a command ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.keys import SLOTS, is_release_id

# The codes of outcomes, verdicts and errors.
EXIT_CODES = {
    "NO_PROVENANCE_DETECTED": 0,
    "PROVENANCE_DETECTED": 1,
    "INCONCLUSIVE": 10,
    "INTACT": 0,
    "INCOMPLETE": 5,
    "usage": 2,
    "secret-unavailable": 3,
    "not-protected": 4,
    "invalid-manifest": 5,
    "release-mismatch": 5,
    "protocol-version-unsupported": 6,
    "limit-exceeded": 7,
    "unsupported-language": 8,
    "invalid-watermark": 9,
    "insufficient-evidence": 10,
    "unsafe-embedding": 11,
    "malformed-source": 12,
    "parser-failure": 13,
    "io": 14,
    "no-safe-locations": 15,
    "path-rejected": 16,
    "internal": 70,
}

#: What must hold of a record, by the name of the rule.
RECORD_RULES = {
    "release-id": is_release_id,
    "no-sites": lambda sites: sites >= 1,
    "tag-bits": lambda bits: bits.between(2, 8),
    "fingerprint": lambda x: F.regexp_like(x, F.lit("^[0-9a-f]{64}$")),
    "created-at": lambda x: F.regexp_like(x, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$")),
}
_FIELDS = {"release-id": "release_id", "no-sites": "sites", "tag-bits": "tag_bits", "fingerprint": "fingerprint", "created-at": "created_at"}


def broken(rules: dict, fields: dict[str, str] = _FIELDS) -> Column:
    """The names of the rules that a row breaks, in order; a rule whose field is null is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule(F.col(fields[name])), F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def drifted(old: Column, new: Column) -> Column:
    """The slots whose address in one list is another than in the other list, place by place."""
    names = F.array(*[F.lit(s) for s in SLOTS])
    pairs = F.arrays_zip(names.alias("n"), old.alias("a"), new.alias("b"))
    return F.transform(F.filter(pairs, lambda x: x["a"] != x["b"]), lambda x: x["n"])


def agreement(records: DataFrame, manifests: DataFrame, plans: DataFrame) -> DataFrame:
    """``release_id, manifest, plan``: the first thing in which a manifest or plan is not the record's."""
    m = manifests.select("release_id", *[F.col(c).alias(f"_{c}") for c in ("project", "fingerprint", "level", "digest")], F.lit(True).alias("_there"))
    p = plans.select("release_id", F.col("digest").alias("_planned"))
    state = F.when(F.col("_there").isNull(), "no-manifest")
    for c in ("project", "fingerprint", "level", "digest"):
        state = state.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"{c}-differs")
    plan = F.when(F.col("_planned").isNull(), "no-plan").when(F.col("_planned") != F.col("digest"), "digest-differs").otherwise("agrees")
    return records.join(m, "release_id", "left").join(p, "release_id", "left").select("release_id", state.otherwise("agrees").alias("manifest"), plan.alias("plan"))
