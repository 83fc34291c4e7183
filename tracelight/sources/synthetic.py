"""Made-up source trees of any size, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = ("total", "offset", "factor", "weight", "shift", "index", "limit", "count")


def _draw(seed: int, *parts: Column | int) -> Column:
    """A number below 2**31 that depends on the parts alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 31))


def synthetic_tree(spark: SparkSession, modules: int, seed: int = 1, shared_constants: bool = False) -> DataFrame:
    """``file, language, text``: JavaScript modules ``src/mod<k>.js`` of eight functions each.

    With ``shared_constants`` all modules draw their constants from one small pool, as code that is
    written to one pattern does.
    """
    k = F.col("id")

    def function(i: int) -> Column:
        word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (_draw(seed, k, i, 0) % len(WORDS) + 1).cast("int"))
        constant = (_draw(seed, i, 1) % 64 if shared_constants else _draw(seed, k, i, 1)) * 5040 + 1009
        other = _draw(seed, k, i, 2) % 9000 + 1000
        return F.concat(
            F.lit(f"export function step{i}_"), k.cast("string"), F.lit("(n) {\n  const "), word, F.lit(" = "), constant.cast("string"), F.lit(";\n  if (n > "), other.cast("string"),
            F.lit(") { return n - "), word, F.lit("; }\n  return n + "), word, F.lit(f" * {i + 2};\n}}\n"),
        )

    text = F.concat(F.lit("// module "), k.cast("string"), F.lit("\n"), *[function(i) for i in range(8)])
    return spark.range(modules).select(F.concat(F.lit("src/mod"), k.cast("string"), F.lit(".js")).alias("file"), F.lit("javascript").alias("language"), text.alias("text"))
