"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import cut

#: Up to so many edges (16 bytes each) one task finds the components; more are left to the star steps.
ONE_TASK_EDGES = 250_000


def _smallest(pairs: DataFrame) -> DataFrame:
    """Least neighbour, itself included, of each ``u``; summed up before the shuffle."""
    return cut(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))


def _by_union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = np.array(sorted(up), np.int64)
    for i in range(0, len(nodes), 10_000):
        part = nodes[i : i + 10_000]
        yield pa.record_batch([pa.array(part), pa.array([find(x) for x in part.tolist()], pa.int64())], ["node", "root"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``node, root`` for each node of ``edges``; root is the least node of its component.

    Nodes are longs.  Loops and repeated or null edges do no harm; an empty table gives an empty one.

    Distinct edges are counted first.  A table of at most ``one_task_edges`` is solved by union-find in
    one task.  A larger one takes alternating large-star and small-star steps: each joins two
    materialised tables on a node, so that a node with very many edges is split by the adaptive skew
    join.  The work is the edges times the logarithm of the longest path.
    """
    plain = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    plain = cut(plain.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if plain.count() <= one_task_edges:
        return plain.coalesce(1).mapInArrow(_by_union_find, "node long, root long")
    nodes = plain.select("u").union(plain.select(F.col("v"))).distinct()
    now, told = plain.where("u <> v"), None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_smallest(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        small = large.join(_smallest(large), "u")
        small = small.select("v", "m").union(small.select(F.col("u"), F.col("m")))
        now = cut(small.toDF("u", "v").where("u <> v").distinct())
        # a star forest repeats itself: same edges, same sums
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == told:
            break
        told = sums
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))
