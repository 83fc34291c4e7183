"""Balanced label propagation: documents with equal texts move together under capacity quotas.

Law ``rows``: shard sizes are at most one row apart.  Documents whose text occurs once have no links
and fill whatever space the linked ones leave, so only linked documents are placed by their links.

Equal texts are all linked with one another.  Documents start in shards by their hash; a *cell* is what
a group has in one of them.

1. The driver settles the quotas from the number of groups of each size: how many groups of each size
   every shard may take whole (``placement``).  They are spread over the shards by their room, or dealt
   first fit where that cuts fewer groups.  Groups that fit nowhere are tried again after an exchange of
   a group of one shard with a smaller one of another (or with its free room); what still fits nowhere is
   cut over the largest rooms, so at most ``shards - 1`` groups are cut besides those larger than a shard.
2. In each round a group asks to move to the shard that holds most of its neighbours among those whose
   quota for its size is not used up.  Quotas are granted by gain, the most neighbours there first;
   the documents of a granted group all move.
3. Rounds end when no group can ask.  A group only asks a shard in vain that is then full for its size,
   so that is after ``shards`` rounds at most.  Groups without neighbours in a shard with room, and
   those that are to be cut, are numbered by size and fill the quotas that are left.

Rows are numbered once, by *lot*: the whole groups of a shard, each cut group, and the rows without links.
Since the driver knows how many rows of each lot a shard takes, a number gives shard and slot.

No task holds a group: cells are counts, and members of a cut group are numbered in buckets.  The driver
holds a number for each size of group, of which n rows have less than the root of 2n, and each shard
that it goes to, and for each power of two of neighbours.  A
null text is empty with size 16; repeated rows are placed one by one; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import reduce
from itertools import accumulate
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import BROADCAST_ROWS, cut, gapless_rank, keyed

SHARDS = 40
BUCKETS = 256


def _make_room(size: int, free: list[int], inside: list[Counter]) -> int | None:
    """A shard that has room for ``size`` after one exchange, which is carried out; None if none helps."""
    for s in sorted(range(len(free)), key=lambda s: -free[s]):
        lack = size - free[s]
        for t in range(len(free)):
            if t == s or free[t] < lack:
                continue
            there = sorted([0, *(m for m, n in inside[t].items() if n)])
            for a in sorted(m for m, n in inside[s].items() if n):
                i = bisect_left(there, a - free[t])
                if i < len(there) and there[i] <= a - lack:
                    b = there[i]
                    for m, x, y in ((a, s, t), (b, t, s)):
                        if m:
                            inside[x][m] -= 1
                            inside[y][m] += 1
                    free[s] += a - b
                    free[t] -= a - b
                    return s
    return None


def placement(sizes: dict[int, int], room: list[int], even: bool = False) -> tuple[list[Counter], list[tuple[int, list[tuple[int, int]]]], list[int]]:
    """Where groups go of which there are ``sizes[m]`` of size m; they fit into ``room`` together.

    Gives for each shard how many whole groups of each size it takes, then the groups that are cut, each
    with its size and (shard, rows), and the room that is left.  ``even`` spreads the groups of a size over
    all shards by their room instead of filling one shard after the other.
    """
    free, inside = list(room), [Counter() for _ in room]
    split: list[tuple[int, list[tuple[int, int]]]] = []
    larger = []
    for m in sorted((m for m in sizes if m > max(room)), reverse=True):
        larger += [m] * sizes[m]
    rests: dict[int, list[list[tuple[int, int]]]] = {}
    for m in larger:
        pieces, rest = [], m
        for s in sorted(range(len(free)), key=lambda s: -free[s]):
            if free[s] == room[s] and 0 < free[s] <= rest:
                pieces.append((s, free[s]))
                rest -= free[s]
                free[s] = 0
        split.append((m, pieces))
        if rest:
            rests.setdefault(rest, []).append(pieces)
    #: Rests stay where they are put: only whole groups are exchanged.
    late: list[tuple[int, list[tuple[int, int]] | None]] = []
    for m in sorted({*rests, *(m for m in sizes if m <= max(room))}, reverse=True):
        for pieces in rests.get(m, []):
            fits = [s for s in range(len(free)) if free[s] >= m]
            if fits:
                s = min(fits, key=lambda s: free[s])
                pieces.append((s, m))
                free[s] -= m
            else:
                late.append((m, pieces))
        n = sizes.get(m, 0) if m <= max(room) else 0
        fits = [f // m for f in free]
        if even and n < sum(fits):
            take = [n * k // sum(fits) for k in fits]
            for s in sorted((s for s in range(len(free)) if fits[s]), key=lambda s: -free[s])[: n - sum(take)]:
                take[s] += 1
        else:
            take = [min(k, max(0, n - before)) for k, before in zip(fits, accumulate(fits, initial=0))]
        for s, k in enumerate(take):
            if k:
                inside[s][m] += k
                free[s] -= k * m
                n -= k
        late += [(m, None)] * n
    gained = True
    while gained and late:
        gained, still = False, []
        for m, pieces in late:
            fits = [s for s in range(len(free)) if free[s] >= m]
            s = min(fits, key=lambda s: free[s]) if fits else _make_room(m, free, inside)
            if s is None:
                still.append((m, pieces))
                continue
            gained = True
            free[s] -= m
            if pieces is None:
                inside[s][m] += 1
            else:
                pieces.append((s, m))
        late = still
    for m, pieces in late:
        if pieces is None:
            split.append((m, pieces := []))
        while m:
            s = max(range(len(free)), key=lambda s: free[s])
            k = min(m, free[s])
            pieces.append((s, k))
            free[s] -= k
            m -= k
    return inside, split, free


def quotas(sizes: dict[int, int], room: list[int]) -> tuple[list[Counter], list[tuple[int, list[tuple[int, int]]]], list[int]]:
    """The even ``placement``, or the one by first fit where that cuts fewer groups."""
    even = placement(sizes, room, True)
    if all(m > max(room) for m, _ in even[1]):
        return even
    return min(even, placement(sizes, room), key=lambda p: len(p[1]))


def _granted(asked: list, inside: list[Counter]) -> list[tuple[int, int, int, int, bool]]:
    """Grants ``(members, shard, level, groups, all of them)`` for the sums that were asked; quotas go down."""
    out = []
    for r in sorted(asked, key=lambda r: -r["level"]):
        k = min(r["n"], inside[r["shard"]][r["members"]])
        if k:
            inside[r["shard"]][r["members"]] -= k
            out.append((r["members"], r["shard"], r["level"], k, k == r["n"]))
    return out


def gathered(cells: DataFrame) -> DataFrame:
    """``g, members, cells``: a row for each group, with its cells (at most one for each shard) in an array."""
    cell = F.struct("n", F.xxhash64("g", "shard").alias("h"), "shard")
    return cells.groupBy("g").agg(F.sum("n").alias("members"), F.collect_list(cell).alias("cells"))


def propagate(cells: DataFrame, groups: DataFrame, inside: list[Counter]) -> tuple[DataFrame, DataFrame]:
    """Rounds of moves towards neighbours: ``(g, shard)`` of groups that moved, and the groups that did not.

    ``cells`` has ``g, shard, n``, ``groups`` has ``g, members``; both are materialised.  ``inside`` says how
    many groups of each size a shard may take and is lowered by what is granted.
    """
    state = rounds(cut(groups.join(gathered(cells).drop("members"), "g")), inside)
    return state.where("shard is not null").select("g", "shard"), state.where("shard is null").select("g", "members")


def rounds(groups: DataFrame, inside: list[Counter]) -> DataFrame:
    """``g, members, cells, shard`` for each of ``groups``; ``shard`` is null (and ``cells`` kept) if it did not move.

    ``groups`` has ``g, members, cells`` and is materialised.  A group sees its own cells, so asking takes no
    shuffle; a round counts what is asked and writes one table, in which settled groups have no cells.
    """
    spark, parts = groups.sparkSession, groups.rdd.getNumPartitions()
    state = groups.select("g", "members", "cells", F.lit(None).cast("int").alias("shard"))
    keys = ["members", "_to", "_level"]
    while True:
        open_ = {}
        for s, x in enumerate(inside):
            for m, n in x.items():
                if n:
                    open_.setdefault(m, []).append(s)
        quota = F.broadcast(spark.createDataFrame(list(open_.items()), "members long, _open array<int>"))  # one row for each size
        best = F.array_max(F.filter("cells", lambda c: F.array_contains("_open", c["shard"])))
        asked = state.join(quota, "members", "left").withColumn("_best", best).drop("_open")
        asked = asked.withColumn("_to", F.col("_best.shard")).withColumn("_level", F.floor(F.log2("_best.n")).cast("int")).drop("_best")
        counted = asked.where("_to is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()  # sizes x shards x powers of two
        grants = _granted([{"members": r["members"], "shard": r["_to"], "level": r["_level"], "n": r["n"]} for r in counted], inside)
        if not grants:
            return state
        table = F.broadcast(spark.createDataFrame(grants, "members long, _to int, _level int, _grant long, _all boolean"))
        taken = asked.join(table, keys, "left")
        some = taken.where("not _all").select("g", *keys, "cells", "_grant")
        won = taken.where("_all is null or _all").withColumn("_to", F.when(F.col("_all"), F.col("_to")))
        won = won.select("g", "members", "cells", F.coalesce("shard", "_to").alias("shard"))
        if not all(g[-1] for g in grants):
            ranked = gapless_rank(cut(some), keys, F.col("g"), BUCKETS, "_rank")
            won = won.unionByName(ranked.select("g", "members", "cells", F.when(F.col("_rank") < F.col("_grant"), F.col("_to")).alias("shard")))
        state = cut(won.withColumn("cells", F.when(F.col("shard").isNull(), F.col("cells"))).coalesce(parts))


def label_propagation_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs``."""
    text = F.col("text")
    skinny = keyed(docs).select(
        "doc_id", "_k", "_h",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text, F.crc32(text), F.octet_length(text)).alias("g"),
    )
    skinny = cut(skinny)
    total = skinny.count()
    room = [total // shards + (s < total % shards) for s in range(shards)]
    own = F.xxhash64("_h", "_k")
    cells = skinny.groupBy("g", F.pmod(own, F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    groups = cut(gathered(cells).where("members > 1"))
    spark = docs.sparkSession
    sizes = {r["members"]: r["n"] for r in groups.groupBy("members").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each size
    few_groups = sum(sizes.values()) <= BROADCAST_ROWS
    inside, split, free = quotas(sizes, room)
    quota = reduce(Counter.__add__, inside)
    state = rounds(groups, inside)
    remaining = reduce(Counter.__add__, inside)
    sizes = {m: n - quota[m] + remaining[m] for m, n in sizes.items()}
    # the other groups of a size are numbered; shards take them from 0 on, and those that are cut come last
    bounds: dict[int, tuple[list[int], list[int]]] = {m: ([], []) for m in sizes}
    for s in range(shards):
        for m, n in inside[s].items():
            if n:
                ends, places = bounds[m]
                ends.append((ends[-1] if ends else 0) + n)
                places.append(s)
    # rows are numbered by lot: those of a shard's whole groups, those of each cut group, and those without links
    lots = [(s, [], [s], [0]) for s in range(shards)]
    at = [r - f for r, f in zip(room, free)]
    for _, pieces in split:
        for s, n in pieces:
            at[s] -= n
    cuts = []
    for m, pieces in [*split, (0, list(enumerate(free)))]:
        ends, first, taken = [], [], 0
        for s, n in pieces:
            first.append(at[s] - taken)
            at[s] += n
            taken += n
            ends.append(taken)
        if m:
            sizes[m] -= 1
            cuts.append((m, sizes[m], len(lots)))
        lots.append((len(lots), ends, [s for s, _ in pieces], first))
    unlinked = lots[-1][0]
    linked = state.where("shard is not null").select("g", F.col("shard").alias("_lot"))
    if any(sizes.values()) or cuts:
        numbered = gapless_rank(state.where("shard is null").select("g", "members"), ["members"], F.col("g"), BUCKETS, "_rank")
        whole = F.broadcast(spark.createDataFrame([(m, *b) for m, b in bounds.items()], "members long, _ends array<long>, _places array<int>"))  # one row for each size
        few = F.broadcast(spark.createDataFrame(cuts, "members long, _rank long, _cut int"))  # under 2 x shards
        placed = (
            numbered.join(whole, "members").join(few, ["members", "_rank"], "left")
            .withColumn("_place", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))))
            .select("g", F.coalesce("_cut", F.get("_places", F.col("_place"))).alias("_lot"))
        )
        linked = linked.unionByName(placed)
    dealt = skinny.join(F.broadcast(linked) if few_groups else linked, "g", "left").withColumn("_lot", F.coalesce("_lot", F.lit(unlinked))).drop("g")
    ranked = gapless_rank(cut(dealt), ["_lot"], own, BUCKETS, "_rank")
    table = F.broadcast(spark.createDataFrame(lots, "_lot int, _ends array<long>, _places array<int>, _first array<long>"))  # under 4 x shards
    found = ranked.join(table, "_lot").withColumn("_place", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))))
    found = found.withColumn("shard", F.get("_places", F.col("_place"))).withColumn("_at", F.col("_rank") + F.get("_first", F.col("_place")))
    # whole groups come first in ``_at``; a step that has no factor in common with the rows spreads them over the shard
    step = [next((k for k in range(int(n * 0.618) + 1, n) if gcd(k, n) == 1), 1) for n in room]
    room_, step_ = (F.array(*[F.lit(x).cast("long") for x in xs]) for xs in (room, step))
    slot = F.pmod(F.col("_at") * F.get(step_, F.col("shard")), F.get(room_, F.col("shard")))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
