"""Near-duplicate vectors by cross-polytope hashing.

A vector is scaled to length one, padded to a power of two and turned by three rounds of random signs
and a fast Hadamard transform.  Its hash is the axis (with sign) that it is nearest to.  A bucket of
one of ``TABLES`` tables is a pair of such hashes; besides its own bucket, a vector is put into the
``PROBES - 1`` buckets that it misses by least (multiprobe).  Vectors that share a bucket are compared
by cosine in double precision, block against block, and linked at ``THRESHOLD`` or more.

Buckets first travel as numbers.  Of those with two vectors or more, neighbouring ones of a table make a
part, and a vector is sent to each part in which it has a bucket, once; there the buckets are compared
one by one.  A bucket of over ``BLOCK`` vectors is compared in full as pairs of blocks in separate tasks.
A pair that shares several buckets is counted in the first of them, which each side can tell from the
list of its buckets that travels with it.  Comparisons give counts of links and a spanning forest of
them, never pairs, so their output is linear in their input.  Equal vectors are folded into a class
first; that a class holds one vector only is checked on the vectors themselves.

Vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing.  Vectors of
different lengths are not compared.  Rows with equal ``vec_id`` are vectors of their own.  A null id
comes last when the smallest id of a component is sought.  An empty table gives no rows; columns other
than ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import cut, small_side
from tracelight.llm.graph import connected_components
from tracelight.llm.ngram_jaccard import forest

THRESHOLD = 0.95
TABLES = 10
PROBES = 4
HASHES = 2
BLOCK = 1024
#: Vectors of a table that make a part, about.
PART_ROWS = 16_384
SEED = 71


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    rows, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(rows, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, width)
        h *= 2
    return x / np.sqrt(width)


def _turned(x: np.ndarray, table: int, which: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, x.shape[1], table, which])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def buckets(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers (rows x tables x probes) of unit vectors; the first probe is the vector's own."""
    rows, d = unit.shape
    width = 1 << max(0, d - 1).bit_length()
    padded = np.zeros((rows, width))
    padded[:, :d] = unit
    out = np.zeros((rows, tables, probes), np.int64)
    take = min(probes, width)
    for t in range(tables):
        axes, losses = [], []
        for k in range(HASHES):
            y = _turned(padded, t, k)
            size = np.abs(y)
            near = np.argpartition(-size, take - 1, axis=1)[:, :take] if take < width else np.tile(np.arange(width), (rows, 1))
            s = np.take_along_axis(size, near, 1)
            order = np.argsort(-s, axis=1, kind="stable")
            near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
            axes.append(near * 2 + (np.take_along_axis(y, near, 1) < 0))
            losses.append((s[:, :1] - s) ** 2)
        loss = (losses[0][:, :, None] + losses[1][:, None, :]).reshape(rows, -1)
        both = (axes[0][:, :, None] * (2 * width) + axes[1][:, None, :]).reshape(rows, -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        chosen = np.take_along_axis(both, best, 1)
        out[:, t, : chosen.shape[1]] = chosen
        out[:, t, chosen.shape[1] :] = chosen[:, :1]
    return out


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions of the rows, and their vectors scaled to one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = {}
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow of the squares
        out[d] = at, x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def _coded(tables: int, probes: int):
    """Adds the vectors' buckets as ``codes`` (32-bit numbers, tables x probes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 512) for whole in batches for a in range(0, len(whole), 512)):
            for at, unit in _matrix(batch.column("embedding")).values():
                codes = [x.tobytes() for x in buckets(unit, tables, probes).reshape(len(at), -1).astype(np.uint32)]
                yield pa.record_batch([*batch.take(pa.array(at)).columns, pa.array(codes, pa.binary())], [*batch.schema.names, "codes"])

    return run


def _members(tables: int, probes: int, parts: int):
    """(bucket, part, class) for each bucket of a vector; its length, table and number name a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            codes = _codes(batch.column("codes")).reshape(len(batch), tables, probes)
            d, c = batch.column("d").to_numpy().astype(np.int64), batch.column("c").to_numpy()
            axes = 2 << np.maximum(0, [int(x - 1).bit_length() for x in d.tolist()])  # both signs of each axis
            for t in range(tables):
                for p in range(probes):
                    # the same bucket twice: once is enough
                    new = np.flatnonzero(~(codes[:, t, :p] == codes[:, t, p : p + 1]).any(axis=1))
                    number = codes[new, t, p]
                    place = (d[new] << 32) + t * parts + number // axes[new] * parts // axes[new]
                    yield pa.record_batch([pa.array((d[new] << 40) + (t << 32) + number), pa.array(place), pa.array(c[new])], ["g", "p", "c"])

    return run


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).astype(np.int64)


def _first_shared(a: np.ndarray, b: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """For pairs of bucket lists: table and bucket of the first bucket that both hold, as one number."""
    x, y = a.reshape(-1, tables, probes), b.reshape(-1, tables, probes)
    least = np.full((len(x), tables), np.iinfo(np.int64).max)
    for p in range(probes):
        hit = (x[:, :, p : p + 1] == y).any(axis=2)
        least = np.where(hit, np.minimum(least, x[:, :, p]), least)
    shared = least < np.iinfo(np.int64).max
    table = shared.argmax(axis=1)
    return (table << 32) + least[np.arange(len(x)), table]


class _Vectors:
    """Rows of a block or part: classes, their sizes, unit vectors and codes."""

    def __init__(self, rows: list[tuple], tables: int, probes: int):
        self.name, self.size = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        x = np.array([r[2] for r in rows], np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.codes = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(len(rows), tables * probes).astype(np.int64)


_TOLD = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


class _Links:
    """Counts of links by class, and edges of a forest."""

    def __init__(self, threshold: float, tables: int, probes: int):
        self.threshold, self.tables, self.probes = threshold, tables, probes
        self.count: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def compare(self, left: _Vectors, i: np.ndarray, right: _Vectors, j: np.ndarray, bucket: int, same: bool) -> None:
        """Rows i of one side with rows j of the other; ``bucket`` is the one they share here."""
        links = left.unit[i] @ right.unit[j].T >= self.threshold
        a, b = np.nonzero(np.triu(links, 1) if same else links)
        if not len(a):
            return
        a, b = i[a], j[b]
        first = [_first_shared(left.codes[a[s : s + 65536]], right.codes[b[s : s + 65536]], self.tables, self.probes) for s in range(0, len(a), 65536)]
        counted = np.concatenate(first) == bucket
        a, b = a[counted], b[counted]
        for name, other, size in ((left.name[a], b, right.size), (right.name[b], a, left.size)):
            keys, inverse = np.unique(name, return_inverse=True)
            for c, n in zip(keys.tolist(), np.bincount(inverse, weights=size[other]).astype(np.int64).tolist()):
                self.count[c] = self.count.get(c, 0) + n
        self.edges += forest(left.name[a], right.name[b])

    def told(self) -> Iterator[pa.RecordBatch]:
        edges = forest(*(np.array([e[k] for e in self.edges], np.int64) for k in (0, 1)))
        rows = [(c, None, n) for c, n in self.count.items()] + [(x, y, None) for x, y in edges]
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 10_000])], schema=_TOLD)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that agree in ``keys`` and lie together, as (*keys, class, size, vector, codes)."""
    key, rows = None, []
    for batch in batches:
        vectors = batch.column("embedding")
        width = np.diff(vectors.offsets.to_numpy())
        flat, at = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(width)])
        columns = (batch.column(n).to_pylist() for n in (*keys, "c", "size", "codes"))
        for k, (*own, c, size, codes) in enumerate(zip(*columns)):
            if own != key:
                if rows:
                    yield key, rows
                key, rows = own, []
            rows.append((c, size, flat[at[k] : at[k + 1]], codes))
    if rows:
        yield key, rows


def _in_parts(threshold: float, tables: int, probes: int, parts: int, block: int):
    """Rows of one part lie together; buckets of over ``block`` vectors are left to ``_in_blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (place,), rows in _groups(batches, ("p",)):
            v, links = _Vectors(rows, tables, probes), _Links(threshold, tables, probes)
            table, part = divmod(place & ((1 << 32) - 1), parts)
            axes = 2 << max(0, v.unit.shape[1] - 1).bit_length()
            codes = v.codes.reshape(len(rows), tables, probes)[:, table]
            new = np.stack([~(codes[:, :p] == codes[:, p : p + 1]).any(axis=1) for p in range(probes)], 1)
            row, probe = np.nonzero(new & (codes // axes * parts // axes == part))
            number = codes[row, probe]
            order = np.argsort(number, kind="stable")
            row, number = row[order], number[order]
            first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            for x, n in zip(first.tolist(), np.diff(np.append(first, len(number))).tolist()):
                if 2 <= n <= block:
                    own = row[x : x + n]
                    links.compare(v, own, v, own, (table << 32) + int(number[x]), True)
            yield from links.told()

    return run


def _in_blocks(threshold: float, tables: int, probes: int):
    """Rows of one pair of blocks lie together, those of the first before those of the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list[tuple]] | None = None
        for key, rows in _groups(batches, ("g", "i", "j", "x")):
            g, i, j, x = key
            if x == i and i != j:
                held = key[:3], rows
                continue
            right = _Vectors(rows, tables, probes)
            left = right if i == j else _Vectors(held[1], tables, probes) if held and held[0] == key[:3] else None
            if left is not None:
                links = _Links(threshold, tables, probes)
                links.compare(left, np.arange(len(left.name)), right, np.arange(len(right.name)), g & ((1 << 40) - 1), i == j)
                yield from links.told()

    return run


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``."""
    fine = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    number = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = f"array<{number if number in ('float', 'double') else 'double'}>"
    rows = vectors.select("vec_id", F.when(fine, F.col("embedding").cast(kind)).alias("embedding"))
    least = F.min(F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id")))
    for salt in range(16):
        rows = rows.withColumn("c", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding", F.lit(salt))))
        ends = [F.min("embedding").alias("embedding"), F.max("embedding").alias("_last")]
        classes = cut(rows.where("c is not null").groupBy("c").agg(F.count(F.lit(1)).alias("size"), least.alias("least"), *ends))
        if classes.where("embedding <> _last").isEmpty():  # no two vectors under one number
            break
    slim = classes.select("c", "size", F.size("embedding").alias("d"), "embedding")
    coded = cut(slim.mapInArrow(_coded(tables, probes), f"c long, size long, d int, embedding {kind}, codes binary"))
    parts = max(1, -(-coded.count() // part_rows))
    members = coded.select("c", "d", "codes").mapInArrow(_members(tables, probes, parts), "g long, p long, c long")
    counts = cut(members.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    shared = members.join(small_side(counts, 200_000), "g")
    vectors_of = coded.drop("d")
    where = shared.where(F.col("k") <= block).groupBy("c").agg(F.collect_set("p").alias("ps"))  # at most tables x probes for each
    sent = vectors_of.join(where, "c").withColumn("p", F.explode("ps")).select("p", "c", "size", "embedding", "codes")
    told = sent.repartition("p").sortWithinPartitions("p").mapInArrow(_in_parts(threshold, tables, probes, parts, block), "a long, b long, n long")
    if not counts.where(F.col("k") > block).isEmpty():
        split = shared.where(F.col("k") > block).withColumn("_n", F.ceil(F.col("k") / F.lit(float(block))).cast("int"))
        split = split.withColumn("x", F.pmod(F.xxhash64("c"), F.col("_n")).cast("int")).withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        split = split.select("g", F.least("x", "_y").alias("i"), F.greatest("x", "_y").alias("j"), "x", "c").join(vectors_of, "c")
        told = told.union(split.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "x").mapInArrow(_in_blocks(threshold, tables, probes), "a long, b long, n long"))
    told = cut(told)
    counted = told.where("n is not null").groupBy("a").agg(F.sum("n").alias("more")).withColumnRenamed("a", "c")
    roots = connected_components(told.where("n is null").select("a", "b")).withColumnRenamed("node", "c")
    roots = classes.select("c", "size", "least").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    smallest = cut(roots.groupBy("root").agg(F.min("least").alias("least_of_all")))
    facts = cut(roots.join(smallest, "root").join(counted, "c", "left").select("c", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.col("least_of_all.id").alias("component_id"), F.lit(True).alias("_in")))
    out = rows.select("vec_id", "c").join(facts, "c", "left")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
