"""Shared plumbing of the training-data operators.

Rows of ``documents`` are identified by a pair ``(_k, _h)``: the document id (0 when null) and a hash
of id and text.  Rows that agree in both are repeats of one another, and every operator gives such
repeats equal results, so no operator needs an id that depends on partitioning.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Bytes of text that numpy kernels work on at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder, so that a lost executor costs no lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tracelight-checkpoint-"))  # all in one process
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already materialised) with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, text, _k, _h`` with null texts empty, and the columns named in ``more``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        text.alias("text"),
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("_k"),
        F.xxhash64("doc_id", text).alias("_h"),
        *more,
    )


# -- Arrow helpers ---------------------------------------------------------------------------------


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of rows whose bytes add up to about ``most``."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


# -- polynomial hashes -----------------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0], m = 1, 1
        while m < size:
            k = min(m, size - m)
            np.multiply(have[:k], np.uint64(pow(base, m, 1 << 64)), out=have[m : m + k])
            m *= 2
        if size <= 1 << 23:
            _POWERS[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of the first i values."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def inverse_powers(n: int) -> np.ndarray:
    return powers(pow(BASE, -1, 1 << 64), n)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k values, independent of where the window stands."""
    return mix((prefix[k:] - prefix[:-k]) * inverse_powers(len(prefix) - k))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least value of each window of w values, by prefix and suffix minima of blocks."""
    n = len(a)
    x = np.full(-(-n // w) * w, np.iinfo(a.dtype).max, a.dtype)
    x[:n] = a
    x = x.reshape(-1, w)
    before = np.minimum.accumulate(x, axis=1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start .. start + count - 1 of each pair, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


# -- ranks without a global sort -------------------------------------------------------------------


#: Rows that one task numbers at a time, about.
RANK_ROWS = 500_000
#: Rows of a bucket that are never too many, however small its share.
BUCKET_ROWS = 1_000


def gapless_rank(df: DataFrame, by: list[str], spread: Column, buckets: int, name: str) -> DataFrame:
    """Number the rows of each ``by`` from 0 without gaps.

    Rows are dealt by ``spread`` to ``buckets`` buckets, or more if they would hold over ``RANK_ROWS``
    rows; rows are numbered inside a bucket and shifted by the sizes of the buckets before, so that no
    task holds all rows of a ``by`` value.  Where a bucket comes to hold far more than its share, repeated
    rows of which there are more than such a share go to all buckets.  ``df`` is used more than once and must be materialised.  The table of sizes has a
    row for each value of ``by`` and bucket.
    """
    from pyspark.sql import Window

    rows = df.count()
    buckets = max(buckets, rows // RANK_ROWS)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)

    def shifted(dealt: DataFrame) -> DataFrame:
        sizes = dealt.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
        return cut(sizes.select(*by, "_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s")))

    dealt = df.withColumn("_b", F.pmod(spread, F.lit(buckets)).cast("int"))
    shifts = shifted(dealt)
    count, largest = shifts.agg(F.count(F.lit(1)), F.max("_n")).first()
    if (largest or 0) > max(BUCKET_ROWS, 4 * (rows // buckets)):
        dealt = df.withColumn("_spread", spread)
        hot = cut(dealt.groupBy("_spread").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(16, rows // buckets)).select("_spread", F.lit(True).alias("_hot")))
        dealt = dealt.join(F.broadcast(hot), "_spread", "left")  # no more rows than buckets
        salted = F.when(F.col("_hot"), F.xxhash64("_spread", F.monotonically_increasing_id())).otherwise(F.col("_spread"))
        dealt = cut(dealt.withColumn("_b", F.pmod(salted, F.lit(buckets)).cast("int")).drop("_spread", "_hot"))
        shifts = shifted(dealt)
        count = shifts.count()
    shifts = shifts.drop("_n")
    inside = Window.partitionBy(*by, "_b").orderBy(*[c for c in df.columns if c not in by])
    numbered = dealt.withColumn("_r", F.row_number().over(inside) - 1)
    return (
        numbered.join(F.broadcast(shifts) if count <= BROADCAST_ROWS else shifts, [*by, "_b"])
        .withColumn(name, (F.col("_s") + F.col("_r")).cast("long"))
        .drop("_b", "_s", "_r")
    )
