"""Similarity join on word five-grams by MinHash banding.

A text is lower-cased and read as words: runs of ASCII letters and digits and of all other non-ASCII
characters.  Its n-grams are its runs of five words; a text of one to four words has one n-gram, all
its words.  Two texts are linked if the Jaccard similarity of their n-gram sets is at least 0.8.

Bands and rows are chosen for the target recall at the threshold (``choose_bands``).  Documents with
equal words are folded into a class first, so copies meet as a count.  Classes are dealt by band hash:

* buckets of up to ``SMALL`` classes give candidate pairs, a bounded number for each member;
* larger buckets are compared in blocks of about ``BLOCK`` classes and ``BLOCK_BYTES`` bytes against
  blocks.  Buckets that share members are joined into a group (a component of the bucket graph) where
  comparing the whole group takes no more pairs than comparing its buckets one by one, as with many
  copies of one text, which share most buckets; buckets that are merely chained are compared by
  themselves, and a pair is counted in the first large bucket that both have.  A block pair gives link
  *counts* and a spanning forest of its links, never the pairs, so what it puts out is linear in what
  it reads.

Every candidate is verified on full n-gram sets, and no candidate is dropped.

Null and word-less texts have no n-grams and link with nothing: they are classes of their own, named
by their own id.  Repeated rows are documents of their own, linked with one another.  An empty table
gives no rows.  Only ``doc_id`` and ``text`` are read.  A null id counts as the greatest when the
smallest id of a class is sought, and stays null in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import BASE, chunks, cut, inverse_powers, keyed, mix, powers, prefix_hash, small_side, string_buffers
from tracelight.llm.graph import connected_components

N = 5
THRESHOLD = 0.8
RECALL = 0.99999
HASHES = 160
SMALL = 16
BLOCK = 256
BLOCK_BYTES = 1 << 24


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows a band, and so the fewest false candidates, that reach ``recall``."""
    best = None
    for rows in range(1, hashes + 1):
        missed = 1 - threshold**rows
        bands = 1 if missed == 0 else int(np.ceil(np.log(1 - recall) / np.log(missed)))
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


# -- n-grams of many texts at once -----------------------------------------------------------------

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STEP = 0xD6E8FEB86659FD93


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case, each followed by a line feed."""
    texts = [(x or "").lower().encode() + b"\n" for x in column.to_pylist()]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text)."""
    is_word = np.zeros(len(data) + 2, bool)
    is_word[1:-1] = _WORD[data]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1])
    first, last = edge[::2], edge[1::2]
    prefix = prefix_hash(data)
    words = mix((prefix[last] - prefix[first]) * inverse_powers(len(data) + 1)[first])
    return words, np.searchsorted(first, offsets)


def ngrams(words: np.ndarray, bounds: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram, n-grams before each text)."""
    counts = np.diff(bounds)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    total = np.zeros(len(grams) + 1, np.int64)
    np.cumsum(grams, out=total[1:])
    factors = powers(_STEP, n + 1)
    inside = np.arange(total[-1]) - np.repeat(total[:-1], grams) + np.repeat(bounds[:-1], grams)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    short = np.repeat(counts < n, grams)
    size = np.repeat(np.minimum(counts, n), grams)
    out = np.zeros(total[-1], np.uint64)
    for i in range(n):
        term = padded[inside + i] * factors[i]
        out += np.where(size > i, term, np.uint64(0)) if short.any() else term
    return mix(out), total


def class_hashes(words: np.ndarray, bounds: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of the sequence of words of each text; 0 without words."""
    n = len(words)
    words = mix(words + np.uint64(salt)) if salt else words
    summed = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(BASE, n), out=summed[1:])
    shift = inverse_powers(n + 1)[bounds[:-1]]
    counts = np.diff(bounds)
    out = mix((summed[bounds[1:]] - summed[bounds[:-1]]) * shift + counts.astype(np.uint64) * np.uint64(_STEP))
    return np.where(counts > 0, np.where(out == 0, np.uint64(1), out), np.uint64(0))


def _constants(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 2**32, hashes, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 2**32, hashes, dtype=np.uint64).astype(np.uint32)


def band_hashes(grams: np.ndarray, total: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of ``bands`` hashes for each text; texts without n-grams have zeros."""
    texts = len(total) - 1
    least = np.zeros((bands * rows, texts), np.uint32)
    full = np.flatnonzero(np.diff(total) > 0)
    if len(full):
        starts = total[:-1][full]
        low, high = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
        scale, shift = _constants(bands * rows)
        for i in range(bands * rows):
            # two halves under two odd factors: the order differs from hash to hash
            h = (low * scale[i] + shift[i]) ^ (high * scale[-1 - i])
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            least[i, full] = np.minimum.reduceat(h, starts)
    out = np.zeros((texts, bands), np.uint64)
    for b in range(bands):
        h = np.full(texts, b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(BASE) + least[b * rows + r].astype(np.uint64))
        out[:, b] = h
    return out


def gram_sets(texts: list[str], n: int = N) -> list[np.ndarray]:
    """The sorted set of n-gram hashes of each text."""
    data, offsets = lowered(pa.array(texts, pa.string()))
    grams, total = ngrams(*word_hashes(data, offsets), n)
    return [np.unique(grams[total[i] : total[i + 1]]) for i in range(len(texts))]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 0.0


# -- blocks ----------------------------------------------------------------------------------------


def linked_in_blocks(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of links between two lists of sets, by counting common members of both."""
    sizes_l, sizes_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    row_l, row_r = np.repeat(np.arange(len(left)), sizes_l), np.repeat(np.arange(len(right)), sizes_r)
    shared = np.intersect1d(flat_l, flat_r)
    keep_l, keep_r = np.isin(flat_l, shared), np.isin(flat_r, shared)
    both = np.zeros((len(left), len(right)), np.float32)
    col_l, col_r = np.searchsorted(shared, flat_l[keep_l]), np.searchsorted(shared, flat_r[keep_r])
    row_l, row_r = row_l[keep_l], row_r[keep_r]
    order_l, order_r = np.argsort(col_l, kind="stable"), np.argsort(col_r, kind="stable")
    col_l, row_l, col_r, row_r = col_l[order_l], row_l[order_l], col_r[order_r], row_r[order_r]
    width = 4096
    for c in range(0, len(shared), width):  # a dense slice of the shared n-grams at a time
        a, b = np.searchsorted(col_l, [c, c + width])
        x, y = np.searchsorted(col_r, [c, c + width])
        one, two = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        one[row_l[a:b], col_l[a:b] - c] = 1
        two[row_r[x:y], col_r[x:y] - c] = 1
        both += one @ two.T
    both = both.astype(np.float64)
    either = sizes_l[:, None] + sizes_r[None, :] - both
    return (both / np.maximum(either, 1) >= threshold) & (either > 0)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the edges (a, b)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


# -- Spark -----------------------------------------------------------------------------------------


def _signatures(bands: int, rows: int, n: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = string_buffers(batch.column("text"))
            for a, b in chunks(at):
                data, offsets = lowered(batch.column("text").slice(a, b - a))
                words, bounds = word_hashes(data, offsets)
                names, second = class_hashes(words, bounds, 2 * salt), class_hashes(words, bounds, 2 * salt + 1)
                hashes = band_hashes(*ngrams(words, bounds, n), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, bands, dtype=np.int32)), pa.array(hashes.view(np.int64).ravel()))
                none = pa.array(names.view(np.int64), mask=names == 0)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), batch.column("_k").slice(a, b - a), batch.column("_h").slice(a, b - a), none, pa.array(second.view(np.int64)), lists], ["doc_id", "_k", "_h", "c", "c2", "bands"])

    return run


def _verify(threshold: float, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 200):
                part = batch.slice(a, 200)
                left, right = gram_sets(part.column("ta").to_pylist(), n), gram_sets(part.column("tb").to_pylist(), n)
                good = pa.array([i for i, (x, y) in enumerate(zip(left, right)) if jaccard(x, y) >= threshold], pa.int64())
                yield pa.record_batch([part.column("a").take(good), part.column("b").take(good)], ["a", "b"])

    return run


def _first_shared(a: list[tuple[int, ...]], b: list[tuple[int, ...]], x: np.ndarray, y: np.ndarray, g: int) -> np.ndarray:
    """Whether g is the least of the buckets that both classes of each pair have."""
    sets_a, sets_b = [frozenset(v) for v in a], [frozenset(v) for v in b]
    return np.array([min(sets_a[i] & sets_b[j]) == g for i, j in zip(x.tolist(), y.tolist())], bool)


def _block_links(threshold: float, n: int):
    """Rows of one (group, i, j) lie together: counts of links by class, and forest edges.

    Where a class names its large buckets, the group is one of them.
    """

    def settle(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        g, i, j = key
        left = [r for r in rows if r[0] == i]
        right = left if i == j else [r for r in rows if r[0] == j]
        if not left or not right:
            return pa.record_batch([pa.array([], pa.int64())] * 3, ["a", "b", "n"])
        sets = gram_sets([r[3] for r in left], n)
        links = linked_in_blocks(sets, sets if i == j else gram_sets([r[3] for r in right], n), threshold)
        if i == j:
            np.fill_diagonal(links, False)
        name_l, name_r = np.array([r[1] for r in left]), np.array([r[1] for r in right])
        size_l, size_r = np.array([r[2] for r in left]), np.array([r[2] for r in right])
        x, y = np.nonzero(links)
        if left[0][4] is not None:
            first = _first_shared([r[4] for r in left], [r[4] for r in right], x, y, g)
            links[x[~first], y[~first]] = False
            x, y = x[first], y[first]
        edges = forest(name_l[x], name_r[y])
        counts = [(c, None, k) for c, k in zip(name_l.tolist(), (links @ size_r).tolist()) if k]
        if i != j:
            counts += [(c, None, k) for c, k in zip(name_r.tolist(), (links.T @ size_l).tolist()) if k]
        out = counts + [(a, b, None) for a, b in edges]
        return pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for g, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "i", "j", "x", "c", "size", "text", "own"))):
                if (g, i, j) != key:
                    if rows:
                        yield settle(key, rows)
                    key, rows = (g, i, j), []
                rows.append(row)
        if rows:
            yield settle(key, rows)

    return run


def in_blocks(members: DataFrame, block: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Deal the members (g, c, text, ...) of each group to pairs of blocks: adds i, j and the own block x."""
    counts = cut(members.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("text")).alias("_bytes")))
    blocks = F.ceil(F.greatest(F.col("k") / F.lit(float(block)), F.col("_bytes") / F.lit(float(block_bytes)), F.lit(1.0))).cast("int")
    dealt = members.join(counts, "g").withColumn("_n", blocks).withColumn("x", F.pmod(F.xxhash64("c"), F.col("_n")).cast("int"))
    spread = dealt.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return spread.withColumn("i", F.least("x", "_y")).withColumn("j", F.greatest("x", "_y")).drop("_y", "_n", "k", "_bytes")


def jaccard_links(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """``doc_id, _k, _h, n_links, class_id, kept, worded`` for each row; kept marks one document of each class.

    ``worded`` is false for texts without words, which are in no class.  Rows that agree in id and text are all kept or all not kept.
    """
    bands, rows = choose_bands(threshold, recall)
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "_k", "_h"))
    for salt in range(16):
        signed = cut(keyed(docs).mapInArrow(_signatures(bands, rows, n, salt), f"doc_id {kind}, _k long, _h long, c long, c2 long, bands array<long>"))
        worded = signed.where("c is not null")
        classes = cut(worded.groupBy("c").agg(F.count(F.lit(1)).alias("size"), first.alias("first"), F.first("bands").alias("bands"), (F.min("c2") != F.max("c2")).alias("mixed")))
        if classes.where("mixed").isEmpty():  # no two texts under one number, by a second hash
            break
    banded = classes.select("c", F.explode("bands").alias("band"))
    buckets = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lead")).where("n > 1"))
    members = cut(banded.join(buckets, "band"))
    large = members.where(F.col("n") > small)
    hot = connected_components(large.select(F.col("c").alias("a"), F.col("lead").alias("b")))
    hot = cut(hot.select(F.col("node").alias("c"), F.col("root").alias("g")))
    # pairs of the group as a whole against pairs of its buckets one by one
    whole = hot.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("k"))
    apiece = large.join(hot, "c").groupBy("g").agg(F.sum(F.col("n").cast("double")).alias("s"))
    chained = cut(whole.join(apiece, "g").where("k * k > s").select("g", F.lit(True).alias("chained")))
    hot = cut(hot.join(small_side(chained), "g", "left").select("c", "g", F.coalesce("chained", F.lit(False)).alias("chained")))
    own = large.join(hot.where("chained").select("c"), "c").groupBy("c").agg(F.sort_array(F.collect_set("band")).alias("own"))  # at most one for each band
    hot = cut(hot.join(own, "c", "left"))
    few = members.where(F.col("n") <= small).select("band", "c")
    pairs = few.select("band", F.col("c").alias("a")).join(few.select("band", F.col("c").alias("b")), "band").where("a < b").select("a", "b").distinct()
    sides = [hot.select(F.col("c").alias(s), F.col("g").alias(f"g{s}"), F.col("own").alias(f"o{s}")) for s in "ab"]
    apart = pairs.join(sides[0], "a", "left").join(sides[1], "b", "left").where("ga is null or gb is null or ga <> gb or not coalesce(arrays_overlap(oa, ob), true)")
    pairs = cut(apart.select("a", "b"))
    # texts of the classes that take part, one for each class
    needed = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).union(hot.select("c")).distinct()
    wanted = classes.join(needed, "c").select("c", "size", F.col("first._k").alias("_k"), F.col("first._h").alias("_h"))
    # the slim side is hashed, so that no text is sorted
    texts = keyed(docs).select("text", "_k", "_h").join(wanted.hint("shuffle_hash"), ["_k", "_h"]).dropDuplicates(["c"]).select("c", "size", "text")
    texts = cut(texts)
    first_, second = (texts.select(F.col("c").alias(s), F.col("text").alias(f"t{s}")) for s in "ab")
    links = cut(pairs.join(first_, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(threshold, n), "a long, b long"))
    by_bucket = hot.where("chained").select(F.explode("own").alias("g"), "c", "own")
    by_group = hot.where("not chained").select("g", "c", F.lit(None).cast("array<long>").alias("own"))
    grouped = in_blocks(by_group.union(by_bucket).join(texts, "c"), block)
    dense = cut(grouped.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").select("g", "i", "j", "x", "c", "size", "text", "own").mapInArrow(_block_links(threshold, n), "a long, b long, n long"))
    sizes = classes.select(F.col("c").alias("b"), F.col("size").alias("n"))
    both = links.union(links.select("b", "a"))
    counted = both.join(sizes, "b").select("a", "n").union(dense.where("n is not null").select("a", "n"))
    counted = counted.groupBy("a").agg(F.sum("n").alias("more")).withColumnRenamed("a", "c")
    roots = connected_components(links.union(dense.where("n is null").select("a", "b")))
    roots = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = cut(roots.groupBy("root").agg(F.min("first").alias("kept_first")))
    facts = cut(
        roots.join(least, "root").join(counted, "c", "left")
        .select("c", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "kept_first")
    )
    own = signed.drop("bands", "c2").join(facts, "c", "left")
    return own.select(
        "doc_id", "_k", "_h",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("kept_first.id")).alias("class_id"),
        F.coalesce((F.col("kept_first._k") == F.col("_k")) & (F.col("kept_first._h") == F.col("_h")), F.lit(True)).alias("kept"),
        F.col("c").isNotNull().alias("worded"),
    )


def ngram_jaccard(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: the smallest id of its class, and how many documents it is linked with."""
    return jaccard_links(docs, **options).drop("_k", "_h", "worded")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class of linked documents, in all columns of ``docs``.

    Texts without words are linked with nothing, so all their rows stay, even those that agree.
    """
    columns = docs.columns
    marks = jaccard_links(docs, **options).where("kept").groupBy("_k", "_h").agg((F.bool_or("worded") & (F.count(F.lit(1)) > 1)).alias("repeated"))
    marks = cut(marks)
    own = keyed(docs, F.struct(*[docs[c] for c in columns]).alias("_row")).drop("doc_id", "text")
    kept = own.join(marks.hint("shuffle_hash"), ["_k", "_h"])
    if marks.where("repeated").limit(1).count():  # rows that agree in id and text: one of them
        kept = kept.where("not repeated").unionByName(kept.where("repeated").dropDuplicates(["_k", "_h"]))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in columns])
