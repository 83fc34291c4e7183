"""Document quality by supervised subword embeddings.

Words (what stands between white space), pairs of neighbouring words, and the n-grams of 3, 4 and 5
characters of each word with its two borders are hashed into ``BUCKETS`` learned vectors.  A document is
their mean, and a softmax layer over it gives the probability of each label.  Training is plain
stochastic gradient descent in numpy on a sample of about ``PER_LABEL`` rows of each label with texts of
up to ``LONGEST`` characters, none from the held-out fold.  A last step fits slope and offset of the
logit on a part of the sample, weighted as the labels occur in all rows.

Since the layer is linear, a bucket's vector counts only by its product with the difference of the two
output rows; scoring looks up one number for each feature.

Null texts are empty; a text without features scores by the bias.  Without labels every score is 1.
Scores depend on the text alone.  Repeated rows get equal results; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import chunks, held_out, inverse_powers, mix, prefix_hash, string_buffers, window_hash
from tracelight.llm.training import labelled_sample

BUCKETS = 1 << 17
WIDTH = 16
GRAMS = (3, 4, 5)
PER_LABEL = 1500
LONGEST = 20_000
EPOCHS = 4
RATE = 60.0

_SPACES = np.array([*range(9, 14), 32, 133, 160, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x3000], np.uint32)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, a space before and after each, white space as spaces; and their offsets."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    sizes = np.diff(before)
    out = np.full(len(points) + 2 * len(sizes), 32, np.uint32)
    at = np.arange(len(points)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)
    out[at] = np.where(np.isin(points, _SPACES), np.uint32(32), points)
    return out, before + 2 * np.arange(len(before))


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, pairs of words and each n-gram length: (bucket of each feature, features before each text)."""
    points, offsets = code_points(data, offsets)
    if not len(points):
        return [(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))] * (2 + len(GRAMS))
    prefix = prefix_hash(points)
    gap = points == 32
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1  # each text begins and ends with a space
    starts, ends = edge[::2], edge[1::2]
    words = mix((prefix[ends] - prefix[starts]) * inverse_powers(len(prefix))[starts] + np.uint64(1))
    bounds = np.searchsorted(starts, offsets)
    mask = np.uint64(buckets - 1)
    out = [(words & mask, bounds)]
    same = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs = np.flatnonzero(same[1:] == same[:-1])
    out.append((mix(words[pairs] * np.uint64(3) + words[pairs + 1]) & mask, np.searchsorted(pairs, bounds)))
    spaces = np.concatenate([[0], np.cumsum(gap)])
    for n in GRAMS:
        if len(points) < n:
            out.append((np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)))
            continue
        last = len(points) - n + 1
        at = np.flatnonzero(spaces[n - 1 : n - 1 + last] == spaces[1 : 1 + last])  # no space inside
        out.append((window_hash(prefix, n)[at] & mask, np.searchsorted(at, offsets)))
    return out


@dataclass
class QualityModel:
    table: np.ndarray  # logit of each bucket
    offset: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, number = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        for at, bounds in features(data, offsets, len(self.table)):
            summed = np.zeros(len(at) + 1)
            np.cumsum(self.table[at], out=summed[1:])
            total += summed[bounds[1:]] - summed[bounds[:-1]]
            number += np.diff(bounds)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(number, 1) + self.offset, -500, 500)))


def train(texts: list[str], labels: list[int], counts: dict, buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> QualityModel:
    if not texts or len(set(labels)) < 2:
        return QualityModel(np.zeros(buckets), 500.0 if not texts or labels[0] else -500.0)
    rng = np.random.default_rng(seed)
    rows = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        ids = np.concatenate([a for a, _ in features(raw, np.array([0, len(raw)]), buckets)]).astype(np.int64)
        at, n = np.unique(ids, return_counts=True)
        rows.append((at, n / max(1, len(ids))))
    y = np.array(labels)
    vectors = rng.uniform(-1 / width, 1 / width, (buckets, width))
    layer, bias = np.zeros((width, 2)), np.zeros(2)
    part = np.arange(len(rows)) % 5 == 0 if len(rows) >= 100 else np.zeros(len(rows), bool)
    order = np.flatnonzero(~part)
    steps, step = epochs * len(order), 0
    for _ in range(epochs):
        for i in rng.permutation(order):
            at, share = rows[i]
            mean = share @ vectors[at]
            s = mean @ layer + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            r = rate * (1 - step / steps)
            step += 1
            back = layer @ p
            layer -= 0.1 * r * np.outer(mean, p)
            bias -= 0.01 * r * p
            vectors[at] -= r * share[:, None] * back[None, :]
    table = vectors @ (layer[:, 1] - layer[:, 0])
    rest = np.flatnonzero(part) if part.any() else np.arange(len(rows))
    x = np.array([rows[i][1] @ table[rows[i][0]] for i in rest])
    weight = np.array([counts[v] / max(1, int((y[rest] == v).sum())) for v in y[rest].tolist()])
    a, b = _fit_logit(x, y[rest], weight / weight.sum())
    return QualityModel(table * a, b)


def _fit_logit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a little ridge."""
    scale = x.std() or 1.0
    design = np.stack([(x - x.mean()) / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    ridge = np.diag([1e-4, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - y)) + ridge @ w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        change = np.linalg.solve(hess, grad)
        w = w - np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-9:
            break
    slope = w[0] / scale
    return float(slope), float(w[1] - slope * x.mean())


def quality_model(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, longest: int = LONGEST) -> QualityModel:
    """Learns from the labelled rows outside the held-out fold."""
    own = labels.where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)").dropDuplicates(["doc_id"])
    rows = docs.where(~held_out()).select("doc_id", "text")
    return train(*labelled_sample(rows, per_label, longest, own))


def quality_scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "held_out", "score", "predicted"]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), "boolean", "double", "int"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            data, offsets = string_buffers(batch.column(2))
            scores = np.concatenate([np.zeros(0), *(own.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets))])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names)

    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, in all columns of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(quality_model(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, len(whole), 500)):
            data, offsets = string_buffers(batch.column(at).fill_null(""))
            scores = np.concatenate([np.zeros(0), *(own.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets))])
            yield batch.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(run, docs.schema)
