"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1-, 2- and 3-grams of the lower-cased code points, hashed into ``BUCKETS``, weighted
1 + log(count) times the inverse document frequency of the sample, and scaled to length one.  Weights
are trained by follow-the-regularised-leader with an elastic net, which leaves most of them zero; a
temperature fitted on a part of the sample calibrates the probabilities.

The sample is about ``PER_LANGUAGE`` rows of each language that occurs outside the held-out fold, with
texts of up to ``LONGEST`` characters, or longer ones where a language has no others.  A text that is
null or has no letter (Unicode categories L) is ``und`` with score 0, and so is
every text if there is nothing to learn from.  Predictions depend on the text alone.  Repeated rows get
equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import held_out
from tracelight.llm.training import labelled_sample

BUCKETS = 1 << 15
PER_LANGUAGE = 800
LONGEST = 20_000
EPOCHS = 3

_LETTER = regex.compile(r"\p{L}")


def grams(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the character n-grams of a text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = [c * np.uint32(0x9E3779B1)]
    if len(c) > 1:
        parts.append((c[:-1] * np.uint32(0x85EBCA77) + c[1:]) * np.uint32(0xC2B2AE3D))
    if len(c) > 2:
        parts.append(((c[:-2] * np.uint32(0x27D4EB2F) + c[1:-1]) * np.uint32(0x165667B1) + c[2:]) * np.uint32(0x9E3779B1))
    h = np.concatenate(parts)
    h = (h ^ (h >> np.uint32(15))) % np.uint32(buckets)
    if len(h) < buckets // 16:  # the same, without a table of all buckets for a short text
        return np.unique(h, return_counts=True)
    counts = np.bincount(h, minlength=buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = grams(text, len(self.idf))
        v = (1 + np.log(n)) * self.idf[at]
        size = np.linalg.norm(v)
        return at, v / size if size else v

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and probability of each text; all texts take part in one sparse product."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        told = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        if not told:
            return out
        parts = [grams(texts[i], len(self.idf)) for i in told]
        sizes = np.array([len(at) for at, _ in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at, n = (np.concatenate(x) for x in zip(*parts))
        v = (1 + np.log(n)) * self.idf[at]
        norm = np.sqrt(np.add.reduceat(v * v, starts))
        z = np.stack([np.add.reduceat(v * self.weights[at, k], starts) for k in range(len(self.languages))], 1)
        z = (z / np.where(norm > 0, norm, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        best = p.argmax(axis=1)
        for i, k, x in zip(told, best.tolist(), (p.max(axis=1) / p.sum(axis=1)).tolist()):
            out[i] = self.languages[k], x
        return out


def _ftrl(rows: list, labels: np.ndarray, buckets: int, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.05, epochs=EPOCHS, seed=9):
    """Weights by FTRL-proximal; rows are (buckets, values), the last bucket of each the bias."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            w = weights(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = v[:, None] * p[None, :]
            m = n[at]
            z[at] += g - (np.sqrt(m + g * g) - np.sqrt(m)) / alpha * w
            n[at] = m + g * g
    return weights(np.arange(buckets + 1))


def train(texts: list[str], labels: list[str], buckets: int = BUCKETS) -> LanguageModel:
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros(buckets), np.zeros((buckets, 0)), np.zeros(0), 1.0)
    seen = np.zeros(buckets)
    raw = [grams(t, buckets) for t in texts]
    for at, _ in raw:
        seen[at] += 1
    model = LanguageModel(languages, np.log((1 + len(texts)) / (1 + seen)) + 1, np.zeros((buckets, len(languages))), np.zeros(len(languages)), 1.0)
    y = np.array([languages.index(x) for x in labels])
    rows = []
    for t in texts:
        at, v = model.vector(t)
        rows.append((np.append(at, buckets), np.append(v, 1.0)))
    kept = np.arange(len(rows)) % 5 != 0 if len(rows) >= 50 else np.ones(len(rows), bool)
    w = _ftrl([r for r, k in zip(rows, kept) if k], y[kept], buckets, len(languages))
    model.weights, model.bias = w[:-1], w[-1]
    rest = np.flatnonzero(~kept) if not kept.all() else np.arange(len(rows))
    logits = np.array([v @ w[at] for at, v in (rows[i] for i in rest)])

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(rest)), y[rest]]).mean())

    model.temperature = float(min(np.geomspace(0.05, 5, 61), key=loss))
    return model


def language_model(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> LanguageModel:
    rows = docs.where(~held_out()).select("doc_id", "text", F.col("lang").alias("label"))
    texts, labels, _ = labelled_sample(rows, per_language, longest)
    return train(texts, labels)


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``."""
    model = model or language_model(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in (whole.slice(i, 128) for whole in batches for i in range(0, len(whole), 128)):
            out = own.predict(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
