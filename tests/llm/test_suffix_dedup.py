import hashlib
import random

import numpy as np
from collections import Counter

from tracelight.llm.suffix_dedup import Suffixes, suffix_dedup

SCHEMA = "doc_id long, text string, m long, s1 string, lo int"


def brute(rows, length):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    starts = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc_id, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(4)]
    texts = [text(120) for _ in range(12)] + ["", None, "short", "x" * 199, "y" * 200, "y" * 201, "z" * 1500, "ab" * 400]
    texts += [text(20) + shared[i % 4] + text(30) + shared[(i + 1) % 4][: 150 + 7 * i] for i in range(14)]
    texts += [texts[0], texts[0], texts[1][:230] + text(9), text(9) + texts[1][-240:], "Te " * 300 + "Ta " * 90, "Te " * 80 + texts[2]]
    return [(i, t, i, "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], 0, "s", 1), (None, texts[3], 0, None, None), (None, None, None, None, None)]


def test_against_brute_force(spark):
    rows = corpus()
    want = brute(rows, 200)
    for limits in ({}, {"sort_bytes": 1000}, {"part": 3, "sort_bytes": 1}, {"part": 1, "widths": (41, 3, 1)}):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = sorted((tuple(r) for r in suffix_dedup(docs, **limits).collect()), key=str)
        assert got == want


def test_passage_of_every_document(spark):
    """A passage that stands in all texts, with other bytes around it or nearly the same ones, is dealt again."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefg ") for _ in range(330))
    words = ["".join(rng.choice("hijklm") for _ in range(rng.randint(1, 3))) for _ in range(4)]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 9) if rng.random() < 0.3 else "") for _ in range(n))
    texts = [text(rng.randint(0, 40)) + passage[rng.randint(0, 9) :] + text(rng.randint(0, 40)) for _ in range(120)]
    texts += texts[:30] + [passage] * 20 + ["ab" * rng.randint(100, 300) + text(5) for _ in range(12)]
    rows = [(i, t, i, "s", 1) for i, t in enumerate(texts)]
    want = brute(rows, 200)
    for limits in ({}, {"part": 20}, {"part": 4, "widths": (64, 8, 1)}):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
        assert sorted((tuple(r) for r in suffix_dedup(docs, **limits).collect()), key=str) == want


def test_long_text(spark):
    """A text of a megabyte of one letter, and one of noise that holds a piece of itself."""
    rng = np.random.default_rng(2)
    noise = "".join(map(chr, rng.integers(97, 123, 900_000)))
    rows = [(1, "q" * 1_000_000, 0, "", 0), (2, noise + noise[5000:5400], 0, "", 0)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1_000_000, 1_000_000, 1), 2: (900_400, 800, 2)}


def test_empty(spark):
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    items = rng.permutation(800)
    got = Suffixes(data, 100).sort(items, np.zeros(800, int))
    texts = [data[i : i + 100].tobytes() for i in got]
    assert texts == sorted(texts)
