import zlib

import numpy as np

from tracelight.llm.common import table
from tracelight.llm.langid import identify, language_model
from tracelight.llm.quality import features, keep_good, quality_model, quality_scores

SCHEMA = "doc_id long, text string, lang string, score int, held_out string"
held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def odd_rows():
    texts = ["", None, "123 !!", "x", "日本語", "word " * 30_000, "the and"]
    return [(i, t, None, 1, "h") for i, t in enumerate(texts)] + [(0, "", None, 1, "h"), (None, "the", None, None, None)]


def test_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_model(docs)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = identify(docs, model).collect()
    assert len(got) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got if r.held_out]) >= 0.98
    assert (model.weights == 0).mean() > 0.3
    odd = {r.doc_id: r for r in identify(spark.createDataFrame(odd_rows(), SCHEMA), model).collect()}
    assert [odd[i].lang_pred for i in range(3)] == ["und"] * 3 and odd[3].lang_pred in model.languages and odd[None].held_out is False
    # nothing to learn from
    assert {r.lang_pred for r in identify(spark.createDataFrame(odd_rows(), SCHEMA)).collect()} == {"und"}
    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = quality_model(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_scores(docs, model).collect()
    told = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in told]) >= 0.95
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    odd = quality_scores(spark.createDataFrame(odd_rows(), SCHEMA), model).collect()
    assert len(odd) == len(odd_rows()) and len({r.score for r in odd if r.doc_id in (0, 1)}) == 1
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.7 * len(got) < kept.count() < len(got)
    assert keep_good(docs, labels.limit(0)).count() == len(got)  # no labels, nothing rejected


def test_features_do_not_cross_texts():
    texts = [b"ab cd cd", b"", b"cd", b"abcdefg", b"xy"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    together = features(data, offsets)
    for i, t in enumerate(texts):
        for (a, bounds), (b, _) in zip(together, features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))):
            assert sorted(a[bounds[i] : bounds[i + 1]].tolist()) == sorted(b.tolist())
