import pathlib
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tracelight.llm.common import table
from tracelight.llm.packing import piece_lengths


def _stage(spark, name, stage, docs, sf_dir):
    return spark.read.parquet(corpus_pipeline._write(spark, stage(spark, docs, sf_dir), name))


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(_stage(spark, name, stage, seen[-1], sf_dir))
        if name != "packing":
            assert seen[-1].columns == columns
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen[:5]]
    # only whole documents go in the first two stages
    for before, after in zip(texts, texts[1:3]):
        assert after and all(before[i] == t for i, t in after.items())
    grams = {}
    for i, t in texts[1].items():
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = lambda a, b: 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b])
    kept, gone = set(texts[2]), set(texts[1]) - set(texts[2])
    assert gone and all(any(near(i, j) for j in texts[1] if j != i) for i in gone)
    assert not [1 for i in kept for j in kept if i < j and grams[i] and near(i, j)]
    # repeated passages
    starts = Counter(t[k : k + 200] for t in map(str.encode, texts[2].values()) for k in range(len(t) - 199))
    for i, t in texts[2].items():
        raw, flags = t.encode(), bytearray(len(t.encode()))
        for k in range(len(raw) - 199):
            if starts[raw[k : k + 200]] > 1:
                flags[k : k + 200] = b"\1" * 200
        assert texts[3][i] == bytes(b for b, f in zip(raw, flags) if not f).decode("utf-8", "ignore")
    assert not [t for t in texts[4].values() if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]", t)]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter(r.doc_id for r in seen[5].collect())
    assert pieces == {i: len(piece_lengths(len(own.encode(t, add_special_tokens=False).ids) + 1)) for i, t in texts[4].items()}


def test_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = _stage(spark, name, stage, docs, sf_dir)
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    held = set(folder.glob("pipeline-*"))
    got = corpus_pipeline.run(spark, sf_dir)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(got) == key(docs) != []
    assert [p.name.split("-")[1] for p in set(folder.glob("pipeline-*")) - held] == ["personal_data"]
