import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracelight.llm.common import table
from tracelight.llm.packing import pack, piece_lengths

SCHEMA = "doc_id long, text string, length int, start string"


def brute(rows, ordinary=False):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    if ordinary:
        own.encode_special_tokens = True
    out = []
    for doc_id, text, *_ in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for n in piece_lengths(len(ids)):
            out.append((doc_id, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
    return out


def check(got, rows, ordinary=False):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(brute(rows, ordinary), key=key)
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))  # one piece each
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024 for r in got)
    ordered = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert ordered == sorted(ordered, reverse=True)


def test_small_cases(spark):
    texts = ["", None, "a", "Hello, wörld!  \n\n it's <|endoftext|> 123", "word " * 5000, "x" * 3000, "日本語   ​ ok", "\x00\x01"]
    rows = [(i, t, 1, "s") for i, t in enumerate(texts)] + [(0, "", 1, None), (None, "a b", None, None), (2, "a", 1, "s")]
    texts += ["<|endoftext|>", " <|endoftext|><|endoftext|>\n x<|endoftext|", "a <|endoftext|> b" * 300]
    rows += [(20 + i, t, 1, "s") for i, t in enumerate(texts[-3:])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check(pack(docs).collect(), rows)
    check(pack(docs, added=False).collect(), rows, ordinary=True)
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    check(pack(docs).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_lengths():
    assert piece_lengths(2 * 1024 + 5) == [1024, 1024, 4, 1] and piece_lengths(1) == [1]
