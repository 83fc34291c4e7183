import hashlib
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

from tracelight.llm import bpe_duckdb
from tracelight.llm.bpe_duckdb import LEFTMOST, VOCABULARY, Bpe, _ranks, bpe_decode, bpe_round_trip, shared
from tracelight.llm.common import table

SCHEMA = "doc_id long, text string, ids string, n_tokens int"


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(VOCABULARY), special_tokens={})


def check(got, texts):
    own = library()
    want = []
    for doc_id, text in texts:
        ids = own.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)


def test_small_cases(spark):
    rng = random.Random(6)
    texts = ["", None, "a", "aaaa" * 700, "ab" * 900, "it's  <|endoftext|> \n\n 12345", "日本語 ünïcödé 😀" * 9, "\x00\xa0 ", "w" * 65, "abcab" * 40]
    texts += ["".join(rng.choice("abcdé ,.1\n") for _ in range(400)) for _ in range(30)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, "", None, None), (None, "a", None, None), (2, "a", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = bpe_round_trip(docs, with_ids=True)
    check(got.collect(), [r[:2] for r in rows])
    back = {r.doc_id: r.decoded for r in bpe_decode(got).collect()}
    assert all((back[i] or b"") == (t or "").encode() for i, t in enumerate(texts))
    assert bpe_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    check(bpe_round_trip(docs).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_pieces_and_seams_agree_with_one_query():
    own = shared(VOCABULARY)
    rng = random.Random(1)
    for letters in ("aabcde", "ab", "ACGT", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 260))).encode() for _ in range(60)]
        assert own.long_words(words) == own.merged(words)


def test_very_long_words():
    own, other = shared(VOCABULARY), library()
    rng = random.Random(4)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "q", "aA"):
        word = "".join(rng.choice(letters) for _ in range(200_000))
        began = time.time()
        ids = own.encode(word)
        assert time.time() - began < 60 and own.decode([np.array(ids)]) == [word.encode()]
        if len(letters) > 1:
            assert ids == other.encode_ordinary(word)


def test_decoding_is_of_the_ids():
    assert shared(VOCABULARY).decode([np.array([64, 65]), np.array([], int), np.array([64])]) == [b"ab", b"", b"a"]
    assert shared(VOCABULARY).decode([np.array([64, (1 << 32) + 64, -1, 10**6, 65])]) == [b"ab"]


def test_only_final_rows_leave_the_query():
    own = Bpe()
    words = [b" unhappily", b"zqxj", b"tokenisation", b"a"]
    own.contracted(words)
    assert own.db.sql(LEFTMOST).to_arrow_table().num_rows == sum(map(len, own.merged(words)))


def test_words_met_again_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(bpe_duckdb, "KNOWN_BYTES", 20_000)
    own, other, learned = Bpe(), library(), Counter()
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda words: (learned.update(words), learn(words)))
    rng = random.Random(2)
    for _ in range(30):
        text = "qwzx vbnmk " + " ".join("".join(rng.choices("bcdfgjkqxz", k=7)) for _ in range(12))
        assert own.spelled([text]) == [" ".join(map(str, other.encode_ordinary(text)))]
    assert own.older and learned["qwzx"] == learned[" vbnmk"] == 1
