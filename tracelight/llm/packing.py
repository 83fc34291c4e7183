"""Packing by power-of-two decomposition.

Each document is cut into pieces of binary length, longest first: pieces of ``LENGTH`` tokens and then
one for each bit of the rest.  Pieces of equal length share a bucket and each is a sequence of its own,
so no sequence crosses documents and none is padded.  Sequences are numbered bucket by bucket.

Token ids are those of the byte-level vocabulary in ``VOCABULARY`` (a tokenizers file, whose merges are
ranked by id) as the tokenizers library encodes by default, without template tokens: the string of an
added token of the file, such as ``<|endoftext|>``, is that token's id.  ``added=False`` reads such
strings as ordinary text instead.  Id ``END`` follows once for each document.  A null text is empty and has the end id
alone; repeated rows are packed each by itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.llm.common import cut, gapless_rank, keyed, small_side

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 1024
END = 0
BUCKETS = 64


def _letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Encoder:
    """The ids that the tokenizers library gives for a file with its defaults, at several times its speed.

    The strings of the file's added tokens are found first, leftmost and longest, and become their ids;
    what stands between them is ordinary text.
    """

    ordinary: Callable[[str], list[int]]
    added: dict[str, int]

    def __post_init__(self):
        names = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None

    def encode(self, text: str) -> list[int]:
        if not any(x in text for x in self.added):
            return self.ordinary(text)
        out: list[int] = []
        for i, part in enumerate(self.split(text)):
            out += [self.added[part]] if i % 2 else self.ordinary(part)
        return out


@functools.cache
def encoder(vocabulary: str, added: bool = True) -> Encoder:
    """The encoder of a tokenizers file; without ``added``, strings of added tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        file = json.load(f)
    special = {x["content"]: x["id"] for x in file["added_tokens"]}
    odd = [x["content"] for x in file["added_tokens"] if x["lstrip"] or x["rstrip"] or x["single_word"]]
    if added and odd:
        raise ValueError(f"added tokens that take in their surroundings are not supported: {odd}")
    letters = _letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in special}
    own = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Encoder(own.encode_ordinary, special if added else {})


def piece_lengths(tokens: int, length: int = LENGTH) -> list[int]:
    """Binary pieces of a document, longest first."""
    full, rest = divmod(tokens, length)
    return [length] * full + [1 << i for i in reversed(range(length.bit_length() - 1)) if rest >> i & 1]


def _pieces(vocabulary: str, length: int, end: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, added)
        for whole in batches:
            for a in range(0, len(whole), 256):
                batch = whole.slice(a, 256)
                at, start, size, crc, total = [], [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    ids = np.array(own.encode(text) + [end], "<u4")
                    s = 0
                    for n in piece_lengths(len(ids), length):
                        at.append(i)
                        start.append(s)
                        size.append(n)
                        crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                        total.append(len(ids))
                        s += n
                at = pa.array(at, pa.int64())
                numbers = [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
                yield pa.record_batch([batch.column("doc_id").take(at), batch.column("_h").take(at), *numbers], ["doc_id", "_h", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end: int = END, added: bool = True) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row for each piece.

    ``length`` is a power of two.  Without ``added``, the strings of added tokens are ordinary text.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the length of a sequence must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut_up = keyed(docs).select("doc_id", "_h", "text").mapInArrow(_pieces(vocabulary, length, end, added), f"doc_id {kind}, _h long, start long, length long, ids_crc32 long, doc_tokens long")
    cut_up = cut(cut_up)
    ranked = gapless_rank(cut_up, ["length"], F.xxhash64("_h", "start"), BUCKETS, "_rank")
    sizes = cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("_n"))  # one row for each power of two
    before = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut(sizes.select("length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s")))
    numbered = ranked.join(small_side(shifts), "length")
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_s") + F.col("_rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
