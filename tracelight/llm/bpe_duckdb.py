"""Byte-level BPE with the merging done by recursive DuckDB queries, one connection for each task.

A text is split by the vocabulary's pattern.  The different words of a batch that are not known yet
become token-position rows (word, position, token), one byte each.  A recursive query joins
neighbouring rows with the merge table and contracts the leftmost pair of least rank in every word,
until no word has a pair.

A word of over ``PIECE`` bytes is cut into pieces that the query contracts as words of their own, and the
seams are settled by the same query: a row of tokens is what the whole word contracts to exactly if
every two neighbours, contracted alone, stay these two (a contraction that crosses a seam would be the
first to do so in those two alone as well).  Where two do not, the tokens around the seam are contracted
again as one stretch, a wider one each time, until all seams hold.  The work grows with the length.

Decoding takes the ids of the documents, not their words: they are aggregated in the order of positions,
a list for each document, and the bytes of a list's tokens are put together.  What is no id gives no bytes.
DuckDB stays in memory and writes no files.

Words are remembered in two generations: when the younger one is full, it takes the place of the older one,
and words that are met again come back from there without a query.

Null texts are empty; an empty text has no ids; repeated rows are encoded each by itself; an empty
table gives no rows; other columns than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import string_buffers

VOCABULARY = "byte_bpe_50k.tiktoken"
PIECE = 64
#: Rows that one recursive query may come to hold, bytes of words remembered by a worker, bytes of
#: documents whose words are looked up together (a longer text is taken alone), and ids decoded together.
QUERY_ROWS = 3_000_000
KNOWN_BYTES = 1 << 27
SLICE_BYTES = 1 << 23
DECODE_IDS = 2_000_000

# a word that has no pair left is passed on once more, as done; only those rows leave the query
_TAIL = "SELECT wid, pos, tok FROM step WHERE done"

LEFTMOST = f"""
WITH RECURSIVE step(wid, pos, tok, done) AS (
  SELECT wid, pos, tok, false FROM start
  UNION ALL
  (WITH near AS (
     SELECT wid, pos, tok, lead(tok) OVER w AS nxt, lead(wid) OVER w AS nxt_wid, lag(pos) OVER w AS prv
     FROM step WHERE NOT done WINDOW w AS (ORDER BY pos)),
   best AS (
     SELECT near.wid, min((m.made << 32) | near.pos) AS b
     FROM near JOIN merges m ON m.pair = (near.tok::BIGINT << 24) | near.nxt WHERE near.wid = near.nxt_wid GROUP BY near.wid)
   SELECT near.wid, pos, CASE WHEN pos = (b & 4294967295) THEN (b >> 32)::INTEGER ELSE tok END, b IS NULL
   FROM near LEFT JOIN best USING (wid)
   WHERE b IS NULL OR prv IS NULL OR prv <> (b & 4294967295)))
{_TAIL}"""

DECODE = "SELECT wid, list(tok ORDER BY pos) AS toks FROM ids GROUP BY wid"


@functools.cache
def _ranks(vocabulary: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """A vocabulary in a DuckDB connection, and the words it has met."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import duckdb
        import public_tokenizers
        import regex

        self.ranks = _ranks(vocabulary)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, str] = {}  # ids of a word, as text
        self.older: dict[str, str] = {}
        self.size = 0
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        made = [(a, b, r) for word, r in self.ranks.items() for k in range(1, len(word)) if (a := self.ranks.get(word[:k])) is not None and (b := self.ranks.get(word[k:])) is not None]
        pair = pa.array([(a << 24) | b for a, b, _ in made], pa.int64())
        self.db.register("made", pa.table({"pair": pair, "made": pa.array([r for *_, r in made], pa.int64())}))
        self.db.execute("CREATE TABLE merges AS FROM made")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.token = {i: w for w, i in self.ranks.items()}
        self.numeral = pa.array([str(i) for i in range(max(self.token) + 1)])
        self.spelling = pa.array([self.token.get(i, b"") for i in range(max(self.token) + 2)], pa.large_binary())  # the last is for what is no id

    def contracted(self, words: list[bytes]) -> pa.ListArray:
        """Ids of each word, in one recursive query; every word has at least one byte."""
        sizes = np.array([len(w) for w in words])
        wid = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(sizes.sum(), dtype=np.int32)  # one line of positions for all words
        self.db.register("start", pa.table({"wid": wid, "pos": pos, "tok": self.byte[np.frombuffer(b"".join(words), np.uint8)]}))
        wid, pos, tok = (c.to_numpy() for c in self.db.sql(LEFTMOST).to_arrow_table().columns)
        ends = np.cumsum(np.bincount(wid, minlength=len(words)), dtype=np.int32)
        return pa.ListArray.from_arrays(np.concatenate([np.zeros(1, np.int32), ends]), tok[np.argsort(pos, kind="stable")])  # positions rise from word to word

    def parts(self, words: list[bytes]) -> Iterator[pa.ListArray]:
        """Ids of each word, in as many queries as keep each in its bounds."""
        a = 0
        while a < len(words):
            b, rows = a, 0
            while b < len(words) and (b == a or rows < QUERY_ROWS):
                rows += len(words[b]) * (len(words[b]) + 1) // 2  # rows of all rounds, at most
                b += 1
            yield self.contracted(words[a:b])
            a = b

    def merged(self, words: list[bytes]) -> list[list[int]]:
        return [ids for part in self.parts(words) for ids in part.to_pylist()]

    def numerals_of(self, words: list[bytes]) -> Iterator[str]:
        """Ids of each word as text."""
        for part in self.parts(words):
            yield from pc.binary_join(pa.ListArray.from_arrays(part.offsets, self.numeral.take(part.values)), " ").to_pylist()

    def _stays(self, pairs: set[tuple[int, int]], held: dict[tuple[int, int], bool]) -> None:
        """Adds to ``held`` whether two neighbouring tokens stay these two when they are contracted alone."""
        new = sorted(pairs.difference(held))
        for (a, b), ids in zip(new, self.merged([self.token[a] + self.token[b] for a, b in new])):
            held[a, b] = ids == [a, b]

    def long_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of any length, by pieces and seams."""
        pieces = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
        different = sorted(set(pieces))
        ids_of = dict(zip(different, self.merged(different)))
        held: dict[tuple[int, int], bool] = {}
        out: list[list[int]] = []
        seams: list[list[int]] = []  # by word, tokens before each seam that is open, rising
        for w in words:
            ids, open_ = [], []
            for i in range(0, len(w), PIECE):
                if i:
                    open_.append(len(ids))
                ids += ids_of[w[i : i + PIECE]]
            out.append(ids)
            seams.append(open_)
        reach = 4
        while any(seams):
            self._stays({(ids[x - 1], ids[x]) for ids, open_ in zip(out, seams) for x in open_}, held)
            bad = [[x for x in open_ if not held[ids[x - 1], ids[x]]] for ids, open_ in zip(out, seams)]
            jobs: list[tuple[int, int, int]] = []  # word, and the tokens from .. to of a stretch
            for k, xs in enumerate(bad):
                for x in xs:
                    low, high = max(0, x - reach), min(len(out[k]), x + reach)
                    if jobs and jobs[-1][0] == k and low <= jobs[-1][2]:
                        jobs[-1] = (k, jobs[-1][1], high)
                    else:
                        jobs.append((k, low, high))
            stretches = [b"".join(self.token[t] for t in out[k][low:high]) for k, low, high in jobs]
            # a stretch is longer than a piece only where wider and wider ones did not settle
            anew = self.merged(stretches)
            seams = [[] for _ in words]
            parts: dict[int, list[tuple[int, int, list[int]]]] = {}
            for (k, low, high), ids in zip(jobs, anew):
                parts.setdefault(k, []).append((low, high, ids))
            for k, changes in parts.items():
                new, at = [], 0
                for low, high, ids in changes:
                    new += out[k][at:low]
                    if low:
                        seams[k].append(len(new))
                    new += ids
                    if high < len(out[k]):
                        seams[k].append(len(new))
                    at = high
                out[k] = new + out[k][at:]
            reach *= 2
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids."""
        out: list[bytes] = []
        a = 0
        while a < len(ids):
            b, n = a, 0
            while b < len(ids) and (b == a or n + len(ids[b]) <= DECODE_IDS):
                n += len(ids[b])
                b += 1
            sizes = np.array([len(x) for x in ids[a:b]], np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *ids[a:b]])
            none = len(self.spelling) - 1
            flat = np.where((flat >= 0) & (flat < none), flat, none).astype(np.int32)
            self.db.register("ids", pa.table({"wid": np.repeat(np.arange(b - a, dtype=np.int32), sizes), "pos": np.arange(len(flat), dtype=np.int32), "tok": flat}))
            found = {}
            for part in self.db.sql(DECODE).to_arrow_table().to_batches():
                lists = part.column(1)
                data, starts = string_buffers(self.spelling.take(lists.values))  # the bytes of a list stand one after the other
                ends = starts[lists.offsets.to_numpy()].tolist()
                found.update(zip(part.column(0).to_pylist(), [data[x:y].tobytes() for x, y in zip(ends, ends[1:])]))
            out += [found.get(i, b"") for i in range(b - a)]
            a = b
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        raw = [w.encode() for w in words]
        short, long = [], []
        for w, b in zip(words, raw):
            rank = self.ranks.get(b)
            if rank is not None:
                self.known[w] = str(rank)
            else:
                (long if len(b) > PIECE else short).append((w, b))
        self.known.update(zip([w for w, _ in short], self.numerals_of([b for _, b in short])))
        for (w, _), x in zip(long, self.long_words([b for _, b in long])):
            self.known[w] = " ".join(map(str, x))

    def spelled(self, texts: list[str]) -> list[str]:
        """For each text, its ids as text."""
        split = [self.pattern.findall(t) for t in texts]
        every = set()
        for ws in split:
            every.update(ws)
        if self.size > KNOWN_BYTES // 2:
            self.older, self.known, self.size = self.known, {}, 0
        new = every.difference(self.known)
        self.size += sum([150 + 4 * len(w) for w in new])  # with what a dictionary takes for each
        again = new.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        self.learn(sorted(new - again))
        return [" ".join(map(self.known.__getitem__, ws)) for ws in split]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.spelled([text])[0].split()]


def _slices(batch: pa.RecordBatch, sizes: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` in order, whose ``sizes`` add up to ``most`` at most, or one row."""
    a = n = 0
    for i, size in enumerate(sizes):
        if i > a and n + size > most:
            yield batch.slice(a, i - a)
            a, n = i, 0
        n += size
    if a < len(sizes):
        yield batch.slice(a)


def _numbers(spelled: str) -> np.ndarray:
    return np.fromstring(spelled, np.int64, sep=" ") if spelled else np.zeros(0, np.int64)


@functools.cache
def shared(vocabulary: str) -> Bpe:
    """One vocabulary for all tasks of a Python worker."""
    return Bpe(vocabulary)


def _encode(vocabulary: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared(vocabulary)
        for whole in batches:
            for batch in _slices(whole, pc.binary_length(whole.column("text")).to_pylist(), SLICE_BYTES):
                every = own.spelled(batch.column("text").to_pylist())
                ids = [_numbers(x) for x in every]
                decoded = own.decode(ids)
                number = [len(x) for x in ids]
                ids_sha = [hashlib.sha256(x.encode()).hexdigest() for x in every]
                decoded_sha = [hashlib.sha256(x).hexdigest() for x in decoded]
                columns = [batch.column("doc_id"), pa.array(number, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = columns + [pa.array(ids, pa.list_(pa.int64())), pa.array(decoded, pa.binary())], names + ["ids", "decoded"]
                yield pa.record_batch(columns, names)

    return run


def bpe_round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids, decoded``) for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * with_ids
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_encode(vocabulary, with_ids), schema)


def bpe_decode(df: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key, decoded`` for lists of ids; a null list gives null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared(vocabulary)
        for whole in batches:
            for batch in _slices(whole, [x or 0 for x in pc.list_value_length(whole.column(1)).to_pylist()], DECODE_IDS):
                lists = batch.column(1).to_pylist()
                out = own.decode([np.array(x or [], np.int64) for x in lists])
                yield pa.record_batch([batch.column(0), pa.array([None if x is None else b for x, b in zip(lists, out)], pa.binary())], [key, "decoded"])

    return df.select(key, F.col(ids).cast("array<long>").alias(ids)).mapInArrow(run, f"`{key}` {kind}, decoded binary")
