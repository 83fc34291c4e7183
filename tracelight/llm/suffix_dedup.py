"""Removal of repeated passages by a hash-compared suffix sort.

Every ``length``-byte string that starts at two or more places of the corpus is found, and all bytes
it covers are removed.  The work goes in four steps.

1. *Anchors.*  A window of ``length`` bytes is named by the least hash of its ``ANCHOR``-byte strings.
   Equal windows have equal names, so only windows whose name occurs twice can repeat.  Names are
   counted over the whole corpus; about one position in eighty makes a row.
2. *Segments.*  Neighbouring windows of one repeated name form a segment.  Segments are shuffled by
   name.  Of equal segments a task sends one, so copies do not meet as pairs.
3. *Suffix sort.*  The suffixes that start at the windows of the segments of one name are sorted by
   mergesort.  Two suffixes are compared by the length of their common extension, which a binary
   search over prefix polynomial hashes finds in a logarithm of its length.  Neighbours in the sorted
   order that agree in ``length`` bytes by hash are compared byte by byte.
4. *Removal.*  Repeated windows go back to their documents, whose remaining bytes are put together.

A name that stands at more than ``PART`` places is dealt again before its segments are sent.  Equal
windows hold the anchor at the same offset, so a segment is sliced by that offset, ``WIDTHS[0]`` windows
to a slice, and a slice is named by the bytes that all windows of its offsets have in common.  Slices
whose new name still has more than ``PART`` rows are sliced finer, down to single windows, where rows of
one name are equal.  Slices of every width go through the same sort.

Null texts are empty; texts shorter than ``length`` keep every byte; rows with equal id and text are
documents of their own and repeat each other; an empty table gives no rows.  Only ``doc_id`` and
``text`` are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tracelight.llm.common import (
    chunks,
    cut,
    inverse_powers,
    keyed,
    mix,
    powers,
    BASE,
    prefix_hash,
    ranges,
    sliding_min,
    small_side,
    string_buffers,
    window_hash,
)

LENGTH = 200
ANCHOR = 40
#: Windows in a slice of a name that is dealt again, level by level.
WIDTHS = (64, 16, 4, 1)
#: Places of one name that are sorted together.
PART = 4000
#: Most names that are dealt again which are broadcast, eight bytes each.
HOT_NAMES = 200_000
#: Bytes of segments that one sort takes from several names.
SORT_BYTES = 1 << 20
#: Bytes of segments that a task remembers as sent; beyond it forgets them and may send them again.
SEEN_BYTES = 1 << 25

_TOP = np.uint64(2**64 - 1)


def _windows(data: np.ndarray, offsets: np.ndarray, length: int):
    """Anchor hashes, the least of each window, and which windows lie inside one text."""
    anchors = window_hash(prefix_hash(data), ANCHOR)
    least = sliding_min(anchors, length - ANCHOR + 1)
    inside = np.zeros(len(least) + 1, np.int32)
    sizes = np.diff(offsets)
    long = sizes >= length
    inside[offsets[:-1][long]] += 1
    inside[offsets[1:][long] - length + 1] -= 1
    return anchors, least, np.cumsum(inside[:-1]) > 0


def anchor_names(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(name, row) for each place that is the least anchor of some window."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    anchors, least, inside = _windows(data, offsets, length)
    span = length - ANCHOR + 1
    # a place is chosen if its hash equals the greatest of the minima of the windows around it
    flipped = np.full(len(anchors) + span - 1, _TOP)
    flipped[span - 1 : span - 1 + len(least)] = np.where(inside, ~least, _TOP)
    greatest = ~sliding_min(flipped, span)
    places = np.flatnonzero((greatest == anchors) & (greatest != 0))
    return anchors[places], np.searchsorted(offsets, places, side="right") - 1


def segments(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, length: int = LENGTH):
    """(name, row, start in row, windows, start in data) for runs of windows with one wanted name."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), none, none, none, none
    _, least, inside = _windows(data, offsets, length)
    row_start = np.zeros(len(least), bool)
    row_start[offsets[:-1][offsets[:-1] < len(least)]] = True
    change = row_start.copy()
    change[1:] |= (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    change[0] = True
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(least)))
    keep = inside[first] & np.isin(least[first], wanted)
    first, count = first[keep], count[keep]
    row = np.searchsorted(offsets, first, side="right") - 1
    return least[first], row, first - offsets[row], count, first


def slices(anchors: np.ndarray, prefix: np.ndarray, name: np.ndarray, at: np.ndarray, count: np.ndarray, width: int, length: int = LENGTH):
    """(segment, start in data, windows, slice name) for the slices of segments.

    A segment has ``count`` windows from ``at`` on whose least anchor is ``name``.  Windows of a slice
    have that anchor at the same place and at offsets of one multiple of ``width``.
    """
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    span = length - ANCHOR + 1
    wide = count + span - 1
    hits = np.flatnonzero(anchors[ranges(at, wide)] == np.repeat(name, wide))
    starts = ranges(at, count)
    segment = np.repeat(np.arange(len(at)), count)
    flat = starts + np.repeat(np.cumsum(wide) - wide - at, count)  # where a start stands in the line of all anchors
    offset = hits[np.searchsorted(hits, flat)] - flat
    place, part = starts + offset, offset // width
    change = np.ones(len(starts), bool)
    change[1:] = (segment[1:] != segment[:-1]) | (place[1:] != place[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(change)
    windows = np.diff(np.append(first, len(starts)))
    place, part = place[first], part[first]
    low = place - part * width
    high = place - np.minimum((part + 1) * width - 1, span - 1) + length
    shared = (prefix[high] - prefix[low]) * inverse_powers(len(prefix))[low]
    return segment[first], starts[first], windows, mix(mix(shared) + part.astype(np.uint64))


# -- the sort --------------------------------------------------------------------------------------


class Suffixes:
    """Suffixes of one buffer, compared in their first ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix = prefix_hash(data)
        self.whole = window_hash(self.prefix, length)
        self.head = np.zeros(len(data), np.uint64)  # the first eight bytes, as a number
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        for i in range(8):
            self.head = (self.head << np.uint64(8)) | padded[i : i + len(data)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes that differ within ``length`` bytes."""
        left, right = np.minimum(a, b), np.maximum(a, b)
        shift = powers(BASE, int((right - left).max()) + 1)[right - left]
        at_left, at_right = self.prefix[left], self.prefix[right]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length, np.int64)
        while True:
            middle = (low + high) >> 1
            open_ = high - low > 1
            if not open_.any():
                return low
            same = (self.prefix[left + middle] - at_left) * shift == self.prefix[right + middle] - at_right
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle, high)

    def order(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair: by the whole hash, the first bytes, or what follows the common extension."""
        out = np.zeros(len(a), np.int8)
        differ = np.flatnonzero(self.whole[a] != self.whole[b])
        if len(differ):
            x, y = a[differ], b[differ]
            told = np.where(self.head[x] < self.head[y], -1, 1)
            tied = np.flatnonzero(self.head[x] == self.head[y])
            if len(tied):
                x, y = x[tied], y[tied]
                n = self.common(x, y)
                told[tied] = np.where(self.data[x + n] < self.data[y + n], -1, 1)
            out[differ] = told
        return out

    def sort(self, items: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Mergesort the items of each group (groups lie together); all runs of a level merge at once."""
        items = items.copy()
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(first, len(items)))
        start, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            slot = np.flatnonzero(size > width)
            s, inner = start[slot], slot - start[slot]
            run = inner // width
            other = s + (run ^ 1) * width
            last = s + size[slot]
            low, high = np.minimum(other, last), np.minimum(other + width, last)
            begin = low.copy()
            right_run = (run & 1) == 1
            own = items[slot]
            live = np.flatnonzero(low < high)
            while len(live):
                middle = (low[live] + high[live]) >> 1
                told = self.order(items[middle], own[live])
                before = (told < 0) | ((told == 0) & right_run[live])
                low[live] = np.where(before, middle + 1, low[live])
                high[live] = np.where(before, high[live], middle)
                live = live[low[live] < high[live]]
            items[s + (run >> 1) * 2 * width + (inner - run * width) + (low - begin)] = own
            width *= 2
        return items

    def equal_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether ``length`` bytes agree, by comparing the bytes themselves."""
        rows = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        out = np.zeros(len(a), bool)
        for i in range(0, len(a), 4096):
            out[i : i + 4096] = (rows[a[i : i + 4096]] == rows[b[i : i + 4096]]).all(axis=1)
        return out


def repeated_windows(data: np.ndarray, offsets: np.ndarray, names: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window start of each segment, in order: does the window start elsewhere in the table?

    The windows of a segment all have the least anchor ``names[segment]``; equal windows have it at
    the same place, counted from their start, so only such windows are sorted together.
    """
    sizes = np.diff(offsets)
    starts = ranges(offsets[:-1], sizes - length + 1)
    segment = np.repeat(np.arange(len(names)), sizes - length + 1)
    suffixes = Suffixes(data, length)
    anchors = window_hash(suffixes.prefix, ANCHOR)
    owner = np.repeat(np.arange(len(names)), sizes)[: len(anchors)]
    at = np.flatnonzero(anchors == names[owner])
    where = at[np.searchsorted(at, starts)] - starts
    _, number = np.unique(names, return_inverse=True)
    group = number[segment] * length + where
    order = np.argsort(group, kind="stable")
    group = group[order]
    first = np.append(True, group[1:] != group[:-1])
    alone = first & np.append(first[1:], True)
    order, group = order[~alone], group[~alone]
    found = np.zeros(len(starts), bool)
    if not len(order):
        return found
    window_of = np.zeros(len(data), np.int64)
    window_of[starts] = np.arange(len(starts))
    ordered = suffixes.sort(starts[order], group)
    close = np.flatnonzero((group[1:] == group[:-1]) & (suffixes.whole[ordered[1:]] == suffixes.whole[ordered[:-1]]))
    same = suffixes.equal_bytes(ordered[close], ordered[close + 1])
    if not same.all():  # a collision: compare the windows of the groups it touches in full
        for g in np.unique(group[close[~same]]):
            members = ordered[group == g]
            seen: dict[bytes, list[int]] = {}
            for x in members.tolist():
                seen.setdefault(data[x : x + length].tobytes(), []).append(x)
            for xs in seen.values():
                if len(xs) > 1:
                    found[window_of[xs]] = True
    close = close[same]
    found[window_of[ordered[close]]] = True
    found[window_of[ordered[close + 1]]] = True
    return found


# -- Spark -----------------------------------------------------------------------------------------


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _prepare(length: int):
    """Texts as zstd frames in ``z``, and the distinct names of each with the number of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, len(whole), 1000)):
            text = batch.column("text")
            data, offsets = string_buffers(text)
            lists, sizes = [], np.zeros(len(batch), np.int64)
            for a, b in chunks(offsets):
                names, row = anchor_names(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
                order = np.lexsort((names, row))
                names, row = names[order], row[order] + a
                first = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (row[1:] != row[:-1]))) if len(names) else np.zeros(0, np.int64)
                lists.append((names[first], np.diff(np.append(first, len(names)))))
                np.add.at(sizes, row[first], 1)
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            names, places = (np.concatenate(x) for x in zip(*lists)) if lists else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            new = {
                "text": ("z", pa.array([press.compress(x.as_buffer()) for x in text.cast(pa.binary())], pa.binary())),
                "_m": ("_m", pa.ListArray.from_arrays(ends, _signed(names))),
                "_p": ("_p", pa.ListArray.from_arrays(ends, pa.array(places.astype(np.int32)))),
            }
            columns = [new.get(c, (c, batch.column(c) if c in batch.schema.names else None)) for c in [*batch.schema.names, "_m", "_p"]]
            yield pa.record_batch([x for _, x in columns], [c for c, _ in columns])

    return run


def _loosened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of pressed texts."""
    loose = zstandard.ZstdDecompressor()
    texts = [loose.decompress(x.as_buffer()) for x in column]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


#: A segment or slice: what it is shuffled by, its least anchor, its bytes, and where its windows stand.
_SENT = pa.schema([("key", pa.int64()), ("m", pa.int64()), ("seg", pa.binary()), ("_k", pa.int64()), ("_h", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])
_SENT_DDL = "key long, m long, seg binary, _k long, _h long, start long, windows long"
_HITS = pa.schema([("_k", pa.int64()), ("_h", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


class _Sender:
    """Rows of one task.

    A segment is sent with its bytes when it is met first.  What is met again, byte for byte, is repeated
    for certain, and so is what was met first: such places need no sort and travel without bytes,
    neighbours as one row and under a scattered key, so that a passage that every document has does not
    heap up under its name.
    """

    def __init__(self):
        self.seen: dict[bytes, tuple | None] = {}  # the first place, until it is told that it is repeated
        self.size = 0

    def rows(self, pieces: Iterator[tuple]) -> Iterator[tuple]:
        """``pieces``: key, name, bytes, _k, _h, start and windows; those of a document in order."""
        known: tuple | None = None
        for piece in pieces:
            seg, place = piece[2], piece[3:]
            if seg not in self.seen:
                if self.size > SEEN_BYTES:
                    self.seen, self.size = {}, 0
                self.seen[seg] = place
                self.size += len(seg)
                yield piece
                continue
            if first := self.seen[seg]:
                self.seen[seg] = None
                yield first[1] + first[2], None, None, *first
            k, h, start, windows = place
            if known and known[:2] == (k, h) and known[2] <= start <= known[2] + known[3]:
                known = k, h, known[2], max(known[3], start + windows - known[2])
                continue
            if known:
                yield known[1] + known[2], None, None, *known
            known = place
        if known:
            yield known[1] + known[2], None, None, *known


def _scattered(row: tuple) -> tuple:
    return ((row[0] + 2**63) % 2**64 - 2**63, *row[1:])


def _send(length: int, width: int = 0):
    """Segments of the names ``ms`` of each document; slices of them if ``width`` is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender()
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, len(whole), 1000)):
            data, offsets = _loosened(batch.column("z"))
            k, h = batch.column("_k").to_numpy(), batch.column("_h").to_numpy()
            lists = batch.column("ms")
            for a, b in chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                wanted = np.unique(lists.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
                name, row, start, count, at = segments(part, offsets[a : b + 1] - offsets[a], wanted, length)
                key = name
                if width:  # a document comes once for each of its names then, and gives the segments of that name
                    asked = {(i, m) for i, ms in enumerate(lists.slice(a, b - a).to_pylist()) for m in ms}
                    keep = np.array([x in asked for x in zip(row.tolist(), name.view(np.int64).tolist())], bool)
                    name, row, start, count, at = name[keep], row[keep], start[keep], count[keep], at[keep]
                    prefix = prefix_hash(part)
                    own, begin, windows, key = slices(window_hash(prefix, ANCHOR), prefix, name, at, count, width, length)
                    name, row, start, count, at = name[own], row[own], start[own] + begin - at[own], windows, begin
                whole = part.tobytes()
                pieces = (whole[x : x + n + length - 1] for x, n in zip(at.tolist(), count.tolist()))
                rows = sender.rows(zip(key.view(np.int64).tolist(), name.view(np.int64).tolist(), pieces, k[row + a].tolist(), h[row + a].tolist(), start.tolist(), count.tolist()))
                while some := [_scattered(x) for x in itertools.islice(rows, 10_000)]:
                    yield _as_batch(some, _SENT)

    return run


def _send_finer(length: int, width: int):
    """Slices of slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender()
        for batch in (whole.slice(i, 2000) for whole in batches for i in range(0, len(whole), 2000)):
            if not len(batch):
                continue
            data, offsets = string_buffers(batch.column("seg"))
            prefix = prefix_hash(data)
            name = batch.column("m").to_numpy().view(np.uint64)
            own, begin, windows, key = slices(window_hash(prefix, ANCHOR), prefix, name, offsets[:-1], np.diff(offsets) - length + 1, width, length)
            k, h, start = (batch.column(c).to_pylist() for c in ("_k", "_h", "start"))
            whole, ends = data.tobytes(), offsets.tolist()
            pieces = (
                (to, m, whole[x : x + n + length - 1], k[i], h[i], start[i] + x - ends[i], n)
                for i, x, n, to, m in zip(own.tolist(), begin.tolist(), windows.tolist(), key.view(np.int64).tolist(), name[own].view(np.int64).tolist())
            )
            rows = sender.rows(pieces)
            while some := [_scattered(x) for x in itertools.islice(rows, 10_000)]:
                yield _as_batch(some, _SENT)

    return run


def _runs(found: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], found.view(np.int8), [0]])))
    return edge[::2].tolist(), edge[1::2].tolist()


def _sort_segments(length: int, sort_bytes: int):
    """Rows arrive by key.  Gives the repeated windows of each place, as starts lo .. hi - 1 of its document."""

    def settle(group: list[tuple[bytes, tuple]]) -> Iterator[tuple]:
        data = np.frombuffer(b"".join(seg for seg, _ in group), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(seg) for seg, _ in group])]).astype(np.int64)
        found = repeated_windows(data, offsets, np.array([m for _, (m, *_) in group], np.int64).view(np.uint64), length)
        at = 0
        for seg, (_, place) in group:
            windows = len(seg) - length + 1
            if place:
                k, h, start = place
                for lo, hi in zip(*_runs(found[at : at + windows])):
                    yield k, h, start + lo, start + hi
            at += windows

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ready: list[tuple[bytes, tuple]] = []  # of whole keys: bytes, name, and the place if it is not told yet
        group: dict[bytes, tuple] = {}  # of the key that is being read
        size, name = 0, None
        for batch in batches:
            for key, m, seg, k, h, start, windows in zip(*(batch.column(c).to_pylist() for c in _SENT.names)):
                if seg is None:  # known to be repeated
                    yield k, h, start, start + windows
                    continue
                if key != name:
                    ready += group.items()
                    if size >= sort_bytes:
                        yield from settle(ready)
                        ready, size = [], 0
                    name, group = key, {}
                held = group.get(seg)
                if held is None:
                    group[seg] = m, (k, h, start)
                    size += len(seg)
                    continue
                yield k, h, start, start + windows  # equal in all bytes: repeated throughout
                if held[1]:
                    x, y, z = held[1]
                    yield x, y, z, z + windows
                    group[seg] = m, None
        ready += group.items()
        if ready:
            yield from settle(ready)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches)
        while part := list(itertools.islice(rows, 10_000)):
            yield _as_batch(part, _HITS)

    return run


def _left_over(batch: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, int, int]]:
    """(bytes left, bytes removed, removed runs) of each row with z and hits."""
    data, offsets = _loosened(batch.column("z"))
    hits = batch.column("hits")
    for i in range(len(batch)):
        text = data[offsets[i] : offsets[i + 1]]
        if not hits[i].is_valid or not len(hits[i]):
            yield text.tobytes(), 0, 0
            continue
        step = np.zeros(len(text) + 1, np.int32)
        lo, hi = (x.to_numpy() for x in hits[i].values.flatten())
        np.add.at(step, lo, 1)
        np.add.at(step, hi + length - 1, -1)
        gone = np.cumsum(step[:-1]) > 0
        yield text[~gone].tobytes(), int(gone.sum()), len(_runs(gone)[0])


def _digested(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, len(whole), 500)):
            rows = [(len(left) + gone, gone, spans, hashlib.sha256(left).hexdigest()) for left, gone, spans in _left_over(batch, length)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def prepared(docs: DataFrame, length: int = LENGTH, *more: Column) -> DataFrame:
    """``doc_id, z, _k, _h``, the columns in ``more``, and the names ``_m`` of each text with their places ``_p``; materialised."""
    rows = keyed(docs, *more)
    fields = [StructField("z", BinaryType()) if f.name == "text" else f for f in rows.schema.fields]
    schema = StructType([*fields, StructField("_m", ArrayType(LongType())), StructField("_p", ArrayType(IntegerType()))])
    return cut(rows.mapInArrow(_prepare(length), schema))


def repeated_ranges(rows: DataFrame, length: int = LENGTH, sort_bytes: int = SORT_BYTES, part: int = PART, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``_k, _h, hits`` by document: starts ``lo .. hi - 1`` of each hit are those of repeated windows.

    ``rows`` is ``prepared(docs)``.
    """
    named = rows.select("_k", "_h", F.explode(F.arrays_zip("_m", "_p")).alias("x")).select("_k", "_h", F.col("x._m").alias("m"), F.col("x._p").alias("p"))
    counted = cut(named.groupBy("m").agg(F.sum("p").alias("n")).where("n > 1"))
    wanted = cut(named.join(counted.where(F.col("n") <= part), "m").groupBy("_k", "_h").agg(F.collect_set("m").alias("ms")))
    texts = rows.select("_k", "_h", "z")

    def sorted_out(sent: DataFrame) -> DataFrame:
        return sent.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_segments(length, sort_bytes), "_k long, _h long, lo long, hi long")

    # joins of texts hash the slim side, so that no text is sorted
    hits = sorted_out(texts.join(wanted.hint("shuffle_hash"), ["_k", "_h"]).mapInArrow(_send(length), _SENT_DDL))
    hot = cut(counted.where(F.col("n") > part).select("m"))
    if not hot.isEmpty():
        if hot.limit(HOT_NAMES + 1).count() <= HOT_NAMES:  # no text is shuffled for names that all tasks know
            many = rows.select("_k", "_h", "z", F.explode("_m").alias("m")).join(F.broadcast(hot), "m").select("_k", "_h", "z", F.array("m").alias("ms"))
        else:
            many = texts.join(named.join(hot, "m").groupBy("_k", "_h").agg(F.collect_set("m").alias("ms")).hint("shuffle_hash"), ["_k", "_h"])
        sent = cut(many.mapInArrow(_send(length, widths[0]), _SENT_DDL))
        for width in (*widths[1:], 0):
            big = cut(sent.where("seg is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).select("key"))
            if not width or big.isEmpty():
                hits = hits.union(sorted_out(sent))
                break
            told = sent.join(small_side(big.withColumn("big", F.lit(True))), "key", "left")
            hits = hits.union(sorted_out(told.where("seg is null or big is null").select(*_SENT.names)))
            sent = cut(told.where("seg is not null and big").select(*_SENT.names).mapInArrow(_send_finer(length, width), _SENT_DDL))
    # rows that agree in id and text have the same hits, which are held once
    return hits.groupBy("_k", "_h").agg(F.collect_set(F.struct("lo", "hi")).alias("hits"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, **limits) -> DataFrame:
    """One digest row for each document: sizes, maximal removed runs, and the hash of what remains."""
    rows = prepared(docs, length)
    hits = repeated_ranges(rows, length, **limits)
    joined = rows.join(hits.hint("shuffle_hash"), ["_k", "_h"], "left").select("doc_id", "z", "hits")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_digested(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, **limits) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``, and ``n_chars`` to match, in all its columns.

    Bytes left over from a character that was cut in two are dropped.  A null text stays null.
    """
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(docs["text"].isNull().alias("_null"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(others)]).alias("_rest")
    rows = prepared(docs, length, rest)
    hits = repeated_ranges(rows, length, **limits)
    joined = rows.join(hits.hint("shuffle_hash"), ["_k", "_h"], "left").select("_rest", "z", "hits")
    schema = StructType([joined.schema["_rest"], StructField("_text", StringType()), StructField("_gone", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, len(whole), 500)):
            rows = list(_left_over(batch, length))
            texts = [left.decode("utf-8", "ignore") for left, _, _ in rows]
            yield pa.record_batch([batch.column("_rest"), pa.array(texts, pa.string()), pa.array([n for _, n, _ in rows], pa.int64())], ["_rest", "_text", "_gone"])

    new = joined.mapInArrow(run, schema)
    own = {c: F.col("_rest").getField(f"_c{i}") for i, c in enumerate(others)}
    own["text"] = F.when(~F.col("_rest._null"), F.col("_text"))
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("_gone") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return new.select(*[own[c].alias(c) for c in docs.columns])
