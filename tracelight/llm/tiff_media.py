"""TIFF as a media column: image directories are walked, strips and tiles decoded, one row per page.

Read: both byte orders; stripped and tiled pages; chunky and planar samples of 8 or 16 bits;
compression none, PackBits, LZW and deflate; no or horizontal predictor.  Written: the same, as
8-bit greyscale.  ``tiff_media`` stores texts under all four compressions, in strips and in tiles; which,
a checksum of the text decides.  A file that is null, broken or of another kind gives one row with its ``error``; a
chain of directories that returns to one already seen is broken.  A null document id stays null;
repeated rows give repeated pages; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
_DEFLATES = (8, 32946)
#: Bytes a value of each field type takes, and how struct spells it.
_TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}

#: Bytes that one stored byte can stand for at most, by compression; a header that claims more is broken.
_MOST = {NONE: 1, PACKBITS: 64, LZW: 2560, 8: 1032, 32946: 1032}
#: Bytes of a page, or of a strip or tile, beyond which a file is reported as too large instead of read.
MOST_BYTES = 1 << 30

WIDTH = 576
PAGE_ROWS = 1024
STRIP_ROWS = 128
TILE = (192, 16)


class TiffError(ValueError):
    pass


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: np.ndarray  # height x width x samples


# -- codecs ----------------------------------------------------------------------------------------


def unpack_bits(data: bytes, need: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < need:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three bytes and more as runs, the rest as literals."""
    a = np.frombuffer(data, np.uint8)
    first = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    sizes = np.diff(np.append(first, len(a)))
    runs = np.flatnonzero(sizes >= 3)
    out, at = bytearray(), 0
    for start, size in [*zip(first[runs].tolist(), sizes[runs].tolist()), (len(data), 0)]:
        while at < start:
            part = data[at : min(start, at + 128)]
            out.append(len(part) - 1)
            out += part
            at += len(part)
        while size > 1:
            n = min(size, 128)
            out += bytes((257 - n, data[at]))
            at, size = at + n, size - n
        # one byte that a run of 129 leaves over starts the next literals
    return bytes(out)


def un_lzw(data: bytes, need: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first; the width grows one code early; 256 clears, 257 ends."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    words, width, last, out, size = list(base), 9, b"", [], 0
    held = bits = 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code < len(words) and code != 256 and code != 257:
            word = words[code]
            if last:
                words.append(last + word[:1])
            elif code > 255:
                raise TiffError("LZW code before any word")
        elif code == 256:
            words, width, last = list(base), 9, b""
            continue
        elif code == 257:
            break
        elif not last or code > len(words):
            raise TiffError("LZW code beyond the table")
        else:
            word = last + last[:1]
            words.append(word)
        out.append(word)
        size += len(word)
        if size >= need:
            break
        last = word
        if len(words) + 1 >> width:
            width = min(12, width + 1)
    return b"".join(out)


def do_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 256, 9
    words: dict[int, int] = {}  # (code << 8 | byte) -> code
    count, width, word = 258, 9, -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        code = words.get(key)
        if code is not None:
            word = code
            continue
        held, bits = held << width | word, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
        words[key] = count
        count += 1
        if count >= 4094:
            held, bits = held << 12 | 256, bits + 12
            words, count, width = {}, 258, 9
        elif count >> width:
            width += 1
        word = byte
    if word >= 0:
        held, bits = held << width | word, bits + width
        count += 1
        width = min(12, max(9, count.bit_length()))
    held, bits = held << width | 257, bits + width
    held <<= -bits % 8
    return bytes(out) + held.to_bytes(-(-bits // 8), "big")


def _decoded(data: bytes, compression: int, need: int) -> bytes:
    """At least ``need`` bytes of a strip or tile, if it holds so many; little more is ever made."""
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, need)
    if compression == LZW:
        return un_lzw(data, need)
    try:
        return zlib.decompressobj().decompress(data, need)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from e


# -- reading ---------------------------------------------------------------------------------------


def _fields(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    try:
        (count,) = struct.unpack_from(order + "H", data, at)
        out = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in _TYPES:
                continue
            size, letter = _TYPES[kind]
            where = at + 10 + 12 * i
            if n * size > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if n * size > len(data):
                raise TiffError("a field is longer than the file")
            out[tag] = struct.unpack_from(f"{order}{n}{letter}", data, where)
        return out, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
    except struct.error as e:
        raise TiffError(f"cut off: {e}") from e


def _page(data: bytes, fields: dict[int, tuple[int, ...]], order: str) -> Page:
    one = lambda tag, otherwise=None: fields[tag][0] if fields.get(tag) else otherwise
    width, height = one(256), one(257)
    if not width or not height:
        raise TiffError("a page without width or height")
    samples, bits = one(277, 1), one(258, 1)
    if not samples:
        raise TiffError("a page without samples")
    compression, predictor, planar = one(259, 1), one(317, 1), one(284, 1)
    if bits not in (8, 16) or len(set(fields.get(258, (bits,)))) > 1:
        raise TiffError(f"{bits} bits a sample are not supported")
    if compression not in _MOST:
        raise TiffError(f"compression {compression} is not known")
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor} is not known")
    dtype = np.dtype(np.uint8 if bits == 8 else order + "u2")
    planes = samples if planar == 2 else 1
    inner = samples if planar == 1 else 1
    tiled = 322 in fields
    across, down = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    if not across or not down:
        raise TiffError("a strip or tile without size")
    offsets, counts = fields.get(324 if tiled else 273, ()), fields.get(325 if tiled else 279, ())
    columns, rows = -(-width // across), -(-height // down)
    if len(offsets) < planes * rows * columns or len(counts) < len(offsets):
        raise TiffError("strips or tiles are missing")
    claimed = height * width * samples * dtype.itemsize
    if max(claimed, down * across * inner * dtype.itemsize) > MOST_BYTES:
        raise TiffError("a page or tile is too large")
    if any(o + c > len(data) for o, c in zip(offsets, counts)):
        raise TiffError("a strip or tile is cut off")
    if claimed > _MOST[compression] * sum(counts[: planes * rows * columns]):
        raise TiffError("a page is larger than its strips or tiles can hold")
    pixels = np.zeros((height, width, samples), dtype.newbyteorder("="))
    for k in range(planes * rows * columns):
        plane, row, column = k // (rows * columns), k // columns % rows, k % columns
        high = down if tiled else min(down, height - row * down)
        need = high * across * inner * dtype.itemsize
        raw = _decoded(data[offsets[k] : offsets[k] + counts[k]], compression, need)
        if len(raw) < need:
            raise TiffError("a strip or tile is too short")
        block = np.frombuffer(raw[:need], dtype).astype(pixels.dtype).reshape(high, across, inner)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=pixels.dtype)
        y, x = row * down, column * across
        target = pixels[y : y + high, x : x + across, plane : plane + 1] if planar == 2 else pixels[y : y + high, x : x + across]
        target[:] = block[: target.shape[0], : target.shape[1]]
    return Page(width, height, samples, bits, compression, predictor, pixels)


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its chain of directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("the directories run in a circle")
        seen.add(at)
        fields, at = _fields(data, at, order)
        yield _page(data, fields, order)


# -- writing ---------------------------------------------------------------------------------------


def write_tiff(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """8-bit greyscale pages, in strips of ``rows`` rows or in tiles of (width, height)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width = image.shape
        across, down = tile or (width, min(rows, height))
        offsets, counts = [], []
        for y in range(0, height, down):
            for x in range(0, width, across):
                block = image[y : y + down, x : x + across]
                if tile:
                    full = np.zeros((down, across), np.uint8)
                    full[: block.shape[0], : block.shape[1]] = block
                    block = full
                if predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                raw = np.ascontiguousarray(block).tobytes()
                coded = {NONE: lambda b: b, PACKBITS: pack_bits, LZW: do_lzw, DEFLATE: lambda b: zlib.compress(b, level)}[compression](raw)
                offsets.append(len(out))
                counts.append(len(coded))
                out += coded
        if len(out) % 2:
            out.append(0)
        fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        fields += [(322, 4, [across]), (323, 4, [down]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [down]), (279, 4, counts)]
        placed = []
        for tag, kind, values in sorted(fields):
            coded = struct.pack(f"{order}{len(values)}{_TYPES[kind][1]}", *values)
            if len(coded) > 4:
                placed.append((tag, kind, len(values), struct.pack(order + "I", len(out))))
                out += coded
            else:
                placed.append((tag, kind, len(values), coded.ljust(4, b"\0")))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(placed))
        for tag, kind, n, value in placed:
            out += struct.pack(order + "HHI", tag, kind, n) + value
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def text_images(text: bytes, width: int = WIDTH, page_rows: int = PAGE_ROWS) -> list[np.ndarray]:
    """The bytes as rows of ``width`` samples, filled up with 255 to whole rows and at least one."""
    need = max(1, -(-len(text) // width)) * width
    flat = np.full(need, 255, np.uint8)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    image = flat.reshape(-1, width)
    return [image[i : i + page_rows] for i in range(0, len(image), page_rows)]


def features(flat: np.ndarray, shapes: list[str]) -> str:
    """Shape of the pages, mean and deviation in thousandths, entropy in millibits, and a grey hash."""
    counts = np.bincount(flat, minlength=256)
    n = len(flat)
    values = np.arange(256)
    total, square = int((counts * values).sum()), int((counts * values * values).sum())
    p = counts[counts > 0] / n
    edges = np.arange(min(64, n)) * n // min(64, n)
    means = np.add.reduceat(flat, edges, dtype=np.int64) * 64 // np.diff(np.append(edges, n))
    grey = int.from_bytes(np.packbits(means > int(np.median(means))).tobytes(), "big")
    deviation = int((max(0, square * n - total * total)) ** 0.5 * 1000 / n)
    return f"pages={'+'.join(shapes)} mean={total * 1000 // n} sd={deviation} entropy={round(float(-(p * np.log2(p)).sum()) * 1000)} grey={grey:016x}"


# -- Spark -----------------------------------------------------------------------------------------

PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def tiff_pages(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """``key`` and one row for each page; ``pixels`` are its samples row by row, or ``error`` says what is wrong."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
        types = [pa.int32()] * 7 + [pa.binary(), pa.string()]
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                rows = []
                try:
                    for k, p in enumerate(pages(data.as_py() or b"")):
                        rows.append((k, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels.tobytes(), None))
                except TiffError as e:
                    rows.append((len(rows), *[None] * 7, str(e)))
                own = batch.column(0).take(pa.array([i] * len(rows), pa.int64()))
                yield pa.record_batch([own, *(pa.array([r[c] for r in rows], t) for c, t in enumerate(types))], [key, *names])

    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, {PAGE_SCHEMA}")


def _kept_as(text: bytes) -> dict:
    """How a text is stored: one of the four compressions, in strips or tiles, by its checksum."""
    mark = zlib.crc32(text)
    return {"compression": (DEFLATE, LZW, PACKBITS, NONE)[mark % 4], "predictor": 1 + mark // 8 % 2, "tile": TILE if mark // 4 % 2 else None}


def store_texts(docs: DataFrame, **kept_as) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text as a TIFF file of one or more pages.

    ``kept_as`` are arguments of ``write_tiff``; without them a checksum of the text decides.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 500) for whole in batches for a in range(0, len(whole), 500)):
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            files = [write_tiff(text_images(t), **(kept_as or _kept_as(t))) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


_DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(media: bytes) -> tuple:
    """What a stored file holds, read back page by page."""
    read = list(pages(media))
    flat = np.concatenate([p.pixels.ravel() for p in read])
    payload = flat.tobytes()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(flat, [f"{p.width}x{p.height}" for p in read])


def tiff_media(docs: DataFrame, **kept_as) -> DataFrame:
    """One row for each document: its text went into a TIFF file and came back.

    Files are written and read in one step, so that they need not travel between the two.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [x.split()[0] for x in _DIGESTS.split(", ")], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in (whole.slice(a, 500) for whole in batches for a in range(0, len(whole), 500)):
            sizes, rows = [], []
            for x in batch.column(1):
                text = (x.as_py() or "").encode()
                sizes.append(len(text))
                rows.append(_digest(write_tiff(text_images(text), **(kept_as or _kept_as(text)))))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(types))], ["doc_id", "n_bytes", *names])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, {_DIGESTS}")
