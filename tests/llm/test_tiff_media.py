import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tracelight.llm.tiff_media import DEFLATE, LZW, NONE, PACKBITS, TiffError, do_lzw, features, pack_bits, pages, store_texts, tiff_media, tiff_pages, un_lzw, unpack_bits, write_tiff

SCHEMA = "doc_id long, text string, media string, n_bytes int"


@pytest.mark.parametrize("compression", [NONE, PACKBITS, LZW, DEFLATE])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(compression, order):
    rng = np.random.default_rng(compression)
    images = [rng.integers(0, 4, (33, 50)).astype(np.uint8), rng.integers(0, 256, (1, 1)).astype(np.uint8), np.zeros((90, 70), np.uint8)]
    for predictor in (1, 2):
        for tile in (None, (16, 32)):
            read = list(pages(write_tiff(images, compression, predictor, 7, tile, order)))
            assert len(read) == 3
            for image, page in zip(images, read):
                assert (page.pixels[:, :, 0] == image).all() and page.compression == compression


def test_lzw_over_many_table_resets():
    data = np.random.default_rng(2).integers(0, 256, 30_000).astype(np.uint8).tobytes()
    assert un_lzw(do_lzw(data), len(data)) == data
    for n in range(0, 1200):
        assert un_lzw(do_lzw(data[:n]), max(n, 1)) == data[:n]


def test_pack_bits():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 127, 128, 129, 130, 257, 1000):
        for data in (b"a" * n, bytes(rng.choice(b"ab") for _ in range(n)), b"xy" * (n // 2) + b"z" * n, b"q" * n + b"rs"):
            packed = pack_bits(data)
            assert unpack_bits(packed, len(data)) == data and len(packed) <= len(data) + len(data) // 64 + 2


def test_headers_that_claim_too_much():
    """Sizes, counts and offsets of any value end in an error of the file, soon and in little memory."""
    rng = random.Random(9)
    for compression in (NONE, PACKBITS, LZW, DEFLATE):
        for tile in (None, (16, 16)):
            good = write_tiff([np.arange(80 * 40, dtype=np.uint8).reshape(80, 40)], compression, 2, 16, tile)
            (at,) = struct.unpack_from("<I", good, 4)
            (count,) = struct.unpack_from("<H", good, at)
            for field in range(count):
                for value in (0, 1, 3, 65_535, 4_000_000_000, rng.randrange(1 << 32)):
                    bad = bytearray(good)
                    struct.pack_into("<I", bad, at + 2 + 12 * field + rng.choice((4, 8)), value)
                    try:
                        list(pages(bytes(bad)))
                    except TiffError:
                        pass
    bomb = bytearray(write_tiff([np.zeros((1, 16), np.uint8)], DEFLATE, 1))
    (at,) = struct.unpack_from("<I", bomb, 4)
    for field in (0, 1):  # width and height
        struct.pack_into("<I", bomb, at + 2 + 12 * field + 8, 4_000_000_000)
    with pytest.raises(TiffError):
        list(pages(bytes(bomb)))


def test_features_of_known_samples():
    assert features(np.zeros(576, np.uint8), ["576x1"]) == "pages=576x1 mean=0 sd=0 entropy=0 grey=0000000000000000"
    half = np.repeat(np.array([0, 255], np.uint8), 288)
    assert features(half, ["576x1"]) == "pages=576x1 mean=127500 sd=127500 entropy=1000 grey=00000000ffffffff"


def test_every_kind_of_file_is_stored(spark):
    rows = [(i, f"text number {i} " * (i % 60 + 1)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    read = tiff_pages(store_texts(docs)).collect()
    assert all(r.error is None for r in read) and {r.compression for r in read} == {NONE, PACKBITS, LZW, DEFLATE} and {r.predictor for r in read} == {1, 2}
    media = {r.doc_id: r.media for r in store_texts(docs).collect()}
    assert all(r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest() and r.media_bytes == len(media[r.doc_id]) for r in tiff_media(docs).collect())


def test_broken_files():
    good = write_tiff([np.zeros((5, 5), np.uint8)])
    for bad in (b"", b"II*\0", good[:40], b"PK" + good[2:]):
        with pytest.raises(TiffError):
            list(pages(bad))
    circle = bytearray(good)
    circle[-4:] = circle[4:8]
    with pytest.raises(TiffError):
        list(pages(bytes(circle)))


def test_pages(spark):
    files = [(1, write_tiff([np.zeros((2, 3), np.uint8)] * 2)), (2, b"no"), (None, None)]
    got = tiff_pages(spark.createDataFrame(files, "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.page, r.width, r.height, r.error is None) for r in got if r.doc_id] == [(1, 0, 3, 2, True), (1, 1, 3, 2, True), (2, 0, None, None, False)]
    assert len(got) == 4


def test_media(spark):
    texts = ["", None, "abc", "x" * 576, "é" * 300, "long " * 200_000, "abc"]
    docs = spark.createDataFrame([(i, t, "m", 3) for i, t in enumerate(texts)] + [(None, "abc", None, None)], SCHEMA)
    got = tiff_media(docs).collect()
    assert len(got) == 8
    for r in got:
        raw = ((texts[r.doc_id] if r.doc_id is not None else "abc") or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
    same = {(r.media_sha256, r.feature) for r in got if r.n_bytes == 3}
    assert len(same) == 1 and len({r.feature for r in got}) > 3
    assert tiff_media(spark.createDataFrame([], SCHEMA)).count() == 0
