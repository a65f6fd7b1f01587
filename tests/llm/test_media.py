"""Media: decoders on files written here, resizing against plain loops, payloads as an exact round trip."""

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from tallyrack.llm.media import area_resize, decode, difference_hash, encode_bmp, encode_pgm, encode_ppm, read_back, store, tile, tiles


def bmp(pixels, depth=24, top_down=False):
    h, w, _ = pixels.shape
    rows = pixels if top_down else pixels[::-1]
    body = b""
    for row in rows:
        line = row[:, ::-1].tobytes() if depth == 24 else np.concatenate([row[:, ::-1], np.zeros((w, 1), np.uint8)], axis=1).tobytes()
        body += line + b"\0" * (-len(line) % 4)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, depth, 0, len(body), 0, 0, 0, 0) + body


def test_decoders():
    r = np.random.default_rng(1)
    grey, colour = r.integers(0, 256, (5, 7), np.uint8), r.integers(0, 256, (4, 3, 3), np.uint8)
    assert (decode(encode_pgm(grey)) == grey).all()
    assert (decode(b"P2 # c\n7 5\n255\n" + b" ".join(b"%d" % x for x in grey.flat)) == grey).all()
    assert (decode(b"P6 3 4 255\n" + colour.tobytes()) == colour).all()
    assert (decode(b"P3\n3 4\n255\n" + b"\n".join(b"%d" % x for x in colour.flat)) == colour).all()
    assert (decode(b"P5 2 1 65535\n\x01\x02\xff\xff") == [[258, 65535]]).all()
    dots = r.integers(0, 2, (3, 10), np.uint8)
    want = (1 - dots) * 255
    assert (decode(b"P4\n10 3\n" + np.packbits(dots, axis=1).tobytes()) == want).all()
    assert (decode(b"P1\n10 3\n" + b" ".join(b"%d" % x for x in dots.flat)) == want).all()
    for depth in (24, 32):
        for top_down in (False, True):
            assert (decode(bmp(colour, depth, top_down)) == colour).all()
    palette = np.array([[0, 0, 0, 0], [10, 20, 30, 0]], np.uint8)
    eight = b"BM" + struct.pack("<IHHI", 66, 0, 0, 62) + struct.pack("<IiiHHIIiiII", 40, 3, 1, 1, 8, 0, 4, 0, 0, 2, 0) + palette.tobytes() + b"\1\0\1\0"
    assert decode(eight).tolist() == [[[30, 20, 10], [0, 0, 0], [30, 20, 10]]]
    for bad in (b"", b"P5", b"P7 1 1", b"P5 2 2 255\n\0", b"BM12", b"GIF89a"):
        with pytest.raises((ValueError, struct.error)):
            decode(bad)


def test_area_resize_is_the_mean_over_areas():
    r = np.random.default_rng(2)
    for h, w in ((8, 9), (1, 1), (17, 5), (3, 40)):
        pixels = r.integers(0, 256, (h, w), np.uint8)
        fine = np.repeat(np.repeat(pixels, 4, axis=0), 6, axis=1).astype(float)
        want = fine.reshape(4, h, 6, w).mean(axis=(1, 3))
        assert np.allclose(area_resize(pixels, 4, 6), want)
    assert np.load(io.BytesIO(tile(np.full((9, 30, 3), 7, np.uint8)))).tolist() == np.full((16, 16, 3), 7).tolist()
    ramp = np.tile(np.arange(0, 90, dtype=np.uint8), (16, 1))
    assert difference_hash(ramp) == "f" * 16 and difference_hash(ramp[:, ::-1]) == "0" * 16


def test_round_trip(spark):
    texts = ["", None, "é" * 31 + "ab", "x" * 64, "y" * 65, "\0", "long " * 200_000, "tie", "tie"]
    got = read_back(store(spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, media string"))).collect()
    assert len(got) == len(texts)
    for g in got:
        raw = (texts[g.doc_id] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (g.n_bytes, g.payload_bytes, g.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert g.payload_sha256 == hashlib.sha256(padded).hexdigest()
        media = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        assert (g.media_bytes, g.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert len({g.feature for g in got if texts[g.doc_id] == "tie"}) == 1


def test_tiles_of_any_media(spark):
    rows = [(1, encode_pgm(np.zeros((3, 4), np.uint8)), "x"), (2, None, "x"), (3, b"no picture", "x"), (4, b"", "x"), (1, encode_pgm(np.zeros((3, 4), np.uint8)), "x")]
    got = {(g.id, g.height, g.width, g.dhash) for g in tiles(spark.createDataFrame(rows, "id int, media binary, source string")).collect()}
    assert got == {(1, 3, 4, "0" * 16), (2, None, None, None), (3, None, None, None), (4, None, None, None)}
    assert tiles(spark.createDataFrame([], "media binary")).collect() == []


def test_encoders_round_trip():
    r = np.random.default_rng(5)
    for h, w in ((1, 1), (3, 5), (4, 64)):
        colour = r.integers(0, 256, (h, w, 3), np.uint8)
        assert (decode(encode_ppm(colour)) == colour).all() and (decode(encode_bmp(colour)) == colour).all() and encode_bmp(colour) == bmp(colour)


def test_clashing_columns_and_no_rows(spark):
    frame = spark.createDataFrame([(1, bytearray(encode_pgm(np.zeros((2, 2), np.uint8))), "h", "w", 1.0, "n"), (1, None, "h", "w", 1.0, "n")], "id long, media binary, height string, Width string, dhash double, npy string")
    got = tiles(frame).collect()
    assert [(g.height, g.width) for g in got] == [(2, 2), (None, None)] and tiles(frame).columns == ["id", "media", "height", "width", "dhash", "npy"]
    assert tiles(frame.filter("false")).collect() == []
    nothing = store(spark.createDataFrame([], "doc_id long, text string"))
    assert nothing.collect() == [] and read_back(nothing).collect() == []
    twice = read_back(store(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, text string"))).collect()
    assert len(twice) == 3 and len({bytes(g.tile) for g in twice}) == 1 and np.load(io.BytesIO(bytes(twice[0].tile))).shape == (16, 16)


def test_formats_of_odd_texts(spark, tmp_path):
    """Null, empty and odd lengths in all three formats come back as they were stored."""
    from tallyrack.llm.media import media_formats

    texts = [None, "", "a", "ab", "abc", "é" * 95, "x" * 191, "x" * 192, "x" * 193, "y" * 200_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in media_formats(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        unit = 64 if len(raw) % 3 == 0 else 192
        size = max(unit, -(-len(raw) // unit) * unit)
        assert got[i].format == ("pgm", "ppm", "bmp")[len(raw) % 3] and got[i].payload_bytes == size and got[i].payload_sha256 == hashlib.sha256(raw.ljust(size, b"\0")).hexdigest() and got[i].dhash_there


def test_the_formats_take_one_python_worker_a_task(spark):
    from tallyrack.llm.media import media_formats

    found = media_formats(spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    rows = found.collect()
    assert {r.format for r in rows} == {"pgm", "ppm", "bmp"} and all(r.dhash_there for r in rows)
