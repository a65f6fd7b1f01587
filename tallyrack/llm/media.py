"""Media columns (operator 4): Netpbm and BMP to numpy arrays, area-resized by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructType

from .common import documents, slices, table, texts, without

#: The width of the grey pictures that payloads are stored as; a payload is a multiple of it.
WIDTH = 64


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A grey 8-bit array as binary PGM."""
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_ppm(pixels: np.ndarray) -> bytes:
    """An 8-bit colour array as binary PPM."""
    height, width, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An 8-bit colour array as BMP of 24 bits a pixel, the lowest row first."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    size = 54 + rows.size
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The header's numbers, comments skipped, and where the raster begins."""
    at, numbers = 2, []
    while len(numbers) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if start == at:
            raise ValueError("bad Netpbm header")
        numbers.append(int(data[start:at]))
    return numbers, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3), of uint8 or, above a maximum of 255, uint16."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap = kind in (b"P1", b"P4")
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height, most = numbers[0], numbers[1], 1 if bitmap else numbers[2]
    if not width or not height or not 0 < most < 65536:
        raise ValueError("bad Netpbm size")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    n, unit = int(np.prod(shape)), np.dtype(">u2" if most > 255 else "u1")
    if kind == b"P4":
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)
        return ((1 - bits[:, :width]) * 255).astype(np.uint8)
    if kind == b"P1":
        dots = bytes(c for c in data[at - 1 :] if c in b"01")[:n]
        return ((49 - np.frombuffer(dots, np.uint8, n)) * 255).astype(np.uint8).reshape(shape)
    if kind in (b"P2", b"P3"):
        body = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))
        return np.array(body.split()[:n], dtype=np.int64).astype(unit.newbyteorder("=")).reshape(shape)
    return np.frombuffer(data, unit, n, at).astype(unit.newbyteorder("=")).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel, from below or above: (height, width, 3) of uint8."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    start, header, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    colours = struct.unpack_from("<I", data, 46)[0]
    if packed not in (0, 3) or width <= 0 or not height or depth not in (1, 4, 8, 24, 32):
        raise ValueError("unsupported BMP")
    rows, row = abs(height), -(-width * depth // 32) * 4
    raw = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)
    if depth <= 8:
        palette = np.frombuffer(data, np.uint8, (colours or 1 << depth) * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        bits = np.unpackbits(raw, axis=1).reshape(rows, -1, depth)
        index = bits @ (1 << np.arange(depth - 1, -1, -1))
        pixels = palette[index[:, :width]]
    else:
        pixels = raw[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    return np.ascontiguousarray(pixels[::-1] if height > 0 else pixels)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over each target cell's area, from an integral image; cells may end inside pixels.  Doubles."""
    grey = pixels if pixels.ndim == 3 else pixels[:, :, None]
    h, w, _ = grey.shape
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)

    def at(table: np.ndarray, places: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The integral at fractional places, from its values at the whole ones beside them."""
        low = np.minimum(np.floor(places).astype(np.int64), known[-1] - 1)
        part = (places - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[np.searchsorted(known, low)] * (1 - part) + table[np.searchsorted(known, low + 1)] * part

    # The integral over rows is kept only at the rows that are read; each stretch between two is summed as it is stored.
    low = np.minimum(np.floor(ys).astype(np.int64), h - 1)
    rows = np.unique(np.concatenate([[0, h], low, low + 1]))
    down = np.zeros((len(rows), *grey.shape[1:]))
    for i, (a, b) in enumerate(zip(rows, rows[1:], strict=False), 1):
        down[i] = down[i - 1] + grey[a:b].sum(axis=0, dtype=np.float64)
    bands = np.diff(at(down, ys, rows), axis=0)
    across = np.zeros((w + 1, height, bands.shape[2]))
    np.cumsum(bands.transpose(1, 0, 2), axis=0, out=across[1:])
    cells = np.diff(at(across, xs, np.arange(w + 1)), axis=0).transpose(1, 0, 2)
    out = cells * (height * width / (h * w))
    return out if pixels.ndim == 3 else out[:, :, 0]


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 area means is below its right neighbour."""
    grey = pixels if pixels.ndim == 2 else pixels.mean(axis=2)
    small = area_resize(grey, 8, 9)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, pixels, allow_pickle=False)
    return out.getvalue()


def tile(pixels: np.ndarray, size: int = 16) -> bytes:
    """An area-resized square tile of uint8 as NPY bytes."""
    small = area_resize(pixels if pixels.max(initial=0) < 256 else pixels / 257, size, size)
    return npy(np.clip(np.rint(small), 0, 255).astype(np.uint8))


def tiles(media: DataFrame, column: str = "media", size: int = 16) -> DataFrame:
    """Adds height, width, dhash and npy (the tile) to a table with a binary column of Netpbm or BMP files.

    Null, empty or undecodable media have null in all four; rows, their other columns and repeats stay.  Columns of
    these four names are replaced.
    """
    media = without(media, "height", "width", "dhash", "npy")
    schema = StructType(list(media.schema)).add("height", IntegerType()).add("width", IntegerType()).add("dhash", StringType()).add("npy", BinaryType())
    return media.mapInArrow(lambda batches: _tiled(batches, column, size), schema)


def _tiled(batches: Iterator[pa.RecordBatch], column: str = "media", size: int = 16) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, column):
        found: list[tuple] = []
        for data in texts(part.column(column)):
            try:
                pixels = decode(data)
            except (ValueError, struct.error, IndexError):
                found.append((None, None, None, None))
            else:
                found.append((pixels.shape[0], pixels.shape[1], difference_hash(pixels), tile(pixels, size)))
        more = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "height", "width", "dhash", "npy"])


def payload(text: bytes, unit: int = WIDTH) -> bytes:
    """The text and zeros up to a positive multiple of a unit."""
    return text + b"\0" * (-len(text) % unit if text else unit)


def store(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_bytes, media): each whole text (null: empty), however long, as a PGM picture of WIDTH
    columns.  Repeated rows stay, an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            items = list(texts(part.column("text")))
            stored = [encode_pgm(np.frombuffer(payload(x), np.uint8).reshape(-1, WIDTH)) for x in items]
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "n_bytes": pa.array([len(x) for x in items], pa.int64()), "media": pa.array(stored, pa.binary())})

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> checksums of the stored file and of the payload decoded from it, and features: the
    difference hash and the NPY tile.  One row for each, repeated ones too; an empty table gives none.  Media that
    can't be decoded raise: store() writes none."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            rows = []
            for data in texts(part.column("media")):
                pixels = decode(data)
                raw = pixels.tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(pixels), tile(pixels)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            more = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *more], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])

    return media.mapInArrow(run, schema)


#: Formats that store_formats deals out, by what a text's length leaves.
FORMATS = ("pgm", "ppm", "bmp")


def store_formats(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, format, media): whole texts as grey PGM, colour PPM or BMP pictures, by what the number of
    their bytes leaves of three.  Null is empty; repeated rows stay."""
    return documents(docs, "doc_id", "text").mapInArrow(_stored, "doc_id long, format string, media binary")


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        items = list(texts(part.column("text")))
        kinds = [FORMATS[len(x) % 3] for x in items]
        grey = lambda x: encode_pgm(np.frombuffer(payload(x), np.uint8).reshape(-1, WIDTH))
        colour = lambda x: np.frombuffer(payload(x, 3 * WIDTH), np.uint8).reshape(-1, WIDTH, 3)
        media = [grey(x) if k == "pgm" else encode_ppm(colour(x)) if k == "ppm" else encode_bmp(colour(x)) for x, k in zip(items, kinds, strict=True)]
        yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "format": pa.array(kinds, pa.string()), "media": pa.array(media, pa.binary())})


def media_formats(spark, sf_dir: str) -> DataFrame:
    """Every text in one of three formats, read back: (doc_id, format, height, payload_bytes, payload_sha256, dhash_there).
    A task's one Python worker stores, tiles and reads back a slice before the next; media don't pass the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _tiled(_stored(batches)):
            raw = [decode(x).tobytes() for x in texts(part.column("media"))]
            there = [None if d is None else len(d) == 16 and len(t) == (384 if f == "pgm" else 896) for f, d, t in zip(*(part.column(c).to_pylist() for c in ("format", "dhash", "npy")), strict=True)]
            more = {"dhash_there": pa.array(there, pa.bool_()), "payload_bytes": pa.array(list(map(len, raw)), pa.int64()), "payload_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())}
            yield pa.record_batch({c: part.column(c) for c in ("doc_id", "format", "height")} | more)

    docs = documents(table(spark, sf_dir, "documents"), "doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, format string, height int, dhash_there boolean, payload_bytes long, payload_sha256 string")


def op4_media(spark, sf_dir: str) -> DataFrame:
    return read_back(store(table(spark, sf_dir, "documents")))
