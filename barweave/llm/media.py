"""Media columns: Netpbm and BMP images to arrays, resized tiles, NPY files and difference hashes.

``decode`` reads the raw binary formats (P4 bit map, P5 grey map, P6 pixel map) and
uncompressed 8 and 24 bit BMP. ``area_resize`` weighs every source pixel by the area it
covers in a target cell, from one integral image, so its cost doesn't depend on the
scale. ``media_features`` is the document form: texts become grey maps, are stored,
read back and described.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

#: Bytes of one image row of a stored payload; payloads are padded to a multiple of it.
ROW_BYTES = 64
#: Tiles are square and of this side; the last ones of a row or column hold what is left.
TILE = 64
FEATURES = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 "
    "string, feature string, n_tiles long, tiles_sha256 string")
TILES = "image_id long, tile_row int, tile_col int, height int, width int, npy binary, dhash string"


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary grey map (P5) of 8 bit samples."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, dtype=np.uint8).tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    """A binary pixel map (P6) of 8 bit samples, shape (height, width, 3)."""
    height, width, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, dtype=np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An uncompressed 8 bit (grey) or 24 bit BMP, rows from the bottom up and padded to 4 bytes."""
    height, width = samples.shape[:2]
    grey = samples.ndim == 2
    rows = samples[::-1] if grey else samples[::-1, :, ::-1].reshape(height, width * 3)
    stride = -(-rows.shape[1] // 4) * 4
    body = np.zeros((height, stride), dtype=np.uint8)
    body[:, : rows.shape[1]] = rows
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, body.size, 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette + body.tobytes()


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The header's numbers and where the samples start; comments run from # to the line's end."""
    values: list[int] = []
    at = 2
    while len(values) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        begin = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if begin == at:
            raise ValueError("bad Netpbm header")
        values.append(int(data[begin:at]))
    return values, at + 1


def decode(data: bytes | None) -> np.ndarray | None:
    """The samples of a Netpbm (P4, P5, P6) or BMP image; None for anything else, broken or cut short."""
    if not data:
        return None
    try:
        kind = bytes(data[:2])
        if kind == b"P4":
            (width, height), at = _netpbm_header(data, 2)
            stride = -(-width // 8)
            bits = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
            return ((1 - np.unpackbits(bits, axis=1)[:, :width]) * 255).astype(np.uint8)
        if kind in (b"P5", b"P6"):
            (width, height, top), at = _netpbm_header(data, 3)
            bands = 3 if kind == b"P6" else 1
            unit = np.dtype(np.uint8 if top < 256 else ">u2")
            flat = np.frombuffer(data, unit, width * height * bands, at)
            if top not in (255, 65535):
                flat = np.minimum(flat.astype(np.int64) * (255 if top < 256 else 65535) // max(top, 1), 65535)
            flat = flat.astype(np.uint8 if top < 256 else np.uint16)
            return flat.reshape((height, width, 3) if bands == 3 else (height, width))
        if kind == b"BM":
            start = struct.unpack_from("<I", data, 10)[0]
            _, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
            if packed or bits not in (8, 24) or width < 0:
                return None
            rows = abs(height)
            stride = -(-width * bits // 32) * 4
            body = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : width * bits // 8]
            body = body if height < 0 else body[::-1]
            if bits == 24:
                return np.ascontiguousarray(body.reshape(rows, width, 3)[:, :, ::-1])
            head = struct.unpack_from("<I", data, 14)[0]
            colours = (start - 14 - head) // 4
            palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
            image = palette[body]
            return np.ascontiguousarray(image[:, :, 0] if (palette == palette[:, :1]).all() else image)
    except (ValueError, struct.error, IndexError):
        return None
    return None


def grey(image: np.ndarray) -> np.ndarray:
    """One band: the integer mean of the bands."""
    return image if image.ndim == 2 else (image.astype(np.int64).sum(axis=2) // image.shape[2]).astype(image.dtype)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area each target cell covers, from an integral image read at fractional places."""
    rows, cols = image.shape
    table = np.zeros((rows + 1, cols + 1))
    table[1:, 1:] = image.astype(np.float64).cumsum(0).cumsum(1)

    def at(cells: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(cells + 1) * (size / cells)
        low = np.minimum(edge.astype(np.int64), size - 1)
        return low, edge - low

    (y, fy), (x, fx) = at(height, rows), at(width, cols)
    across = table[:, x] * (1 - fx) + table[:, x + 1] * fx
    both = across[y] * (1 - fy)[:, None] + across[y + 1] * fy[:, None]
    sums = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    return sums * (height * width / (rows * cols))


def dhash(image: np.ndarray) -> str:
    """64 bits: is a cell of the 8 x 9 thumbnail darker than its right neighbour, row by row, in hex."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def to_npy(tile: np.ndarray) -> bytes:
    """The bytes of an NPY file."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tiles_of(image: np.ndarray, side: int = TILE) -> Iterator[tuple[int, int, np.ndarray]]:
    """(tile row, tile column, samples) of every tile, row by row."""
    for y in range(0, image.shape[0], side):
        for x in range(0, image.shape[1], side):
            yield y // side, x // side, image[y : y + side, x : x + side]


def image_tiles(images: DataFrame, resize_to: tuple[int, int] | None = None, side: int = TILE) -> DataFrame:
    """Tiles of the images in columns (image_id, data), as NPY bytes with a difference hash each.

    With ``resize_to`` = (height, width) an image is turned grey and area-resized first.
    Null, empty or unreadable data give no tiles; repeated rows give repeated tiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("image_id", pa.int64()), ("tile_row", pa.int32()), ("tile_col", pa.int32()), ("height", pa.int32()),
            ("width", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string())])
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                image = decode(data)
                if image is None or not image.size:
                    continue
                if resize_to:
                    image = np.round(area_resize(grey(image), *resize_to)).astype(np.uint8)
                rows = [(key, y, x, *tile.shape[:2], to_npy(tile), dhash(tile)) for y, x, tile in tiles_of(image, side)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return map_batches(images.select("image_id", "data"), run, TILES)


def describe(text: str | None) -> tuple:
    """What ``media_features`` returns for one text, but for its id."""
    raw = (text or "").encode("utf-8")
    rows = max(1, -(-len(raw) // ROW_BYTES))
    media = encode_pgm(np.frombuffer(raw.ljust(rows * ROW_BYTES, b"\0"), np.uint8).reshape(rows, ROW_BYTES))
    image = decode(media)
    payload = image.tobytes()
    tiles, packed = hashlib.sha256(), 0
    for _, _, tile in tiles_of(image):
        tiles.update(to_npy(tile))
        packed += 1
    small = np.round(area_resize(image, 4, 4)).astype(np.uint8)
    return (
        len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW_BYTES:]),
        len(media), hashlib.sha256(media)
            .hexdigest(), f"dhash={dhash(image)};mean4x4={small.tobytes().hex()}", packed, tiles.hexdigest(),
    )


def media_features(docs: DataFrame) -> DataFrame:
    """Every text stored as a grey map 64 samples wide, read back from the stored bytes and described.

    The payload is the UTF-8 text with bytes 0 up to a positive multiple of 64. A null text
    counts as empty (one row of zeros); a null doc_id stays null; equal texts give equal
    values; repeated rows stay repeated; other columns are ignored. Work is by row, so long
    texts and hot keys only cost their own bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
            pa.string()]
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            rows = [(key, *describe(text)) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return map_batches(docs.select(docs["doc_id"].cast("long"), "text"), run, FEATURES)
