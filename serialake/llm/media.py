"""Media columns: Netpbm and BMP images in a binary column, decoded to numpy arrays, area-resized, tiled and hashed.

``encode_payload`` stores any text as an 8-bit grey image (lossless), ``decode`` reads Netpbm (P1 to P6) and uncompressed BMP (8, 24
and 32 bits), ``area_resize`` averages exact source areas with one integral image, ``difference_hash`` compares neighbours of
the 9 x 8 thumbnail, ``tiles`` writes pieces of an image as NPY bytes. The Spark operators run these per row in Arrow batches.
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

from serialake.llm.common import col, slices

WIDTH = 64  # samples in an image row, and the unit a payload is padded to


# -- formats ---------------------------------------------------------------------------------------------------------

def write_netpbm(image: np.ndarray) -> bytes:
    """Grey (h, w) as P5, colour (h, w, 3) as P6; 8-bit samples, or 16-bit big-endian ones."""
    kind, most = (b"P5" if image.ndim == 2 else b"P6"), (255 if image.dtype == np.uint8 else 65535)
    data = image if image.dtype == np.uint8 else image.astype(">u2")
    return kind + b"\n%d %d\n%d\n" % (image.shape[1], image.shape[0], most) + np.ascontiguousarray(data).tobytes()


def write_bmp(image: np.ndarray) -> bytes:
    """Grey (h, w) as 8-bit BMP with a grey palette, colour (h, w, 3) as 24-bit BMP; rows bottom-up, padded to 4 bytes."""
    height, width = image.shape[:2]
    depth = 8 if image.ndim == 2 else 24
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if depth == 8 else b""
    rows = image.reshape(height, -1) if depth == 8 else image[:, :, ::-1].reshape(height, -1)
    stride = -(-rows.shape[1] // 4) * 4
    padded = np.zeros((height, stride), np.uint8)
    padded[:, :rows.shape[1]] = rows
    offset = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", offset + padded.size, 0, 0, offset)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, 0, padded.size, 2835, 2835, 256 if palette else 0, 0)
    return head + info + palette + padded[::-1].tobytes()


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """``count`` decimal fields after the magic number, comments skipped, and where the raster begins."""
    at, fields = 2, []
    while len(fields) < count:
        while at < len(data) and (data[at:at + 1].isspace() or data[at:at + 1] == b"#"):
            if data[at:at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("netpbm header")
        fields.append(int(data[at:end]))
        at = end
    return fields, at + 1


def read_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    (width, height, *rest), at = _header(data, 2 if kind in (1, 4) else 3)
    most = rest[0] if rest else 1
    planes = 3 if kind in (3, 6) else 1
    if width < 1 or height < 1 or not 1 <= most <= 65535:
        raise ValueError("netpbm size")
    if kind == 1:
        bits = bytes(c for c in data[at:] if c in b"01")[:width * height]
        values = 1 - (np.frombuffer(bits, np.uint8) - 48)
    elif kind == 4:
        stride = -(-width // 8)
        raster = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
        values = 1 - np.unpackbits(raster, axis=1)[:, :width].ravel()
    elif kind in (2, 3):
        values = np.array(data[at:].split()[:width * height * planes], dtype=np.int64)  # OverflowError where a sample needs more
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else np.dtype(">u2"), width * height * planes, at)
    if values.size != width * height * planes:
        raise ValueError("netpbm raster is short")
    if kind in (2, 3, 5, 6) and (values.min() < 0 or values.max() > most):
        raise ValueError("netpbm sample out of range")
    values = values.astype(np.uint8 if most < 256 else np.uint16) * np.uint8(255 if kind in (1, 4) else 1)
    return values.reshape((height, width, 3) if planes == 3 else (height, width))


def read_bmp(data: bytes) -> np.ndarray:
    offset, = struct.unpack_from("<I", data, 10)
    size, width, height, _, depth, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing not in (0, 3) or depth not in (8, 24, 32) or width < 1 or not height:
        raise ValueError("bmp kind")
    stride = -(-width * depth // 32) * 4
    raster = np.frombuffer(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)
    raster = raster[::-1] if height > 0 else raster
    pixels = raster[:, :width * depth // 8]
    if depth > 8:
        return np.ascontiguousarray(pixels.reshape(abs(height), width, depth // 8)[:, :, 2::-1])
    used, = struct.unpack_from("<I", data, 46)
    palette = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + size).reshape(-1, 4)[:, 2::-1]
    shown = palette[pixels]
    return np.ascontiguousarray(shown[:, :, 0]) if (palette[:, :1] == palette).all() else shown


def decode(data: bytes) -> np.ndarray:
    """Image as (height, width) or (height, width, 3); ValueError where the bytes are no such image."""
    try:
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return read_netpbm(data)
        if data[:2] == b"BM":
            return read_bmp(data)
    except (struct.error, IndexError, OverflowError) as error:
        raise ValueError(str(error)) from error
    raise ValueError("neither netpbm nor bmp")


# -- features --------------------------------------------------------------------------------------------------------

def area_resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean over the exact source area of each target pixel: an integral image read at fractional corners."""
    grey = image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64).mean(axis=2)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0), axis=1, out=total[1:, 1:])

    def at(edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), table.shape[0] - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    rows = at(np.arange(height + 1) * grey.shape[0] / height, total)
    corners = at(np.arange(width + 1) * grey.shape[1] / width, rows.T).T
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums * (width * height / grey.size)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: bit set where a pixel of the 9 x 8 thumbnail is brighter than its right neighbour."""
    small = np.round(area_resize(image, 9, 8), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, side: int) -> Iterator[tuple[int, int, np.ndarray]]:
    for top in range(0, image.shape[0], side):
        for left in range(0, image.shape[1], side):
            yield top // side, left // side, image[top:top + side, left:left + side]


def from_tiles(pieces: list[tuple[int, int, bytes]], side: int) -> tuple[np.ndarray, list[str]]:
    """The image that NPY tiles make up, read back from their bytes, and the difference hash of each tile."""
    read = [(r, c, np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)) for r, c, data in pieces]
    height, width = (max(place * side + tile.shape[axis] for *at, tile in read for place in (at[axis],)) for axis in (0, 1))
    image = np.zeros((height, width, *read[0][2].shape[2:]), read[0][2].dtype)
    for r, c, tile in read:
        image[r * side:r * side + tile.shape[0], c * side:c * side + tile.shape[1]] = tile
    return image, [difference_hash(tile) for *_, tile in read]


def payload_of(text: str | None) -> tuple[int, np.ndarray]:
    """(UTF-8 bytes, samples padded with 0 to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8")
    samples = np.zeros(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), np.uint8)
    samples[:len(raw)] = np.frombuffer(raw, np.uint8)
    return len(raw), samples


# -- operators -------------------------------------------------------------------------------------------------------

def texts_as_media(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", bmp: bool = False) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a grey image 64 samples wide (P5, or 8-bit BMP). A null text is empty; no other column is read."""
    def store(batches):
        for batch in slices(batches, "text"):
            counts, stored = [], []
            for text in batch.column(1).to_pylist():
                n, samples = payload_of(text)
                counts.append(n)
                image = samples.reshape(-1, WIDTH)
                stored.append(write_bmp(image) if bmp else write_netpbm(image))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "media"])

    narrow = df.select(col(id_column).cast("bigint").alias("doc_id"), col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(store, "doc_id bigint, n_bytes bigint, media binary")


def media_features(media: DataFrame, *, columns: tuple[str, ...] = ("doc_id", "n_bytes"), media_column: str = "media", side: int = 256) -> DataFrame:
    """Payload digests and difference hashes of stored images: decoded, written as NPY tiles of ``side`` samples, read back from the tiles.

    Adds payload_bytes, payload_sha256, tail_crc32 (last 64 bytes), media_bytes, media_sha256, feature (difference hash of the whole
    image), tiles (their number) and tiles_sha256 (of the tiles' difference hashes in order, 16 hex digits each) to ``columns``.
    Null or unreadable media give nulls in what needs the image.
    """
    names = [*columns, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tiles", "tiles_sha256"]

    def read(batches):
        for batch in slices(batches, media_column):
            rows = []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                if data is None:
                    rows.append((None,) * 8)
                    continue
                try:
                    image, hashes = from_tiles([(r, c, npy(tile)) for r, c, tile in tiles(decode(data), side)], side)
                    raw = image.tobytes()
                    image_row = (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]))
                    features = (difference_hash(image), len(hashes), hashlib.sha256("".join(hashes).encode()).hexdigest())
                except ValueError:
                    image_row, features = (None,) * 3, (None,) * 3
                rows.append((*image_row, len(data), hashlib.sha256(data).hexdigest(), *features))
            made = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(columns))] + [pa.array(v, k) for v, k in zip(made, kinds)], names)

    chosen = media.select(*[col(c) for c in columns], col(media_column).alias(media_column))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(read, f"{kept}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tiles int, tiles_sha256 string")


def media_tiles(media: DataFrame, *, id_column: str = "doc_id", media_column: str = "media", side: int = 64,
                resize: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, tile_row, tile_column, npy, feature: tiles of each image (area-resized to (width, height) first, if given) as NPY bytes.

    Null media and bytes that are no image give one row with null tile, so no input row vanishes.
    """
    def cut(batches):
        for batch in slices(batches, "media"):
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    image = decode(data or b"")
                except ValueError:
                    rows.append((key, None, None, None, None))
                    continue
                if resize:
                    image = np.clip(np.rint(area_resize(image, *resize)), 0, np.iinfo(image.dtype).max).astype(image.dtype)
                rows += [(key, r, c, npy(tile), difference_hash(tile)) for r, c, tile in tiles(image, side)]
            made = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds)], ["doc_id", "tile_row", "tile_column", "npy", "feature"])

    narrow = media.select(col(id_column).cast("bigint").alias("doc_id"), col(media_column).alias("media"))
    return narrow.mapInArrow(cut, "doc_id bigint, tile_row int, tile_column int, npy binary, feature string")
