"""GeoTIFF files: reading of windows, writing in tiles, and a data source of pixels.

Covers baseline files of numbers, striped or tiled, plain or compressed by deflate or LZW, with or without a
horizontal predictor, of either byte order, bands together or apart. Values of tags are those of the format.
"""

from __future__ import annotations

import struct
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes and struct codes of the field types.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
#: Tags.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_FORMAT, SCALE, TIEPOINT, MATRIX, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
FORMATS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (1, 64): "u8", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (2, 64): "i8", (3, 32): "f4", (3, 64): "f8"}


@dataclass
class RasterMeta:
    width: int
    height: int
    count: int
    dtype: str
    transform: tuple[float, float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    srid: int | None = None
    nodata: float | None = None
    extra: dict = field(default_factory=dict)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        a, b, c, d, e, f = self.transform
        xs = [a * x + b * y + c for x in (0, self.width) for y in (0, self.height)]
        ys = [d * x + e * y + f for x in (0, self.width) for y in (0, self.height)]
        return min(xs), min(ys), max(xs), max(ys)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the first bit highest; 256 starts anew and 257 ends."""
    out, table, width = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9
    bits = held = 0
    last: bytes | None = None
    for byte in data:
        bits = bits << 8 | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = bits >> held & (1 << width) - 1
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None:
            table.append(last + entry[:1])
        last = entry
        # codes grow one entry early in this format
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


class TiffFile:
    """Header of a file, and its windows."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as f:
            head = f.read(16)
            self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
            if self.order is None or struct.unpack(self.order + "H", head[2:4])[0] not in (42, 43):
                raise ValueError(f"{path} is no TIFF file")
            self.big = struct.unpack(self.order + "H", head[2:4])[0] == 43
            at = struct.unpack(self.order + ("Q" if self.big else "I"), head[8:16] if self.big else head[4:8])[0]
            f.seek(at)
            n = struct.unpack(self.order + ("Q" if self.big else "H"), f.read(8 if self.big else 2))[0]
            size = 20 if self.big else 12
            entries = f.read(n * size)
            self.tags: dict[int, tuple] = {}
            for i in range(n):
                e = entries[i * size : (i + 1) * size]
                tag, kind = struct.unpack(self.order + "HH", e[:4])
                count = struct.unpack(self.order + ("Q" if self.big else "I"), e[4:12] if self.big else e[4:8])[0]
                if kind not in TYPES:
                    continue
                nbytes, code = TYPES[kind]
                value = e[12:] if self.big else e[8:]
                if nbytes * count > len(value):
                    f.seek(struct.unpack(self.order + ("Q" if self.big else "I"), value)[0])
                    value = f.read(nbytes * count)
                value = value[: nbytes * count]
                self.tags[tag] = (value,) if kind == 2 else struct.unpack(f"{self.order}{code * count if kind == 5 else f'{count}{code}'}", value)
        one = lambda tag, other: self.tags.get(tag, (other,))[0]
        self.width, self.height, self.count = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        self.dtype = np.dtype(self.order + FORMATS[one(SAMPLE_FORMAT, 1), one(BITS, 1)])
        self.compression, self.predictor, self.apart = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2
        self.tiled = TILE_AT in self.tags
        self.block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if self.tiled else (min(one(ROWS_PER_STRIP, self.height), self.height), self.width)
        self.at, self.sizes = (self.tags[TILE_AT], self.tags[TILE_BYTES]) if self.tiled else (self.tags[STRIP_AT], self.tags[STRIP_BYTES])

    def meta(self) -> RasterMeta:
        transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            transform = (m[0], m[1], m[3], m[4], m[5], m[7])
        elif SCALE in self.tags and TIEPOINT in self.tags:
            (sx, sy, *_), (i, j, _, x, y, *_) = self.tags[SCALE], self.tags[TIEPOINT]
            transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
        keys = self.tags.get(GEO_KEYS, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        nodata = self.tags.get(NODATA)
        return RasterMeta(self.width, self.height, self.count, self.dtype.newbyteorder("=").name, transform, codes.get(3072) or codes.get(2048), float(nodata[0].split(b"\0")[0]) if nodata else None)

    def _block(self, f, k: int, rows: int, samples: int) -> np.ndarray:
        f.seek(self.at[k])
        data = f.read(self.sizes[k])
        if self.compression in (8, 32946):
            data = zlib.decompress(data)
        elif self.compression == 5:
            data = _lzw(data)
        elif self.compression != 1:
            raise ValueError(f"Compression {self.compression} isn't supported")
        out = np.frombuffer(data, self.dtype, rows * self.block[1] * samples).reshape(rows, self.block[1], samples)
        return np.cumsum(out, axis=1, dtype=self.dtype) if self.predictor == 2 else out

    def read(self, row_off: int = 0, col_off: int = 0, height: int | None = None, width: int | None = None) -> np.ndarray:
        """(bands, rows, columns) of a window cut to the image."""
        height, width = min(height or self.height, self.height - row_off), min(width or self.width, self.width - col_off)
        out = np.zeros((self.count, height, width), self.dtype.newbyteorder("="))
        bh, bw = self.block
        across, down = -(-self.width // bw), -(-self.height // bh)
        with open(self.path, "rb") as f:
            for plane in range(self.count if self.apart else 1):
                for by in range(row_off // bh, -(-(row_off + height) // bh)):
                    for bx in range(col_off // bw, -(-(col_off + width) // bw)):
                        rows = bh if self.tiled else min(bh, self.height - by * bh)
                        part = self._block(f, plane * across * down + by * across + bx, rows, 1 if self.apart else self.count)
                        r0, r1 = max(row_off, by * bh), min(row_off + height, by * bh + rows)
                        c0, c1 = max(col_off, bx * bw), min(col_off + width, bx * bw + bw)
                        cut = np.moveaxis(part[r0 - by * bh : r1 - by * bh, c0 - bx * bw : c1 - bx * bw], 2, 0)
                        out[slice(plane, plane + 1) if self.apart else slice(None), r0 - row_off : r1 - row_off, c0 - col_off : c1 - col_off] = cut
        return out


def read_meta(path: str) -> RasterMeta:
    return TiffFile(path).meta()


def read_array(path: str) -> tuple[np.ndarray, RasterMeta]:
    f = TiffFile(path)
    return f.read(), f.meta()


def windows(height: int, width: int, tile_size: int = 1024, overlap: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(row_off, col_off, height, width) of the tiles, row by row, cut to the image."""
    step = tile_size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than tile_size")
    for r in range(0, height, step):
        for c in range(0, width, step):
            yield r, c, min(tile_size, height - r), min(tile_size, width - c)


def read_windows(path: str, tile_size: int = 1024, overlap: int = 0) -> Iterator[tuple[np.ndarray, RasterMeta, tuple[int, int]]]:
    """Each tile, with its own size and transform, and where it starts."""
    f = TiffFile(path)
    meta = f.meta()
    a, b, c, d, e, g = meta.transform
    for r, k, h, w in windows(f.height, f.width, tile_size, overlap):
        moved = (a, b, a * k + b * r + c, d, e, d * k + e * r + g)
        yield f.read(r, k, h, w), RasterMeta(w, h, meta.count, meta.dtype, moved, meta.srid, meta.nodata), (r, k)


def write_raster(path: str, data: np.ndarray, meta: RasterMeta | None = None, dtype: str | None = None, blocksize: int = 256, compress: str | None = "deflate", tiled: bool = True) -> None:
    """One file of (bands, rows, columns) or (rows, columns), bands apart. Warns where nothing says where it lies."""
    data = data[None] if data.ndim == 2 else data
    data = np.ascontiguousarray(data.astype(dtype or data.dtype))
    code = next((k for k, v in FORMATS.items() if v == data.dtype.newbyteorder("=").str[1:]), None)
    if code is None:
        raise ValueError(f"Values of type {data.dtype} can't be written")
    if compress not in (None, "none", "deflate"):
        raise ValueError(f"Compression {compress!r} can't be written")
    if meta is None or meta.srid is None:
        warnings.warn("The raster has no coordinate system", stacklevel=2)
    count, height, width = data.shape
    bh, bw = (-(-blocksize // 16) * 16,) * 2 if tiled else (min(height, max(1, 8192 // max(1, width * data.itemsize))), width)
    blocks = []
    for band in data:
        for r in range(0, height, bh):
            for c in range(0, width, bw):
                part = band[r : r + bh, c : c + bw]
                if tiled:
                    part = np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1])))
                raw = part.astype(data.dtype.newbyteorder("<")).tobytes()
                blocks.append(zlib.compress(raw, 6) if compress == "deflate" else raw)
    tags: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (code[1],) * count), (COMPRESSION, 3, (8 if compress == "deflate" else 1,)), (PHOTOMETRIC, 3, (1,)),
        (SAMPLES, 3, (count,)), (PLANAR, 3, (2,)), (SAMPLE_FORMAT, 3, (code[0],) * count),
    ]
    tags += [(TILE_WIDTH, 4, (bw,)), (TILE_HEIGHT, 4, (bh,))] if tiled else [(ROWS_PER_STRIP, 4, (bh,))]
    if meta is not None:
        a, b, c, d, e, f = meta.transform
        tags.append((MATRIX, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
        if meta.srid is not None:
            geographic = 4000 <= meta.srid < 5000
            tags.append((GEO_KEYS, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, meta.srid)))
        if meta.nodata is not None:
            tags.append((NODATA, 2, f"{meta.nodata:g}".encode() + b"\0"))
    at_tag, size_tag = (TILE_AT, TILE_BYTES) if tiled else (STRIP_AT, STRIP_BYTES)
    tags += [(at_tag, 4, (0,) * len(blocks)), (size_tag, 4, tuple(map(len, blocks)))]
    tags.sort(key=lambda t: t[0])
    body = 8 + 2 + 12 * len(tags) + 4
    packed = {tag: v if kind == 2 else struct.pack(f"<{len(v)}{TYPES[kind][1]}", *v) for tag, kind, v in tags}
    places, at = {}, body
    for tag, _, _ in tags:
        if len(packed[tag]) > 4:
            places[tag] = at
            at += len(packed[tag]) + len(packed[tag]) % 2
    starts = np.cumsum([at, *map(len, blocks)])[:-1]
    if at + sum(map(len, blocks)) >= 1 << 32:
        raise ValueError("The raster doesn't fit into one file of this format; write it as tiles")
    packed[at_tag] = struct.pack(f"<{len(blocks)}I", *starts.tolist())
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHIH", b"II", 42, 8, len(tags)))
        for tag, kind, v in tags:
            value = packed[tag]
            f.write(struct.pack("<HHI", tag, kind, len(v)) + (struct.pack("<I", places[tag]) if tag in places else value.ljust(4, b"\0")))
        f.write(struct.pack("<I", 0))
        for tag, _, _ in tags:
            if tag in places:
                f.write(packed[tag] + b"\0" * (len(packed[tag]) % 2))
        f.write(b"".join(blocks))


class _Window(InputPartition):
    def __init__(self, path: str, image_id: str, window: tuple[int, int, int, int]) -> None:
        self.path, self.image_id, self.window = path, image_id, window


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.tile = int(options.get("tilesize", 512))

    def partitions(self) -> list[_Window]:
        out = []
        for path in self.paths:
            f = TiffFile(path)
            stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            out += [_Window(path, stem, w) for w in windows(f.height, f.width, self.tile)]
        return out

    def read(self, partition: _Window):
        import pyarrow as pa

        r, c, h, w = partition.window
        data = TiffFile(partition.path).read(r, c, h, w).reshape(-1, h * w).astype("f8")
        rows, cols = np.divmod(np.arange(h * w, dtype="i4"), w)
        names = ["image_id", "row", "col", *(f"b{i}" for i in range(len(data)))]
        yield pa.RecordBatch.from_arrays([pa.array([partition.image_id] * (h * w)), pa.array((rows + r).astype("i4")), pa.array((cols + c).astype("i4")), *map(pa.array, data)], names)


class GeoTiffSource(DataSource):
    """spark.read.format("geotiff_pixels").load(path): image_id, row, col and the bands as doubles, a partition for
    each window of tileSize pixels. Several paths are given with commas; they have equally many bands."""

    @classmethod
    def name(cls) -> str:
        return "geotiff_pixels"

    def schema(self) -> str:
        first = self.options.get("path", "").split(",")[0]
        return "image_id string, row int, col int" + "".join(f", b{i} double" for i in range(TiffFile(first).count))

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_raster(spark: SparkSession, *paths: str, tile_size: int = 512) -> tuple[DataFrame, RasterMeta]:
    """The pixel relation of one or more files, and the first one's metadata."""
    spark.dataSource.register(GeoTiffSource)
    return spark.read.format("geotiff_pixels").option("tileSize", tile_size).load(",".join(paths)), read_meta(paths[0])


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, RasterMeta]:
    """row, col, segment_id from the first band of a file; ValueError if no label is above 0."""
    px, meta = read_raster(spark, path)
    out = px.select("row", "col", px["b0"].cast("int").alias("segment_id"))
    if not out.where("segment_id > 0").limit(1).count():
        raise ValueError(f"{path} holds no labels")
    return out, meta


def write_labels(px: DataFrame, path: str, meta: RasterMeta, column: str = "segment_id", dtype: str = "int32") -> None:
    """One image's labels as a file. The driver holds the whole raster, as the file is written by one process."""
    out = np.zeros((meta.height, meta.width), dtype)
    for r in px.select("row", "col", column).toLocalIterator():
        out[r[0], r[1]] = r[2]
    write_raster(path, out, RasterMeta(meta.width, meta.height, 1, dtype, meta.transform, meta.srid, 0.0))
