"""GeoTIFF files as pixel tables: reading whole files, windows and bounds, a catalogue from headers, and writing.

Files come through Spark's binary reader, so they may lie in any store that Spark reaches.  A task decodes the blocks
(tiles or strips) of a file that meet the window, one after another, and gives their pixels as rows; what no block of the
window holds is never decoded.  Built for classic and big TIFF, both byte orders, uncompressed and deflated blocks,
the predictors 1 to 3, samples of 8 to 64 bits, together or in planes.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, from_filenames

#: Of each field type of the format: struct's letter and size.
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
# tags of the format, fixed values
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 322, 323, 324, 325, 339
SCALE, TIEPOINT, MATRIX, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
MODEL, RASTER, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
#: EPSG codes of coordinates in degrees that are written as geographic.
_DEGREES = range(4000, 5000)


@dataclass(frozen=True)
class Header:
    """What a file says of itself; blocks are (offset, size) in the order of planes, rows and columns."""

    width: int
    height: int
    samples: int
    dtype: np.dtype
    transform: tuple[float, ...]
    epsg: int | None
    nodata: float | None
    block: tuple[int, int]
    planes: bool
    compression: int
    predictor: int
    blocks: tuple[tuple[int, int], ...]

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        a, b, c, d, e, f = self.transform
        x, y = [c + a * i + b * j for i in (0, self.width) for j in (0, self.height)], [f + d * i + e * j for i in (0, self.width) for j in (0, self.height)]
        return min(x), min(y), max(x), max(y)

    def window(self, bounds: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
        """(first row, first column, rows, columns) of the pixels that meet a box of map units, within the file; a turned grid is an error."""
        a, b, c, d, e, f = self.transform
        if b or d:
            raise ValueError("bounds of a turned grid")
        cols, rows = sorted((x - c) / a for x in (bounds[0], bounds[2])), sorted((y - f) / e for y in (bounds[1], bounds[3]))
        span = lambda lo, hi, n: (min(max(math.floor(lo + 1e-9), 0), n), min(max(math.ceil(hi - 1e-9), 0), n))
        (x0, x1), (y0, y1) = span(*cols, self.width), span(*rows, self.height)
        return y0, x0, max(y1 - y0, 0), max(x1 - x0, 0)


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    count = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at, step, inline = at + (8 if big else 2), 20 if big else 12, 8 if big else 4
    out = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, at + k * step)
        if kind not in _TYPES:
            continue
        letter, size = _TYPES[kind]
        place = at + k * step + step - inline
        if n * size > inline:
            place = struct.unpack_from(order + ("Q" if big else "I"), data, place)[0]
        out[tag] = struct.unpack_from(f"{order}{n}{letter}", data, place)
    return order, out


def parse(data: bytes) -> Header:
    """The header of a file's first image."""
    order, t = _tags(data)
    one = lambda tag, other: t.get(tag, (other,))[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
    tiled = TILES in t
    block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS, height), height), width)
    if MATRIX in t:
        m = t[MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in t and TIEPOINT in t:
        (sx, sy), (i, j, _, x, y) = t[SCALE][:2], t[TIEPOINT][:5]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    keys = t.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    nodata = t.get(NODATA, (b"",))[0].rstrip(b"\0 ")
    blocks = tuple(zip(t[TILES if tiled else STRIPS], t[TILE_SIZES if tiled else STRIP_SIZES], strict=True))
    return Header(width, height, samples, np.dtype(f"{order}{kind}{one(BITS, 8) // 8}"), tuple(map(float, transform)), codes.get(PROJECTED, codes.get(GEOGRAPHIC)), float(nodata) if nodata else None, block, one(PLANAR, 1) == 2, one(COMPRESSION, 1), one(PREDICTOR, 1), blocks)


def _block(data: bytes, h: Header, number: int, rows: int) -> np.ndarray:
    """(rows, columns, samples) of a block."""
    offset, size = h.blocks[number]
    raw = data[offset : offset + size]
    if h.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif h.compression != 1:
        raise ValueError(f"compression {h.compression}")
    samples = 1 if h.planes else h.samples
    shape = (rows, h.block[1], samples)
    if h.predictor == 3:
        # bytes of a row lie together by weight, the highest first, as differences
        parts = np.cumsum(np.frombuffer(raw, np.uint8)[: rows * h.block[1] * samples * h.dtype.itemsize].reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        parts = parts.reshape(rows, h.dtype.itemsize, h.block[1] * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(parts).view(h.dtype.newbyteorder(">")).reshape(shape)
    x = np.frombuffer(raw, h.dtype, math.prod(shape)).reshape(shape)
    return np.cumsum(x, axis=1, dtype=h.dtype.newbyteorder("=")) if h.predictor == 2 else x


def decode(data: bytes, h: Header, window: tuple[int, int, int, int] | None = None, bands: list[int] | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(band from 1, first row, first column, values) of the blocks that meet the window, cut to it; no-data values are NaN."""
    y0, x0, rows, cols = window or (0, 0, h.height, h.width)
    y1, x1 = min(y0 + rows, h.height), min(x0 + cols, h.width)
    bands = bands or list(range(1, h.samples + 1))
    bh, bw = h.block
    across, down = -(-h.width // bw), -(-h.height // bh)
    strips = bw == h.width and len(h.blocks) == down * (h.samples if h.planes else 1)
    if y1 <= y0 or x1 <= x0:
        return
    for i in range(y0 // bh, -(-y1 // bh)):
        for j in range(x0 // bw, -(-x1 // bw)):
            high = min(bh, h.height - i * bh) if strips else bh
            top, left, bottom, right = max(y0, i * bh), max(x0, j * bw), min(y1, (i + 1) * bh), min(x1, (j + 1) * bw)
            shared = None if h.planes else _block(data, h, i * across + j, high)
            for b in bands:
                own = _block(data, h, ((b - 1) * down + i) * across + j, high)[:, :, 0] if h.planes else shared[:, :, b - 1]
                v = own[top - i * bh : bottom - i * bh, left - j * bw : right - j * bw].astype(np.float64)
                yield b, top, left, v if h.nodata is None else np.where(v == h.nodata, np.nan, v)


def encode(pixels: np.ndarray, transform: tuple[float, ...], epsg: int | None = None, nodata: float | None = None, tile: int = 256) -> bytes:
    """A file of (bands, rows, columns): header first, then deflated tiles, so that a reader finds a window by the first bytes."""
    n, height, width = pixels.shape
    x = np.ascontiguousarray(pixels.transpose(1, 2, 0)).astype(pixels.dtype.newbyteorder("<"))
    tiles = []
    for i in range(0, height, tile):
        for j in range(0, width, tile):
            part = np.zeros((tile, tile, n), x.dtype)
            own = x[i : i + tile, j : j + tile]
            part[: own.shape[0], : own.shape[1]] = own
            tiles.append(zlib.compress(part.tobytes()))
    a, b, c, d, e, f = transform
    degrees = epsg in _DEGREES if epsg else False
    keys = [1, 1, 0, 3, MODEL, 0, 1, 2 if degrees else 1, RASTER, 0, 1, 1, GEOGRAPHIC if degrees else PROJECTED, 0, 1, epsg or 32767]
    fields = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [x.dtype.itemsize * 8] * n), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [n]), (PLANAR, 3, [1]),
        (TILE_WIDTH, 3, [tile]), (TILE_HEIGHT, 3, [tile]), (TILES, 4, [0] * len(tiles)), (TILE_SIZES, 4, [len(t) for t in tiles]), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[x.dtype.kind]] * n),
        (MATRIX, 12, [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (GEO_KEYS, 3, keys),
    ]
    if nodata is not None:
        fields.append((NODATA, 2, [f"{nodata}\0".encode()]))
    packed = lambda kind, values: values[0] if kind == 2 else struct.pack(f"<{len(values)}{_TYPES[kind][0]}", *values)
    heap = 8 + 2 + 12 * len(fields) + 4
    at = heap + sum(len(v) + len(v) % 2 for v in (packed(k, x) for _, k, x in fields) if len(v) > 4)
    for k, (tag, kind, _) in enumerate(fields):
        if tag == TILES:
            fields[k] = (tag, kind, [at + sum(len(t) for t in tiles[:i]) for i in range(len(tiles))])
    head, rest = struct.pack("<2sHIH", b"II", 42, 8, len(fields)), b""
    for tag, kind, values in fields:
        v = packed(kind, values)
        head += struct.pack("<HHI", tag, kind, len(values[0]) if kind == 2 else len(values))
        if len(v) <= 4:
            head += v.ljust(4, b"\0")
        else:
            head += struct.pack("<I", heap + len(rest))
            rest += v + b"\0" * (len(v) % 2)
    return head + struct.pack("<I", 0) + rest + b"".join(tiles)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("filepath"), "content")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(filepath, xmin .. ymax, crs, width, height, bands, transform) of every file of a folder or pattern."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("filepath"), batch.column("content"), strict=True):
                h = parse(content.as_py())
                one = [path.as_py(), *h.bounds, f"EPSG:{h.epsg}" if h.epsg else None, h.width, h.height, h.samples, list(h.transform)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, types, strict=True)], names)

    names = ["filepath", "xmin", "ymin", "xmax", "ymax", "crs", "width", "height", "bands", "transform"]
    types = [pa.string(), *[pa.float64()] * 4, pa.string(), *[pa.int64()] * 3, pa.list_(pa.float64())]
    return _files(spark, path).mapInArrow(run, "filepath string, xmin double, ymin double, xmax double, ymax double, crs string, width long, height long, bands long, transform array<double>")


def read(spark: SparkSession, path: str, *, window: tuple[int, int, int, int] | None = None, bounds: tuple[float, float, float, float] | None = None, bands: list[int] | None = None) -> DataFrame:
    """(filepath, band, y, x, v): the pixels of every file, those of a window (first row, first column, rows, columns) or those that meet a box of map units.

    Rows and columns are those of the file; parts of the window or box outside of it have no rows.
    """

    if window and bounds:
        raise ValueError("either a window or bounds")
    return _pixels(_files(spark, path), window, bounds, bands)


def _pixels(files: DataFrame, window, bounds, bands) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("filepath"), batch.column("content"), strict=True):
                data, own = content.as_py(), name.as_py()
                h = parse(data)
                for b, top, left, v in decode(data, h, h.window(bounds) if bounds else window, bands):
                    y, x = np.indices(v.shape)
                    yield pa.RecordBatch.from_arrays([pa.array([own] * v.size), pa.array(np.full(v.size, b)), pa.array(y.ravel() + top), pa.array(x.ravel() + left), pa.array(v.ravel())], ["filepath", "band", "y", "x", "v"])

    return files.mapInArrow(run, "filepath string, band long, y long, x long, v double")


def build_catalog(spark: SparkSession, path: str, pattern: str = "", *, crs: str | None = None, date_format: str = "yyyyMMdd") -> Catalog:
    """A catalogue of the files of a folder or pattern, from their headers; times come from the file names as in from_filenames().

    All files must have one CRS, or those of `crs` are taken.
    """
    found = headers(spark, path)
    if crs is None:
        known = [r[0] for r in found.select("crs").distinct().limit(2).collect()]
        if len(known) > 1:
            raise ValueError("the files have several CRS; name one")
        crs = known[0] if known and known[0] else "EPSG:4326"
    else:
        found = found.where(F.col("crs") == crs)
    return from_filenames(found.select("filepath"), pattern, found.drop("crs"), date_format=date_format, crs=crs, backend="raster")


def load(catalog: Catalog, *, bounds: tuple[float, float, float, float] | None = None, bands: list[int] | None = None) -> DataFrame:
    """(filepath, start_time, band, y, x, v): the pixels of a catalogue's files that meet a box of map units.

    The catalogue's rows choose the files; only these are read.
    """
    chosen = catalog.query(bounds=bounds).df if bounds else catalog.df
    spark = chosen.sparkSession
    # the names of files alone come to the driver, as for any read of named files
    names = [r[0] for r in chosen.select("filepath").distinct().collect()]
    if not names:
        return spark.createDataFrame([], "filepath string, start_time timestamp, band long, y long, x long, v double")
    pixels = _pixels(spark.read.format("binaryFile").load(names).select(F.col("path").alias("filepath"), "content"), None, bounds, bands)
    return pixels.join(chosen.select("filepath", "start_time"), "filepath").select("filepath", "start_time", "band", "y", "x", "v")


def read_tile(spark: SparkSession, path: str, row: int, col: int, size: tuple[int, int] = (256, 256), bands: list[int] | None = None) -> DataFrame:
    """The pixels of a tile of a regular division of each file."""
    return read(spark, path, window=(row * size[0], col * size[1], *size), bands=bands)


def write(pixels: DataFrame, path: str, shape: tuple[int, int], *, by: list[str], transform=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0), epsg: int | None = None, dtype: str = "float64", nodata: float | None = None, tile: int = 256) -> None:
    """A file for each group `by` of rows (by, band, y, x, v), band from 1; cells without a row are `nodata`, or NaN in files of floats.

    A group is one task's.  Files are named by Spark; a line feed behind a file's last tile is no part of it.
    """
    kind = np.dtype(dtype)
    fill = nodata if nodata is not None else (np.nan if kind.kind == "f" else 0)

    def run(table: pa.Table) -> pa.Table:
        band, y, x, v = (table.column(c).to_numpy() for c in ("band", "y", "x", "v"))
        grid = np.full((int(band.max()), *shape), fill, kind)
        inside = (y >= 0) & (y < shape[0]) & (x >= 0) & (x < shape[1])
        value = np.where(np.isnan(v), fill, v) if nodata is not None else v
        grid[band[inside] - 1, y[inside], x[inside]] = value[inside]
        return pa.table({"content": pa.array([encode(grid, transform, epsg, nodata, tile)], pa.binary())})

    rows = pixels.select(*by, F.col("band").cast("long").alias("band"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))
    files = rows.groupBy(*by).applyInArrow(run, "content binary")
    files.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
