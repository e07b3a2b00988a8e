"""8-bit PNG files as strips of rows: files are read by Spark, inflated bit by bit and unfiltered strip by
strip, so no row is as large as a frame."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import reflected

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type (grey, RGB, grey with alpha, RGB with alpha).
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
READ = 1 << 18
STRIP = "path string, height int, width int, y0 int, h int, data binary"


def header(data: bytes) -> tuple[int, int, int]:
    """(height, width, channels) of a PNG; fails on other files, palettes, 16 bits and interlaced rows."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError(f"depth {depth}, colour type {colour}, interlace {interlace}: only plain 8-bit grey or RGB rows are read")
    return height, width, CHANNELS[colour]


def compressed(data: bytes) -> Iterator[memoryview]:
    """The compressed pixel data of a file, in pieces."""
    at, view = 8, memoryview(data)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            for a in range(at + 8, at + 8 + size, READ):
                yield view[a : min(a + READ, at + 8 + size)]
        at += size + 12


def unfiltered(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Bytes of filtered rows (rows, bytes), given the row above the first.

    Rows that take nothing from the row above, or all of it, are added up at once.  Otherwise a row
    depends on the pixels to its left and above, so pixels whose places and rows add up to the same number
    are worked out together, over all rows of the strip."""
    n, size = lines.shape
    if (kinds <= 2).all():
        out, last = np.empty_like(lines), above
        for i, kind in enumerate(kinds):
            last = lines[i] if kind == 0 else np.cumsum(lines[i].reshape(-1, step), 0, np.uint8).ravel() if kind == 1 else lines[i] + last
            out[i] = last
        return out
    wide = size // step
    # One row and one pixel of margin; a pixel's samples stay together.
    out = np.zeros((n + 1, wide + 1, step), np.int16)
    out[0, 1:] = above.reshape(wide, step)
    raw = lines.reshape(n, wide, step).astype(np.int16)
    for d in range(n + wide - 1):
        r = np.arange(max(0, d - wide + 1), min(n, d + 1))
        c = d - r
        a, b, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        guess = a + b - corner
        pa_, pb, pc_ = abs(guess - a), abs(guess - b), abs(guess - corner)
        paeth = np.where((pa_ <= pb) & (pa_ <= pc_), a, np.where(pb <= pc_, b, corner))
        kind = kinds[r][:, None]
        out[r + 1, c + 1] = (raw[r, c] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) >> 1, paeth], 0)) & 255
    return out[1:, 1:].astype(np.uint8).reshape(n, size)


def grey(px: np.ndarray) -> np.ndarray:
    """Grey of rows (h, w, c) in RGB order (0.299, 0.587, 0.114), rounded; alpha is left out."""
    if px.shape[2] < 3:
        return px[:, :, 0]
    return np.rint(px[:, :, :3].astype(float) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def strips_of(data: bytes, rows: int, first: int = 0, end: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(y0, grey rows) of a file, `rows` at a time, of the strips that touch rows first to end; what comes
    after them isn't inflated."""
    height, width, channels = header(data)
    end = height if end is None else min(end, height)
    line, inflate = width * channels + 1, zlib.decompressobj()
    above, y, left = np.zeros(line - 1, np.uint8), 0, bytearray()
    for piece in compressed(data):
        left += inflate.decompress(piece)
        while y < end and len(left) >= (n := min(rows, height - y)) * line:
            block = np.frombuffer(bytes(left[: n * line]), np.uint8).reshape(n, line)
            del left[: n * line]
            px = unfiltered(block[:, 0], block[:, 1:], above, channels)
            above = px[-1]
            if y + n > first:
                yield y, grey(px.reshape(n, width, channels))
            y += n
        if y >= end:
            return
    raise ValueError(f"{height - y} rows are missing")


def png_sizes(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, height, width) of PNG files, from their first bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    size = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return files.select("path", size(21).alias("height"), size(17).alias("width"))


def png_strips(spark: SparkSession, folder: str, pattern: str, rows: int = 256, first: int = 0, end: int | None = None) -> DataFrame:
    """(path, height, width, y0, h, data): grey strips of `rows` rows of all files of a pattern, as bytes row by
    row; only those that touch rows first to end, where given.  A task holds one compressed file and one
    strip."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                data = data.as_py()
                height, width, _ = header(data)
                for y0, px in strips_of(data, rows, first, end):
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), *[pa.array([v], pa.int32()) for v in (height, width, y0, len(px))], pa.array([px.tobytes()], pa.binary())], names=[c.split()[0] for c in STRIP.split(", ")])

    return files.select("path", "content").mapInArrow(read, STRIP)


def strip_tiles(strips: DataFrame, size: int) -> DataFrame:
    """(path, ty, tx, y0, x0, h, w, data): strips of `size` rows cut into tiles, without a shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                g = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["width"])
                parts = [(r["path"], r["y0"] // size, x // size, r["y0"], x, *(t := np.ascontiguousarray(g[:, x : x + size])).shape, t.tobytes()) for x in range(0, r["width"], size)]
                kinds = [pa.string(), *[pa.int32()] * 6, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts), kinds)], names="path ty tx y0 x0 h w data".split())

    return strips.select("path", "width", "y0", "h", "data").mapInArrow(cut, "path string, ty int, tx int, y0 int, x0 int, h int, w int, data binary")


def strip_runs(strips: DataFrame, above: int = 0) -> DataFrame:
    """(image_id, y, x0, x1): runs of the pixels of strips that are above a value; image_id is the path."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                on = np.zeros((r["h"], r["width"] + 2), np.int8)
                on[:, 1:-1] = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["width"]) > above
                edge = np.diff(on, axis=1)
                y, x0 = np.nonzero(edge == 1)
                x1 = np.nonzero(edge == -1)[1] - 1
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(y), pa.string()), pa.array(y + r["y0"]), pa.array(x0), pa.array(x1)], names=["image_id", "y", "x0", "x1"])

    return strips.select("path", "width", "y0", "h", "data").mapInArrow(find, "image_id string, y long, x0 long, x1 long")


def patches_of_strips(strips: DataFrame, patch: int, stride: int) -> DataFrame:
    """(path, y0, x0, data): patches of strips that stand in a grid of `stride`, as bytes row by row.

    Each strip is cut into its parts of the patches; parts of a patch meet by (path, y0, x0) and are put
    one below the other.  Where a strip holds whole patches (rows = patch = stride) nothing has to meet,
    and nothing is shuffled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                y, h, height, width = r["y0"], r["h"], r["height"], r["width"]
                g = np.frombuffer(r["data"], np.uint8).reshape(h, width)
                for top in range(max(0, -(-(y - patch + 1) // stride)) * stride, min(y + h - 1, height - patch) + 1, stride):
                    rows = g[max(0, top - y) : top + patch - y]
                    xs = range(0, width - patch + 1, stride)
                    if len(xs):
                        data = [np.ascontiguousarray(rows[:, x : x + patch]).tobytes() for x in xs]
                        yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(xs)), pa.array([top] * len(xs), pa.int32()), pa.array(list(xs), pa.int32()), pa.array([max(0, y - top)] * len(xs), pa.int32()), pa.array([len(rows)] * len(xs), pa.int32()), pa.array(data, pa.binary())], names=["path", "y0", "x0", "from", "rows", "data"])

    parts = strips.select("path", "height", "width", "y0", "h", "data").mapInArrow(cut, "path string, y0 int, x0 int, from int, rows int, data binary")
    whole = parts.where(F.col("rows") == patch).select("path", "y0", "x0", "data")
    met = parts.where(F.col("rows") < patch).groupBy("path", "y0", "x0").agg(F.sort_array(F.collect_list(F.struct("from", "data"))).alias("p"))  # a patch's own bytes
    return whole.unionByName(met.select("path", "y0", "x0", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["data"])).alias("data")))


def padded_strip_tiles(strips: DataFrame, size: int) -> DataFrame:
    """(path, height, width, y0, x0, h, w, data): square tiles of strips padded by reflection to whole tiles, as
    files.padded_tiles has them, for files.score_tiles and files.scored_pixels.

    A strip gives its rows to the tiles they lie in and, near the lower edge, mirrored ones to the tiles
    beyond; the parts of a tile meet by (path, y0, x0) unless a strip holds all its rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                y, h, height, width = r["y0"], r["h"], r["height"], r["width"]
                g = np.frombuffer(r["data"], np.uint8).reshape(h, width)[:, reflected(width, size)]
                source = reflected(height, size)
                own = np.flatnonzero((source >= y) & (source < y + h))  # padded rows that this strip has
                for rows in np.split(own, np.flatnonzero((np.diff(own) > 1) | (np.diff(own // size) > 0)) + 1):
                    top = int(rows[0]) // size * size
                    xs = range(0, g.shape[1], size)
                    data = [np.ascontiguousarray(g[source[rows] - y, x : x + size]).tobytes() for x in xs]
                    n = len(xs)
                    numbers = [pa.array([v] * n, pa.int32()) for v in (height, width, top)] + [pa.array(list(xs), pa.int32())] + [pa.array([v] * n, pa.int32()) for v in (int(rows[0]) - top, len(rows))]
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * n), *numbers, pa.array(data, pa.binary())], names=["path", "height", "width", "y0", "x0", "from", "rows", "data"])

    parts = strips.select("path", "height", "width", "y0", "h", "data").mapInArrow(cut, "path string, height int, width int, y0 int, x0 int, from int, rows int, data binary")
    keys = ["path", "height", "width", "y0", "x0"]
    whole = parts.where(F.col("rows") == size).select(*keys, "data")
    met = parts.where(F.col("rows") < size).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("from", "data"))).alias("p"))  # a tile's own bytes
    met = met.select(*keys, F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["data"])).alias("data"))
    return whole.unionByName(met).select(*keys, F.lit(size).alias("h"), F.lit(size).alias("w"), "data")


def training_patches(frames: DataFrame, masks: DataFrame, pairs: DataFrame, patch: int, stride: int) -> DataFrame:
    """(image_id, y0, x0, pixels, mask, positive_pixels): patches of frames with those of their masks (255 where
    above 0), from strips of both and pairs (image_id, image_path, mask_path)."""
    f = patches_of_strips(frames, patch, stride).join(pairs.select("image_id", F.col("image_path").alias("path")), "path").select("image_id", "y0", "x0", F.col("data").alias("pixels"))
    m = patches_of_strips(masks, patch, stride).join(pairs.select("image_id", F.col("mask_path").alias("path")), "path").select("image_id", "y0", "x0", F.col("data").alias("mask"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = [np.frombuffer(x.as_buffer(), np.uint8) > 0 for x in b.column("mask")]
            cols = [b.column(i) for i in range(4)] + [pa.array([(x * np.uint8(255)).tobytes() for x in on], pa.binary()), pa.array([int(x.sum()) for x in on], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:4], "mask", "positive_pixels"])

    both = f.join(m, ["image_id", "y0", "x0"])
    return both.mapInArrow(count, T.StructType([*both.schema.fields, T.StructField("positive_pixels", T.LongType())]))
