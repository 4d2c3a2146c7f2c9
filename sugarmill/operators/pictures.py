"""Pictures as bytes and as rows of pixels (image, y, x, b, g, r)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hex digits of a white pixel.
PAPER = "FFFFFF"
#: Pixels that are looked at or painted at once, about.
SPOTS = 1_000_000


def picture_pixels(pictures: DataFrame, *keys: str, paper: str | None = PAPER) -> DataFrame:
    """(keys, y, x, b, g, r) of three-channel ``pictures`` (height, width, data); pixels of the colour ``paper`` (hex of b, g, r) are left out.

    A picture becomes its lines first, and paper is dropped within a line, so that only drawn pixels become rows. Pictures that could not
    be read or have no pixels give no rows.
    """
    lines = pictures.filter("channels = 3 and height > 0 and width > 0").select(*keys, "width", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    return drawn(lines.select(*keys, "y", "width", F.expr("substring(data, y * width * 3 + 1, width * 3)").alias("line")), keys, paper)


def drawn(lines: DataFrame, keys: tuple[str, ...], paper: str | None) -> DataFrame:
    """(keys, y, x, b, g, r) of (keys, y, width, line), lines as bytes of b, g, r; without the colour ``paper``. Lines of paper alone go first."""
    if paper is not None:
        lines = lines.filter(F.col("line") != F.unhex(F.repeat(F.lit(paper), F.col("width"))))
    rows = lines.select(*keys, "y", "line", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    rows = rows.select(*keys, "y", "x", F.expr("substring(line, x * 3 + 1, 3)").alias("spot"))
    if paper is not None:
        rows = rows.filter(F.col("spot") != F.unhex(F.lit(paper)))
    return rows.select(*keys, "y", "x", *(F.conv(F.hex(F.substring("spot", at, 1)), 16, 10).cast("int").alias(c) for at, c in ((1, "b"), (2, "g"), (3, "r"))))


def bitmap_pixels(files: DataFrame, *keys: str, paper: str | None = PAPER) -> DataFrame:
    """As ``picture_pixels``, from the bytes (``content``) of uncompressed 24-bit BMP files; others give no rows and need ``folder_pictures``.

    Some lines of a picture are compared with paper at once. Lines that a file is too short for give no rows.
    """
    rows = files.select(*keys, "content")
    blank = None if paper is None else np.frombuffer(bytes.fromhex(paper), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for at, alike in runs(batch.column(len(keys))):
                for file, y, x, spots in spotted(alike, blank):
                    held.append((file + at, y, x, spots))
                    size += len(y)
                    if size >= SPOTS:
                        yield flat(batch, held)
                        held, size = [], 0
            if held:
                yield flat(batch, held)

    def flat(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        at, y, x, spots = (np.concatenate(c) for c in zip(*held, strict=True))
        columns = [*(batch.column(k).take(pa.array(at)) for k in range(len(keys))), pa.array(y), pa.array(x), *(pa.array(spots[:, k].astype(np.int32)) for k in range(3))]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, *"yxbgr"])

    schema = T.StructType([*rows.drop("content").schema.fields, *(T.StructField(c, T.IntegerType()) for c in "yxbgr")])
    return rows.mapInArrow(run, schema)


def runs(contents: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Files of 54 bytes or more as arrays with a row a file, those in a row that are of one size and begin with the same headers; with the place
    of the first. An array has about as many bytes as ``SPOTS`` pixels, or one file."""
    contents = contents.cast(pa.large_binary())
    ends = np.frombuffer(contents.buffers()[1], np.int64)[contents.offset :][: len(contents) + 1]
    size = np.diff(ends)
    for i, j in zip([0, *(cuts := (np.flatnonzero(np.diff(size)) + 1).tolist())], [*cuts, len(size)], strict=True):
        if i < j and size[i] >= 54:
            files = np.frombuffer(contents.buffers()[2], np.uint8)[ends[i] : ends[j]].reshape(j - i, size[i])
            other = np.flatnonzero((files[1:, :54] != files[:-1, :54]).any(1)) + 1
            step = max(1, int(3 * SPOTS // size[i]))
            starts = np.union1d(other, np.arange(0, j - i, step)).tolist()
            for a, b in zip(starts, [*starts[1:], j - i], strict=True):
                yield i + a, files[a:b]


def spotted(files: np.ndarray, blank: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(file, y, x, bytes of b, g, r) of the pixels that are not ``blank`` of BMP files that begin alike, some lines at a time; none of other files."""
    kind, start, width, high, bits, packed = struct.unpack("<2s8xI4xii2xHI", files[0, :34].tobytes())
    height, stride = abs(high), (3 * width + 3) // 4 * 4
    if kind != b"BM" or bits != 24 or packed or width <= 0 or not height:
        return
    n, size = files.shape
    there = min(height, (size - start + stride - 3 * width) // stride)  # a file may end without the last line's padding
    step = max(1, SPOTS // (width * n))
    for first in range(0, there, step):
        lines = min(step, there - first)
        part = files[:, start + first * stride : start + (first + lines) * stride]
        if part.shape[1] < lines * stride:
            part = np.pad(part, ((0, 0), (0, lines * stride - part.shape[1])))
        spots = part.reshape(n, lines, stride)[:, :, : 3 * width].reshape(n, lines, width, 3)
        file, y, x = np.nonzero(np.ones((n, lines, width), bool) if blank is None else np.logical_or.reduce([spots[..., k] != blank[k] for k in range(3)]))
        line = y + first
        yield file, (line if high < 0 else height - 1 - line).astype(np.int32), x.astype(np.int32), spots[file, y, x]


def bitmaps(pixels: DataFrame, key: str, width: int, height: int, paper: str = PAPER) -> DataFrame:
    """(key, picture): a 24-bit BMP of ``width`` x ``height`` for each key; pixels without a row are paper, those outside are left out.

    A picture's pixels are gathered as numbers, place and colour, and painted on an array of some pictures. Of several rows for a pixel the
    greatest colour counts.
    """
    inside = pixels.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    colour = F.col("b") * 65536 + F.col("g") * 256 + F.col("r")
    spots = inside.groupBy(key).agg(F.collect_list((F.col("y").cast("long") * width + F.col("x")) * (1 << 24) + colour).alias("spots"))
    head, plain, stride = np.frombuffer(bytes.fromhex(header(width, height)), np.uint8), bytes.fromhex(paper), (3 * width + 3) // 4 * 4
    step = max(1, SPOTS // (width * height))

    def painted(spots: pa.ListArray) -> pa.Array:
        n = len(spots)
        flat, of = spots.flatten().to_numpy(), np.repeat(np.arange(n), spots.value_lengths().to_numpy())
        canvas = np.full(n * width * height, -1, np.int32)
        np.maximum.at(canvas, of * (width * height) + (flat >> 24), (flat & 0xFFFFFF).astype(np.int32))
        canvas = canvas.reshape(n, height, width)[:, ::-1]  # a bitmap's lines stand from the last to the first
        out = np.zeros((n, len(head) + stride * height), np.uint8)
        out[:, : len(head)] = head
        lines = out[:, len(head) :].reshape(n, height, stride)
        for k in range(3):
            lines[:, :, k : 3 * width : 3] = np.where(canvas < 0, plain[k], canvas >> 16 - 8 * k & 255)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(out.shape[1])), pa.py_buffer(out)])

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for spots in batches:
            out = [painted(spots[at : at + step]) for at in range(0, len(spots), step)]
            yield pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return spots.select(key, run("spots").alias("picture"))


def header(width: int, height: int) -> str:
    """Hex of the two headers of an uncompressed 24-bit BMP."""
    size = (3 * width + 3) // 4 * 4 * height
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + size, 0, 0, 54, 40, width, height, 1, 24, 0, size, 2835, 2835, 0, 0).hex().upper()
