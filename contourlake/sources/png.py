"""PNG files as rows of pixels: 8-bit images of color types 2, 3 and 6 without interlace."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import put_whole

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by color type (fixed values).
SAMPLES = {2: 3, 3: 1, 6: 4}


def _unfilter(raw: bytes, width: int, height: int, size: int) -> np.ndarray:
    """Lines of samples from filtered ones; filters 0 to 2 work on whole lines, 3 and 4 pixel by pixel."""
    row = width * size
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(height):
        kind, line = raw[y * (row + 1)], np.frombuffer(raw, np.uint8, row, y * (row + 1) + 1)
        if kind == 0:
            now = line.copy()
        elif kind == 1:
            now = np.cumsum(line.reshape(width, size), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind == 2:
            now = line + above
        elif kind in (3, 4):
            now = np.frombuffer(_predicted(kind, line.tobytes(), above.tobytes(), size), np.uint8)
        else:
            raise ValueError(f"filter {kind}")
        out[y] = above = now
    return out


def _predicted(kind: int, line: bytes, above: bytes, size: int) -> bytearray:
    """A line of filter 3 (the mean of left and above) or 4 (the nearest of left, above and above left to a + b - c)."""
    out = bytearray(size) + bytearray(line)  # as if a pixel of zeros stood before
    up = bytes(size) + above
    for i in range(size, len(out)):
        a, b, c = out[i - size], up[i], up[i - size]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if da <= db and da <= dc else b if db <= dc else c
        out[i] = (out[i] + guess) & 255
    return out[size:]


def decode(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA bytes); an error for anything else than the supported forms. Checksums are not read."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, body, colors, alphas, head = 8, b"", b"", b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            colors = chunk
        elif kind == b"tRNS":
            alphas = chunk
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
        at += size + 12
    if head is None:
        raise ValueError("no header")
    width, height, depth, color, _, _, interlace = head
    if depth != 8 or interlace or color not in SAMPLES:
        raise ValueError(f"depth {depth}, color type {color}, interlace {interlace}")
    lines = _unfilter(zlib.decompress(body), width, height, SAMPLES[color]).reshape(height * width, SAMPLES[color])
    out = np.full((height * width, 4), 255, np.uint8)
    if color == 3:
        table = np.full((256, 4), 255, np.uint8)
        rgb = np.frombuffer(colors, np.uint8).reshape(-1, 3)
        table[: len(rgb), :3] = rgb
        table[: len(alphas), 3] = np.frombuffer(alphas, np.uint8)
        out = table[lines[:, 0]]
    else:
        out[:, : SAMPLES[color]] = lines
    return width, height, out.tobytes()


def _filtered(kind: int, line: np.ndarray, above: np.ndarray, size: int) -> np.ndarray:
    """A line of samples under a filter: what _unfilter undoes."""
    left, corner = (np.concatenate((np.zeros(size, np.int64), x[:-size])) for x in (line, above))
    far = [np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)]
    nearest = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
    return (line - (np.zeros_like(line), left, above, (left + above) // 2, nearest)[kind]) % 256


def encode_filtered(width: int, height: int, rgba: bytes) -> bytes:
    """An RGBA image as PNG whose lines take the five filters in turn."""
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    rows = np.frombuffer(rgba, np.uint8).reshape(height, width * 4).astype(np.int64)
    above = np.vstack((np.zeros((1, width * 4), np.int64), rows[:-1]))
    lines = b"".join(bytes([y % 5]) + _filtered(y % 5, rows[y], above[y], 4).astype(np.uint8).tobytes() for y in range(height))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_images(pixels: DataFrame, folder: str) -> None:
    """Each image as the file image_id.png of the folder, written by the executors through the folder's own file system.

    An image is one group, which the sources bound at a million pixels; pixels
    without a row are transparent.
    """

    def run(pdf):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        width, height = int(pdf["width"].iloc[0]), int(pdf["height"].iloc[0])
        rgba = np.zeros((height, width, 4), np.uint8)
        rgba[pdf["y"], pdf["x"]] = pdf[["r", "g", "b", "a"]].to_numpy(np.uint8)
        put_whole(store, f"{path}/{pdf['image_id'].iloc[0]}.png", lambda out: out.write(encode_filtered(width, height, rgba.tobytes())))
        return pdf.iloc[:1][["image_id"]]

    pixels.groupBy("image_id").applyInPandas(run, "image_id string").agg(F.count("*")).collect()


def encode(width: int, height: int, rgba: bytes) -> bytes:
    """An RGBA image as PNG."""
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    lines = b"".join(b"\0" + rgba[y * width * 4 : (y + 1) * width * 4] for y in range(height))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def by_name(name: str) -> list[Column]:
    """The order of names by the Unicode collation: letters before their case and accents; equal ones by code points."""
    return [F.collate(F.col(name), "UNICODE"), F.col(name)]


#: Files, and bytes of them, that a task reads about; Spark alone makes a task of every few small files.
FILES, BYTES = 256, 16 << 20


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the folder's .png files of any case, in no order; an error where there are none."""
    files = spark.read.format("binaryFile").load(folder).where(F.lower("path").endswith(".png"))
    least = spark.sparkContext.defaultParallelism
    n, size = files.select("length").coalesce(least).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).head()
    if not n:
        raise FileNotFoundError(f"no .png files in {folder}")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").coalesce(max(least, n // FILES, size // BYTES))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the same files, by name as readers sort them."""
    return listed(spark, folder).orderBy(*by_name("name"))


def uploads(files: DataFrame) -> DataFrame:
    """Rows with the MIME type of PNG."""
    return files.where(F.col("mime") == "image/png")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.png$", "")


def decoded(files: DataFrame, name_col: str = "name") -> DataFrame:
    """(image_id, width, height, pixels, error): one row a file; files that do not decode have their error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for batch in batches:
            for name, data in zip(*batch.columns, strict=True):
                try:
                    row = (name.as_py(), *decode(data.as_py() or b""), None)
                except (ValueError, zlib.error, struct.error, IndexError) as e:
                    row = (name.as_py(), None, None, None, str(e))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["image_id", "width", "height", "pixels", "error"])

    return files.select(stem(F.col(name_col)).alias("image_id"), "content").mapInArrow(run, "image_id string, width int, height int, pixels binary, error string")


def valid(images: DataFrame) -> DataFrame:
    """images with an error where the buffer does not hold width * height * 4 bytes."""
    fits = F.octet_length("pixels") == F.col("width") * F.col("height") * 4
    return images.withColumn("error", F.when(F.col("error").isNull() & ~F.coalesce(fits, F.lit(False)), F.lit("buffer size")).otherwise(F.col("error")))


def to_pixels(images: DataFrame) -> DataFrame:
    """(image_id, width, height, x, y, r, g, b, a): one row a pixel, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, width, height, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = np.frombuffer(raw, np.uint8).reshape(-1, 4).astype(np.int32)
                at = np.arange(len(p), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([image] * len(p)), pa.array(np.full(len(p), width, np.int32)), pa.array(np.full(len(p), height, np.int32)), pa.array(at % width), pa.array(at // width), *(pa.array(p[:, k]) for k in range(4))], names=["image_id", "width", "height", "x", "y", "r", "g", "b", "a"])

    good = valid(images).where("error is null").select("image_id", "width", "height", "pixels")
    return good.mapInArrow(run, "image_id string, width int, height int, x int, y int, r int, g int, b int, a int")


def read_images(spark: SparkSession, folder: str, max_dim: int = 1000) -> DataFrame:
    """Pixels of all images of a folder, scaled to max_dim on their longer side."""
    from ..operators.pixels import resize_bilinear

    return resize_bilinear(to_pixels(decoded(listed(spark, folder))), max_dim)
