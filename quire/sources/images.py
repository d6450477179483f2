"""Page images: gray histograms, and runs of dark pixels below each image's own threshold."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.datasets import otsu

#: Shares of blue, green and red in luminance, in the byte order of image rows.
LUMINANCE = (0.0721, 0.7152, 0.2125)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image, width, height, channels, data) of image files, a row each."""
    rows = spark.read.format("image").load(path).select("image.*")
    return rows.select(F.col("origin").alias("image"), "width", "height", F.col("nChannels").alias("channels"), "data")


def _pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def _bins(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    def one(pixels: np.ndarray) -> list[int]:
        gray = pixels[:, :, 0] if pixels.shape[2] == 1 else np.floor(pixels[:, :, :3] @ np.array(LUMINANCE) + 1e-9).astype(np.uint8)
        return np.bincount(gray.ravel(), minlength=256).tolist()

    return pd.Series([one(_pixels(*row)) for row in zip(data, height, width, channels)])


def histogram(images: DataFrame) -> DataFrame:
    """(image, bin, n): pixels of each of the 256 gray values that occur."""
    counts = F.pandas_udf(_bins, "array<bigint>")("data", "height", "width", "channels")
    return images.select("image", F.posexplode(counts).alias("bin", "n")).filter("n > 0")


def _dark(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, channel: pd.Series, threshold: pd.Series) -> pd.Series:
    def one(pixels: np.ndarray, channel: int, threshold: int) -> list[dict]:
        at = min(channel, pixels.shape[2] - 1)
        edges = np.diff(np.pad((pixels[:, :, at] < threshold).astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (y, start), (_, end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        return [{"y": a, "x0": b, "x1": c - 1} for a, b, c in zip(y.tolist(), start.tolist(), end.tolist())]

    return pd.Series([one(_pixels(*row[:4]), *row[4:]) for row in zip(data, height, width, channels, channel, threshold)])


def foreground(images: DataFrame, channel: int = 2) -> DataFrame:
    """(image, y, x0, x1): runs of pixels darker than the image's Otsu threshold, in one channel (2: red; gray images have one).

    Images of a single gray value have no threshold and no foreground.
    """
    known = images.join(otsu(histogram(images)), "image")
    runs = F.pandas_udf(_dark, "array<struct<y:int,x0:int,x1:int>>")("data", "height", "width", "channels", F.lit(channel), "threshold")
    return known.select("image", F.inline(runs))


def run_pixels(images: DataFrame, spans: DataFrame) -> DataFrame:
    """(image, label, y, x0, x1, pixels): the bytes of each run (image, label, y, x0, x1), cut from the image's rows.

    Runs are clipped to the image; those beside it have no row. An image's bytes are joined once, to all of its runs together.
    """
    own = spans.groupBy("image").agg(F.collect_list(F.struct("label", "y", "x0", "x1")).alias("runs"))
    met = images.join(own, "image").withColumns({"w": F.col("width"), "c": F.col("channels")})
    clipped = F.transform("runs", lambda r: F.struct(r["label"].alias("label"), r["y"].alias("y"), F.greatest(r["x0"], F.lit(0)).alias("x0"), F.least(r["x1"], F.col("w") - 1).alias("x1")))
    shown = F.filter(clipped, lambda r: (r["x0"] <= r["x1"]) & (r["y"] >= 0) & (r["y"] < F.col("height")))
    cut = lambda r: F.substring(F.col("data"), (r["y"] * F.col("w") + r["x0"]) * F.col("c") + 1, (r["x1"] - r["x0"] + 1) * F.col("c"))
    return met.select("image", F.inline(F.transform(shown, lambda r: F.struct(r["label"].alias("label"), r["y"].alias("y"), r["x0"].alias("x0"), r["x1"].alias("x1"), cut(r).alias("pixels")))))


def line_crops(images: DataFrame, spans: DataFrame) -> DataFrame:
    """(image, label, l, t, width, height, channels, pixels, mask): each label's bounding box cut from its image, rows from the top.

    ``mask`` lists the label's runs in the box's own coordinates, (y, x0, x1). Labels are clipped to the image; those beside it have no row.
    """
    ends = spans.join(images.select("image", "width", "height"), "image").filter("y >= 0 AND y < height AND x1 >= 0 AND x0 < width")
    ends = ends.withColumns({"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.col("width") - 1)})
    box = ends.groupBy("image", "label").agg(
        F.min("x0").alias("l"), F.min("y").alias("t"), F.max("x1").alias("r"), F.max("y").alias("b"), F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("runs"))
    mask = F.transform("runs", lambda q: F.struct((q["y"] - F.col("t")).alias("y"), (q["x0"] - F.col("l")).alias("x0"), (q["x1"] - F.col("l")).alias("x1")))
    boxes = box.groupBy("image").agg(F.collect_list(F.struct("label", "l", "t", "r", "b", mask.alias("mask"))).alias("boxes"))
    met = images.join(boxes, "image").withColumns({"w": F.col("width"), "c": F.col("channels"), "d": F.col("data")})
    row = lambda q, y: F.substring(F.col("d"), (y * F.col("w") + q["l"]) * F.col("c") + 1, (q["r"] - q["l"] + 1) * F.col("c"))
    pixels = lambda q: F.aggregate(F.sequence(q["t"], q["b"]), F.lit(b""), lambda s, y: F.concat(s, row(q, y)))
    one = lambda q: F.struct(q["label"].alias("label"), q["l"].alias("l"), q["t"].alias("t"), (q["r"] - q["l"] + 1).alias("width"), (q["b"] - q["t"] + 1).alias("height"), F.col("c").alias("channels"), pixels(q).alias("pixels"), q["mask"].alias("mask"))
    return met.select("image", F.inline(F.transform("boxes", one)))


def _png(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    def one(raw: bytes, w: int, h: int) -> bytes:
        part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        lines = b"".join(b"\0" + raw[y * w : (y + 1) * w] for y in range(h))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")

    return pd.Series([one(*x) for x in zip(data, width, height)])


def png(data, width, height):
    """Gray pixels (binary, a byte each, from the top) as a PNG file."""
    return F.pandas_udf(_png, "binary")(data, width, height)
