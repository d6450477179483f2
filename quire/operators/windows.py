"""Training windows on pages, and the inventory of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of windows at the middle, left and right of the page, for training and for held-out pages.
TRAIN, HELD_OUT = (0.6, 0.2, 0.2), (0.33, 0.34, 0.33)


def _draw(digest: str, part: int) -> Column:
    """A number in [0, 1) from eight hexadecimal digits."""
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("double") / 4294967296.0


def training_windows(pages: DataFrame, repeat: int, size: int, seed: str = "46", shares: tuple[float, float, float] = TRAIN) -> DataFrame:
    """``repeat`` square windows (page_id, repeat, crop, x0, y0, x1, y1) for each page, the same each time.

    The kind of window is drawn by ``shares``, its place along each axis evenly: over the left 0.6 of the
    way for left windows, the right 0.6 for right ones, the whole way for others. Draws come from
    md5(seed, page, repeat). A page smaller than the window gets it at the origin.
    """
    own = pages.select("page_id", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("repeat"))
    own = own.withColumn("h", F.md5(F.concat_ws("-", F.lit(seed), F.col("page_id").cast("string"), F.col("repeat").cast("string"))))
    kind, along, down = (_draw("h", k) for k in range(3))
    own = own.withColumn("crop", F.when(kind < shares[0], "middle").when(kind < shares[0] + shares[1], "left").otherwise("right"))
    x = F.when(F.col("crop") == "left", along * 0.6).when(F.col("crop") == "right", along * 0.6 + 0.4).otherwise(along)
    start = lambda share, side: F.floor(share * F.greatest(F.col(side) - size, F.lit(0))).cast("int")
    own = own.withColumns({"x0": start(x, "width"), "y0": start(down, "height")})
    return own.select("page_id", "repeat", "crop", "x0", "y0", (F.col("x0") + size - 1).alias("x1"), (F.col("y0") + size - 1).alias("y1"))


def windowed(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Runs cut to each window of their page, in the window's own coordinates."""
    w = windows.select("page_id", "repeat", *[F.col(c).alias(f"w{c}") for c in ("x0", "y0", "x1", "y1")])
    met = spans.join(w, "page_id").filter("y >= wy0 AND y <= wy1 AND x0 <= wx1 AND x1 >= wx0")
    return met.select(
        "page_id", "repeat", "label", (F.col("y") - F.col("wy0")).alias("y"),
        (F.greatest("x0", "wx0") - F.col("wx0")).alias("x0"), (F.least("x1", "wx1") - F.col("wx0")).alias("x1"),
    )


def window_boxes(spans: DataFrame, windows: DataFrame, least: int = 10) -> DataFrame:
    """Boxes of what the windows show of each label; masks of ``least`` pixels or fewer and flat boxes go."""
    out = windowed(spans, windows).groupBy("page_id", "repeat", "label").agg(
        F.min("x0").alias("l"), F.min("y").alias("t"), F.max("x1").alias("r"), F.max("y").alias("b"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area")
    )
    return out.filter((F.col("area") > least) & (F.col("r") > F.col("l")) & (F.col("b") > F.col("t")))


def component_heights(components: DataFrame) -> DataFrame:
    """(page_id, label, area, axis, line_height) of label runs: area over the length of the major axis.

    The axis is four times the root of the greater eigenvalue of the pixels' covariance, which
    comes from sums over runs, so pixels are never listed. Height is null where the axis is zero.
    """
    a, b, y = (F.col(c).cast("double") for c in ("x0", "x1", "y"))
    n = b - a + 1
    x1 = n * (a + b) / 2
    x2 = (b * (b + 1) * (2 * b + 1) - (a - 1) * a * (2 * a - 1)) / 6
    sums = components.groupBy("page_id", "label").agg(*[F.sum(e).alias(k) for k, e in {"n": n, "sx": x1, "sxx": x2, "sy": n * y, "syy": n * y * y, "sxy": x1 * y}.items()])
    c = lambda k, p, q: F.col(k) / F.col("n") - F.col(p) / F.col("n") * (F.col(q) / F.col("n"))
    sums = sums.withColumns({"vx": c("sxx", "sx", "sx"), "vy": c("syy", "sy", "sy"), "vxy": c("sxy", "sx", "sy")})
    spread = F.sqrt(4 * F.col("vxy") * F.col("vxy") + (F.col("vx") - F.col("vy")) * (F.col("vx") - F.col("vy")))
    axis = 4 * F.sqrt(F.greatest((F.col("vx") + F.col("vy") + spread) / 2, F.lit(0.0)))
    return sums.withColumn("axis", axis).select("page_id", "label", F.col("n").cast("bigint").alias("area"), "axis", F.when(F.col("axis") > 0, F.col("n") / F.col("axis")).alias("line_height"))


def inventory(pages: DataFrame, lines: DataFrame, components: DataFrame) -> DataFrame:
    """A row for each page: size, number of lines, mean height of the components of its line mask.

    Pages without lines have a count of zero and a null height.
    """
    counts = lines.groupBy("page_id").agg(F.count("*").alias("line_count"))
    heights = component_heights(components).groupBy("page_id").agg(F.avg("line_height").alias("avg_line_height"))
    out = pages.select("page_id", "width", "height").join(counts, "page_id", "left").join(heights, "page_id", "left")
    return out.withColumn("line_count", F.coalesce("line_count", F.lit(0).cast("bigint")))


def count_windows(pages: DataFrame, sample: tuple[int, int] = (200, 200), repeat: int = 10, seed: str = "46") -> DataFrame:
    """``repeat`` windows (page_id, repeat, x0, y0, x1, y1, scale) of ``sample`` width and height, placed by md5(seed, page, repeat).

    ``scale`` takes a window's line count to the page's. A page that a window does not fit in gets one of its whole size.
    """
    w, h = sample
    fits = (F.col("width") > w) & (F.col("height") > h)
    own = pages.withColumn("fits", fits).select("page_id", "width", "height", "fits", F.explode(F.sequence(F.lit(0), F.when(fits, F.lit(repeat - 1)).otherwise(0))).alias("repeat"))
    own = own.withColumn("digest", F.md5(F.concat_ws("-", F.lit(seed), F.col("page_id").cast("string"), F.col("repeat").cast("string"))))
    start = lambda part, side, size: F.when(F.col("fits"), F.floor(_draw("digest", part) * (F.col(side) - size))).otherwise(0).cast("int")
    own = own.withColumns({"x0": start(0, "width", w), "y0": start(1, "height", h)})
    end = lambda at, side, size: F.when(F.col("fits"), F.col(at) + size - 1).otherwise(F.col(side) - 1).cast("int")
    scale = F.when(F.col("fits"), F.col("height") / h).otherwise(1.0)
    return own.select("page_id", "repeat", "x0", "y0", end("x0", "width", w).alias("x1"), end("y0", "height", h).alias("y1"), scale.alias("scale"))


def strip_windows(pages: DataFrame, width: int = 300, repeat: int = 3, seed: str = "46", margin: int = 10) -> DataFrame:
    """Windows as high as the page less a margin; pages narrower than one and a half strips get none."""
    wide = pages.filter((F.col("width") >= 1.5 * width) & (F.col("height") > 2 * margin))
    own = wide.select("page_id", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("repeat"))
    own = own.withColumn("digest", F.md5(F.concat_ws("-", F.lit(seed), F.col("page_id").cast("string"), F.col("repeat").cast("string"))))
    own = own.withColumn("x0", F.floor(_draw("digest", 0) * (F.col("width") - width)).cast("int"))
    return own.select("page_id", "repeat", "x0", F.lit(margin).alias("y0"), (F.col("x0") + width - 1).alias("x1"), (F.col("height") - margin - 1).cast("int").alias("y1"), F.lit(1.0).alias("scale"))


def line_counts(pages: DataFrame, foreground: DataFrame, windows: DataFrame) -> DataFrame:
    """(page_id, lines, dispersion): line counts estimated from the dominant frequency of the windows' row profiles.

    A profile holds the foreground pixels of each row of a window. Windows without a positive frequency are left out; a page without any has
    -1 twice. ``lines`` is the mean times the scale, cut to a whole number, ``dispersion`` the deviation over the scaled mean.
    """
    from quire.functions.raster import dominant_frequency

    shown = windowed(foreground.withColumn("label", F.lit(1)), windows).groupBy("page_id", "repeat", "y").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    rows = shown.groupBy("page_id", "repeat").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("m"))
    met = windows.join(rows, ["page_id", "repeat"])
    profile = F.transform(F.sequence(F.lit(0), F.col("y1") - F.col("y0")), lambda y: F.coalesce(F.try_element_at("m", y), F.lit(0)).cast("double"))
    counted = met.select("page_id", "scale", profile.alias("profile")).withColumn("k", dominant_frequency("profile")).filter("k > 0")
    means = counted.groupBy("page_id").agg((F.avg("k") * F.max("scale")).alias("mean"), F.stddev_pop("k").alias("std"))
    out = pages.select("page_id").join(means, "page_id", "left")
    return out.select("page_id", F.coalesce(F.floor("mean").cast("int"), F.lit(-1)).alias("lines"), F.coalesce(F.col("std") / F.col("mean"), F.lit(-1.0)).alias("dispersion"))
