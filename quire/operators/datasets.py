"""Work lists, audits, splits and samples over page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split(items: DataFrame, key: str, seed: str = "46", reserved: float = 0.2, digits: int = 2, limit: int = 0) -> DataFrame:
    """``subset`` train, val or test of exact sizes, by the order of md5(seed + key); equal keys tie by value.

    Test takes the last share of all, validation that of the rest; ``limit`` keeps that many training items at most. Buckets are the first
    ``digits`` hex digits of the hash: 256 with two, 4096 with three. Ranks come from counts of
    hash buckets and windows inside them, so no single task ranks all.
    """
    own = items.withColumn("h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    own = own.withColumn("bucket", F.substring("h", 1, digits))
    sizes = own.groupBy("bucket").agg(F.count("*").alias("n"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = sizes.select("bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"), F.sum("n").over(everything).alias("total"))
    ranked = own.join(F.broadcast(starts), "bucket").withColumn("rank", F.col("start") + F.row_number().over(Window.partitionBy("bucket").orderBy("h", key)))
    rest = F.floor(F.col("total") * (1 - reserved))
    train = F.floor(rest * (1 - reserved))
    subset = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= rest, "val").otherwise("test")
    kept = ranked.filter((F.col("rank") <= limit) | (F.col("rank") > train)) if limit else ranked
    return kept.withColumn("subset", subset).select(*items.columns, "subset")


def first_items(items: DataFrame, key: str, n: int, seed: str | None = None) -> DataFrame:
    """The first n by key, or, with a seed, n at random but the same each time."""
    return items.orderBy(key).limit(n) if seed is None else items.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def repeated(items: DataFrame, stem: str, n: int) -> DataFrame:
    """Each item n times, named stem-0, stem-1, ..."""
    out = items.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("name", F.concat_ws("-", F.col(stem).cast("string"), F.col("repeat")))


def unmatched(images: DataFrame, notes: DataFrame, key: str = "stem") -> DataFrame:
    """Stems that only one side has."""
    met = images.select(key, F.lit(1).alias("i")).distinct().join(notes.select(key, F.lit(1).alias("n")).distinct(), key, "full_outer")
    return met.filter("i IS NULL OR n IS NULL").select(key, F.when(F.col("i").isNull(), "no image").otherwise("no annotation").alias("problem"))


def pending(work: DataFrame, outputs: DataFrame, layouts: DataFrame, key: str = "stem") -> DataFrame:
    """Items with a layout whose output is not there yet, sorted by key."""
    return work.join(layouts, key, "left_semi").join(outputs, key, "left_anti").orderBy(key)


def cache_hits(tiles: DataFrame, cached: DataFrame) -> DataFrame:
    """Whether a cached prediction of the same model and image fits: it must have as many tiles."""
    met = tiles.join(cached.withColumnRenamed("n_tiles", "cached_tiles"), ["model_md5", "image_md5"], "left")
    return met.select("model_md5", "image_md5", "n_tiles", F.coalesce(F.col("cached_tiles") == F.col("n_tiles"), F.lit(False)).alias("hit"))


def otsu(histogram: DataFrame) -> DataFrame:
    """(image, threshold): the bin that maximises the variance between the classes below and from it."""
    by = Window.partitionBy("image").orderBy("bin")
    below, whole = by.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("image")
    own = histogram.select("image", "bin", F.sum("n").over(below).alias("n0"), F.sum(F.col("n") * F.col("bin")).over(below).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("bin")).over(whole).alias("s"))
    n0, n1, s0, s1 = F.col("n0"), F.col("n") - F.col("n0"), F.col("s0"), F.col("s") - F.col("s0")
    gain = F.when(n1 > 0, n0.cast("double") * n1 * F.pow(s0 / n0 - s1 / n1, F.lit(2.0)))
    return own.withColumn("gain", F.bround(gain, 3)).filter("gain IS NOT NULL").groupBy("image").agg(F.min_by("bin", F.struct((-F.col("gain")).alias("g"), "bin")).alias("threshold"))


def estimate_errors(counts: DataFrame) -> DataFrame:
    """Differences and relative errors of estimated and predicted line counts; ``fold`` is their ratio turned to at most one."""
    d = lambda c: F.col(c) - F.col("gt")
    return counts.select("page_id", d("est").alias("est_err"), d("pred").alias("pred_err"), F.try_divide(d("est"), F.col("gt")).alias("est_rel"), F.try_divide(d("pred"), F.col("gt")).alias("pred_rel"), F.try_divide(F.least("est", "gt"), F.greatest("est", "gt")).alias("fold"))


def work_list(given: DataFrame, listed: DataFrame, marked: DataFrame, layout: str = ".layout.json", output: str = ".lines.json", label: str | None = None) -> DataFrame:
    """(image, layout_path, output_path), sorted: given images, and listed ones whose folder has the marker file; ``label``, a suffix, adds ``label_path``.

    ``given`` and ``listed`` have a ``path`` column, ``marked`` a ``folder`` column; repeated paths count once.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    own = given.select("path").union(listed.select("path").withColumn("folder", folder).join(marked, "folder", "left_semi").select("path")).distinct()
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    return own.select(F.col("path").alias("image"), F.concat(stem, F.lit(layout)).alias("layout_path"), F.concat(stem, F.lit(output)).alias("output_path"), *([F.concat(stem, F.lit(label)).alias("label_path")] if label else [])).orderBy("image")


def count_rows(pages: DataFrame, gt: DataFrame, earlier: DataFrame, estimates: DataFrame, predictions: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Line counts side by side: true ones (else those of an earlier annotation, else -1), estimated and predicted.

    Each table has ``page_id`` and ``n``; ``boxes`` (page_id, l, t, r, b) adds the box of each page's biggest region.
    """
    out = pages.select("page_id")
    for name, t in (("gt", gt), ("earlier", earlier), ("est", estimates), ("pred", predictions)):
        out = out.join(t.select("page_id", F.col("n").alias(name)), "page_id", "left")
    if boxes:
        out = out.join(boxes.select("page_id", *"ltrb"), "page_id", "left")
    return out.select("page_id", F.coalesce("gt", "earlier", F.lit(-1)).alias("gt"), F.coalesce("est", F.lit(-1)).alias("est"), F.coalesce("pred", F.lit(-1)).alias("pred"), *"ltrb"[: 4 * bool(boxes)])


def remainder(items: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Items that are not in the sample."""
    return items.join(sample.select(key), key, "left_anti")
