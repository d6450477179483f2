"""Nested page documents: reading generations, flattening, nesting, audits, region work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"struct<id:string,coords:array<{POINT}>,baseline:array<{POINT}>,x_height:double,text:string>"
REGION = f"struct<id:string,coords:array<{POINT}>,lines:array<{LINE}>>"


def left(points: Column) -> Column:
    return F.array_min(F.transform(points, lambda p: p["x"]))


def top(points: Column) -> Column:
    return F.array_min(F.transform(points, lambda p: p["y"]))


def right(points: Column) -> Column:
    return F.array_max(F.transform(points, lambda p: p["x"]))


def bottom(points: Column) -> Column:
    return F.array_max(F.transform(points, lambda p: p["y"]))


def flat_lines(pages: DataFrame) -> DataFrame:
    """Line rows of documents with top-level ``lines`` or, where these are null, ``regions[].lines``; the innermost region's id."""
    inner = F.flatten(F.transform("regions", lambda r: F.transform(r["lines"], lambda x: F.struct(r["id"].alias("region_id"), x.alias("line")))))
    linked = "region_path" in pages.schema["lines"].dataType.elementType.names
    region = lambda x: F.element_at(x["region_path"], -1) if linked else F.lit(None).cast("string")
    own = F.transform("lines", lambda x: F.struct(region(x).alias("region_id"), x.alias("line")))
    rows = pages.select("page_id", F.posexplode(F.when(F.col("lines").isNotNull(), own).otherwise(inner)).alias("line_idx", "x"))
    return rows.select("page_id", (F.col("line_idx") + 1).alias("line_idx"), "x.region_id", "x.line.*")


def with_text(lines: DataFrame) -> DataFrame:
    """Lines that have baseline, polygon and a text that is not blank."""
    return lines.filter(F.col("baseline").isNotNull() & F.col("coords").isNotNull() & F.col("text").isNotNull() & ~F.col("text").rlike(r"^\s*$"))


def nested(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """One row a page: regions in order, each with its lines in order; a region without lines keeps an empty list."""
    of = lines.groupBy("page_id", "region_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "id", "coords", "baseline", "x_height", "text"))).alias("ls"))
    met = regions.join(of, ["page_id", "region_id"], "left")
    own = F.coalesce(F.transform("ls", lambda x: x.dropFields("line_idx")), F.array().cast(f"array<{LINE}>"))
    rows = met.select("page_id", F.struct("region_idx", F.col("region_id").alias("id"), "coords", own.alias("lines")).alias("r"))
    return rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r.dropFields("region_idx")).alias("regions"))


def contained(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, line_idx, region_idx) of lines whose box lies in a region's box, ends included."""
    a, b = lines.alias("a"), regions.alias("b")
    inside = (F.col("a.l") >= F.col("b.l")) & (F.col("a.r") <= F.col("b.r")) & (F.col("a.t") >= F.col("b.t")) & (F.col("a.b") <= F.col("b.b"))
    return a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & inside).select("a.page_id", "a.line_idx", "b.region_idx")


def grown(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Region boxes extended to the boxes of their lines."""
    reach = lines.groupBy("page_id", "region_idx").agg(F.min("l").alias("l2"), F.min("t").alias("t2"), F.max("r").alias("r2"), F.max("b").alias("b2"))
    met = regions.join(reach, ["page_id", "region_idx"], "left")
    return met.select("page_id", "region_idx", F.least("l", "l2").alias("l"), F.least("t", "t2").alias("t"), F.greatest("r", "r2").alias("r"), F.greatest("b", "b2").alias("b"))


def outside(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, region_idx, line_idx) of lines whose box leaves their region's box: what a strict reader refuses."""
    own = regions.select("page_id", "region_idx", *[F.col(c).alias(f"r{c}") for c in "ltrb"])
    met = lines.join(own, ["page_id", "region_idx"])
    return met.filter((F.col("l") < F.col("rl")) | (F.col("t") < F.col("rt")) | (F.col("r") > F.col("rr")) | (F.col("b") > F.col("rb"))).select("page_id", "region_idx", "line_idx")


def promoted(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Each region as a page of its own: lines relative to it, its file named after page and region."""
    met = lines.join(regions.select("page_id", "region_idx", "image_filename", F.col("l").alias("rl"), F.col("t").alias("rt"), F.col("r").alias("rr"), F.col("b").alias("rb")), ["page_id", "region_idx"])
    name = F.concat(F.regexp_extract("image_filename", r"^(.*?)(\.[^.]*)?$", 1), F.lit(".r"), F.col("region_idx"), F.regexp_extract("image_filename", r"^(.*?)(\.[^.]*)?$", 2))
    x = {"l": F.col("l") - F.col("rl"), "t": F.col("t") - F.col("rt"), "r": F.col("r") - F.col("rl"), "b": F.col("b") - F.col("rt")}
    return met.select("page_id", "region_idx", "line_idx", name.alias("image_filename"), (F.col("rr") - F.col("rl")).alias("width"), (F.col("rb") - F.col("rt")).alias("height"), *[v.alias(k) for k, v in x.items()], ((x["l"] < 0) | (x["t"] < 0)).alias("negative"))


def audit(lines: DataFrame) -> DataFrame:
    """One row for each rule a line breaks."""
    rules = {
        "no_id": F.col("id").isNull(), "no_coords": F.col("coords").isNull(), "no_x_height": F.col("x_height").isNull(),
        "short_baseline": F.coalesce(F.size("baseline") < 2, F.lit(True)), "not_integer": F.coalesce(F.exists("coords", lambda p: (p["x"] % 1 != 0) | (p["y"] % 1 != 0)), F.lit(False)) | F.coalesce(F.col("x_height") % 1 != 0, F.lit(False)),
    }
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return lines.select("page_id", "line_idx", F.explode(broken).alias("rule"))


def line_metrics(lines: DataFrame) -> DataFrame:
    """Per page, over lines with three baseline points or more: x-height mean and variance, spacing mean and deviation."""
    mean_y = F.aggregate("baseline", F.lit(0.0), lambda s, p: s + p["y"]) / F.size("baseline")
    own = lines.filter(F.size("baseline") >= 3).withColumn("y", mean_y)
    by = Window.partitionBy("page_id").orderBy("line_idx")
    out = own.withColumn("gap", F.lead("y").over(by) - F.col("y")).groupBy("page_id").agg(
        F.count("*").alias("n"), F.avg("x_height").alias("h"), F.var_pop("x_height").alias("v"), F.avg("gap").alias("g"), F.stddev_pop("gap").alias("s"))
    some = lambda x: F.when(F.col("n") >= 3, F.bround(x, 4))
    return out.select("page_id", F.bround("h", 4).alias("x_height"), F.bround("v", 4).alias("x_height_std"), some(F.col("g")).alias("spacing"), some(F.col("s")).alias("spacing_std"))


def region_spacing(lines: DataFrame) -> DataFrame:
    """Per region, whole-number spacing of consecutive line centres; -1 with a single line."""
    by = Window.partitionBy("page_id", "region_idx").orderBy("line_idx")
    gap = F.col("cy") - F.lag("cy").over(by)
    out = lines.withColumn("gap", gap).groupBy("page_id", "region_idx").agg(*[f("gap").alias(n) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))])
    return out.select("page_id", "region_idx", *[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in ("avg", "min", "max", "std")])


def reading_order(lines: DataFrame) -> DataFrame:
    """Ids l0, l1, ... of a region's lines by centre, from top, then left; ``order`` counts from 0."""
    by = Window.partitionBy("page_id", "region_idx").orderBy("cy", "cx", "line_idx")
    out = lines.withColumn("order", F.row_number().over(by) - 1)
    return out.withColumn("line_name", F.concat(F.lit("l"), F.col("order")))


def biggest_region(regions: DataFrame) -> DataFrame:
    """Each page's region of greatest area, the first of equals."""
    area = (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))
    best = F.min_by(F.struct("region_idx", "l", "t", "r", "b"), F.struct((-area).alias("a"), "region_idx"))
    return regions.groupBy("page_id").agg(best.alias("x")).select("page_id", "x.*")


def page_region(width: Column, height: Column) -> Column:
    """Polygon of a whole page."""
    x, y = (width - 1).cast("double"), (height - 1).cast("double")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    zero = F.lit(0.0)
    return F.array(corner(zero, zero), corner(x, zero), corner(x, y), corner(zero, y))


def stripped(pages: DataFrame, fields: list[str], comment: str | None = None) -> DataFrame:
    """Nested documents whose lines lack the named fields; with a comment, all of them carry it."""
    lean = F.transform("regions", lambda r: r.withField("lines", F.transform(r["lines"], lambda x: x.dropFields(*fields))))
    out = pages.withColumn("regions", lean)
    return out if comment is None else out.withColumn("comment", F.lit(comment))


def stamped(pages: DataFrame, creator: str, created: str | None = None, comments: str | None = None, line_height_factor: float | None = None) -> DataFrame:
    """Documents with new metadata: who made them and when (now, if not told); comments and factor where given."""
    new = {"creator": F.lit(creator), "created": F.lit(created) if created else F.current_timestamp().cast("string")}
    if comments is not None:
        new["comments"] = F.lit(comments)
    if line_height_factor not in (None, 1.0):
        new["line_height_factor"] = F.lit(line_height_factor)
    return pages.withColumns(new)


def rescaled(lines: DataFrame, factor: float, polygon: str = "coords", box: list[str] | None = None) -> DataFrame:
    """Lines whose polygon is a strip around the baseline, ``factor`` times the x-height high.

    Lines without an x-height, and all lines for a factor of one, keep their ``polygon``. ``box`` names the columns of the region's left, top,
    right and bottom; strips stay within them.
    """
    from quire.functions.geometry import boxed, shifted, strip

    if factor == 1:
        return lines.withColumn("coords", F.col(polygon))
    up = shifted(F.col("baseline"), F.lit(0), -F.col("x_height") / 2)
    made = strip(up, (F.col("x_height") * F.lit(factor)).cast("int"))
    made = boxed(made, *[F.col(c) for c in box]) if box else made
    return lines.withColumn("coords", F.when(F.col("x_height").isNull() | (F.size("baseline") < 2), F.col(polygon)).otherwise(made))


def tall_enough(lines: DataFrame, deviations: float = 1.5, height: str = "line_height") -> DataFrame:
    """Lines higher than their region's mean height less so many deviations."""
    by = Window.partitionBy("page_id", "region_idx")
    least = F.round(F.avg(height).over(by) - deviations * F.stddev_pop(height).over(by), 9)
    return lines.withColumn("least", least).filter(F.col(height) > F.col("least")).drop("least")


def biggest_region_lines(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, region_idx, n_lines) of each page's biggest region."""
    counts = lines.groupBy("page_id", "region_idx").agg(F.count("*").alias("n"))
    met = biggest_region(regions).join(counts, ["page_id", "region_idx"], "left")
    return met.select("page_id", "region_idx", F.coalesce("n", F.lit(0)).alias("n_lines"))


def size_mismatches(notes: DataFrame, images: DataFrame) -> DataFrame:
    """Pages whose annotation states another size than the image has."""
    b = images.select("page_id", F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    met = notes.select("page_id", "width", "height").join(b, "page_id")
    return met.filter((F.col("width") != F.col("image_width")) | (F.col("height") != F.col("image_height")))
