"""Column builders for point lists, tile plans and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def shifted(points: Column, dx: Column, dy: Column) -> Column:
    """Points moved by (dx, dy)."""
    return F.transform(points, lambda p: point(p["x"] + dx, p["y"] + dy))


def boxed(points: Column, l: Column, t: Column, r: Column, b: Column) -> Column:  # noqa: E741
    """Points clamped into a box."""
    return F.transform(points, lambda p: point(F.greatest(l, F.least(r, p["x"])), F.greatest(t, F.least(b, p["y"]))))


def points_text(points: Column) -> Column:
    """``x,y x,y`` with whole numbers, halves to even."""
    one = lambda v: F.bround(v, 0).cast("bigint").cast("string")
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", one(p["x"]), one(p["y"]))), " ")


def rectangle(l: Column, t: Column, r: Column, b: Column) -> Column:  # noqa: E741
    return F.array(point(l, t), point(r, t), point(r, b), point(l, b))


def tile_starts(length: Column, size: int, least_overlap: int = 20) -> Column:
    """Where tiles of ``size`` start along an axis; the last is flush with the end. Null if the axis is shorter."""
    n0 = F.ceil(length / size).cast("int")
    thin = (n0 > 1) & ((n0 * size - length) < least_overlap * (n0 - 1))
    n = F.when(thin, n0 + 1).otherwise(n0)
    overlap = F.floor((n * size - length) / F.greatest(n - 1, F.lit(1))).cast("int")
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.when((c == n - 1) & (n > 1), length - size).otherwise(c * (F.lit(size) - overlap)).cast("int"))
    return F.when(length < size, F.lit(None)).otherwise(starts)


def unusual_patches(height: Column, width: Column) -> Column:
    """(rows, cols) of patches for very high or very wide pages, else (0, 0)."""
    rows = F.when(height / width >= 2, F.ceil(height / width)).when(height / width <= 0.2, 1).otherwise(0)
    cols = F.when(height / width >= 2, 1).when(height / width <= 0.2, F.ceil(width / height)).otherwise(0)
    return F.struct(rows.cast("int").alias("rows"), cols.cast("int").alias("cols"))


def strip(points: Column, height: Column) -> Column:
    """Polygon around a centre line: at each point a segment of ``height`` that bisects its neighbours' directions.

    The northern points, the southern ones backwards, and the first again, cut to whole numbers. End points take a mirrored
    neighbour; a point whose neighbours share x is left out.
    """
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    mirror = lambda a, b: point(2 * a["x"] - b["x"], 2 * a["y"] - b["y"])
    at = lambda p, k: F.element_at(p, F.lit(k))
    half = height / 2

    def angle(t: Column) -> Column:
        lx, ly = t["a"]["x"] - t["p"]["x"], t["a"]["y"] - t["p"]["y"]
        rx, ry = t["b"]["x"] - t["p"]["x"], t["b"]["y"] - t["p"]["y"]
        return F.when(lx == 0, -F.atan(ry / rx)).when(rx == 0, F.atan(ly / lx)).otherwise((F.atan(ly / lx) + F.atan(ry / rx)) / 2)

    def outline(longer: Column) -> Column:
        around = F.transform(F.sequence(F.lit(1), F.size(longer) - 2), lambda i: F.struct(F.get(longer, i - 1).alias("a"), F.get(longer, i).alias("p"), F.get(longer, i + 1).alias("b")))
        kept = F.filter(around, lambda t: t["a"]["x"] != t["b"]["x"])
        moves = F.transform(F.transform(kept, lambda t: F.struct(t["p"].alias("p"), angle(t).alias("turn"))), lambda u: F.struct(u["p"].alias("p"), (half * F.sin(u["turn"])).alias("x"), (half * F.cos(u["turn"])).alias("y")))
        return let(moves, joined)

    def joined(moves: Column) -> Column:
        side = lambda m, sign: point((m["p"]["x"] + sign * m["x"]).cast("int"), (m["p"]["y"] - sign * m["y"]).cast("int"))
        return F.concat(F.transform(moves, lambda m: side(m, 1)), F.transform(F.reverse(moves), lambda m: side(m, -1)), F.transform(F.slice(moves, 1, 1), lambda m: side(m, 1)))

    longer = let(points, lambda p: F.concat(F.array(mirror(at(p, 1), at(p, 2))), p, F.array(mirror(at(p, -1), at(p, -2)))))
    return F.when(F.size(points) >= 2, let(longer, outline))
