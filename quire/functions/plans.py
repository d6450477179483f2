"""Column builders for page sizes and grids of patches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_count(length: Column, size: int, least_overlap: Column) -> Column:
    """Tiles of ``size`` along an axis; null if the axis is shorter."""
    n = F.ceil(length / size).cast("int")
    thin = (n > 1) & ((n * size - length) < least_overlap * (n - 1))
    return F.when(length >= size, F.when(thin, n + 1).otherwise(n))


def working_size(width: Column, height: Column, lines: Column, patch: int = 1024, overlap: float = 0.04, most: int = 16, many_lines: int = 30, factor: float = 1.5, steps: int = 40) -> Column:
    """``(width, height, overlap, tiles)`` at which a page is cut into patches.

    Both sides are raised to the patch size. A page of fewer than four tiles with ``many_lines`` or more
    estimated lines grows by ``factor``, one of more than ``most`` tiles shrinks by it, until neither holds.
    A null estimate counts as few lines. ``tiles`` is null where shrinking took a side below the patch.
    """
    wanted = F.floor(F.lit(overlap) * F.greatest(width, height)).cast("int")
    tiles = lambda s: tile_count(s["width"], patch, wanted) * tile_count(s["height"], patch, wanted)
    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))

    def step(s: Column, _: Column) -> Column:
        n = tiles(s)
        return F.when((n < 4) & (lines >= many_lines), size(F.floor(s["width"] * factor), F.floor(s["height"] * factor))).when(
            n > most, size(F.floor(s["width"] / factor), F.floor(s["height"] / factor))
        ).otherwise(s)

    start = size(F.greatest(width, F.lit(patch)), F.greatest(height, F.lit(patch)))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), start, step,
        lambda s: F.struct(s["width"].alias("width"), s["height"].alias("height"), wanted.alias("overlap"), tiles(s).alias("tiles")),
    )


def grid_cuts(length: Column, parts: int, overlap: Column) -> Column:
    """``(start, end)`` of equal parts of an axis, inner ends moved out by ``overlap`` pixels; end exclusive."""
    cut = lambda i: F.floor(i * (length / parts)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(cut(i) - overlap).alias("start"),
            F.when(i == parts - 1, length).otherwise(cut(i + 1) + overlap).alias("end"),
        ),
    )
