"""Page plans, windows, inventories, shapes and images against golden values and brute force."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import plans as P
from quire.functions import shapes as H
from quire.operators import windows as W
from quire.sources import images as I


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_working_sizes(spark):
    rows = [(800, 600, 5), (1000, 1000, 40), (9000, 9000, 5), (1024, 1024, None)]
    got = spark.createDataFrame(rows, "w int, h int, n int").select("w", "n", P.working_size(F.col("w"), F.col("h"), F.col("n")).alias("s")).collect()
    got = {(r.w, r.n): (r.s.width, r.s.height, r.s.tiles) for r in got}
    assert got[800, 5] == (1024, 1024, 1)
    assert got[1000, 40] == (1536, 1536, 4)
    assert got[9000, 5] == (2666, 2666, 16)  # three tiles an axis would overlap by 203 < 360
    assert got[1024, None] == (1024, 1024, 1)


def test_grid_cuts(spark):
    row = spark.createDataFrame([(100,)], "n int").select(P.grid_cuts(F.col("n"), 3, F.lit(4)).alias("c")).first()
    assert [tuple(c) for c in row.c] == [(0, 37), (29, 70), (62, 100)]


def test_windows_stay_on_the_page(spark):
    pages = spark.createDataFrame([(1, 1000, 700), (2, 100, 90)], "page_id int, width int, height int")
    got = W.training_windows(pages, 200, 256).collect()
    assert len(got) == 400 and {r.x0 for r in got if r.page_id == 2} == {0}
    own = [r for r in got if r.page_id == 1]
    assert all(0 <= r.x0 and r.x1 < 1000 and 0 <= r.y0 and r.y1 < 700 for r in own)
    assert max(r.x0 for r in own if r.crop == "left") < 0.6 * 744 + 1 and min(r.x0 for r in own if r.crop == "right") >= int(0.4 * 744)
    assert 90 < sum(r.crop == "middle" for r in own) < 150


def test_heights_against_pixels(spark):
    rng = np.random.default_rng(2)
    cells = [(1, 1, y, int(a), int(a + n)) for y, (a, n) in enumerate(zip(rng.integers(0, 9, 12), rng.integers(3, 30, 12)))]
    got = W.component_heights(spark.createDataFrame(cells, "page_id int, label int, y int, x0 int, x1 int")).first()
    at = np.array([(x, y) for _, _, y, a, b in cells for x in range(a, b + 1)], float)
    axis = 4 * np.sqrt(np.linalg.eigvalsh(np.cov(at.T, bias=True))[-1])
    assert got.area == len(at) and got.axis == pytest.approx(axis) and got.line_height == pytest.approx(len(at) / axis)


def test_inventory_of_a_page_without_lines(spark):
    pages = spark.createDataFrame([(1, 10, 20)], "page_id int, width int, height int")
    none = spark.createDataFrame([], "page_id int, label int, y int, x0 int, x1 int")
    row = W.inventory(pages, none, none).first()
    assert (row.line_count, row.avg_line_height) == (0, None)


def test_simplified():
    assert H.simplified([(0, 0), (1, 0), (2, 0), (3, 0)], 0.5) == [(0, 0), (3, 0)]
    assert H.simplified([(0, 0), (5, 5), (10, 0)], 1) == [(0, 0), (5, 5), (10, 0)]
    assert H.simplified([], 1) == [] and H.simplified([(1, 1)], 1) == [(1, 1)]


def test_thinned_bar_is_one_pixel_thick():
    thin = H.thinned(np.ones((9, 60), bool))
    assert thin.sum(0).max() == 1 and thin.sum() > 40


def test_contour_of_a_rectangle_and_of_a_pixel():
    border = H.contour(np.ones((4, 6), bool))
    assert len(border) == len(set(border)) == 16 and border[0] == (0, 0)
    assert H.contour(np.ones((1, 1), bool)) == [(0, 0)]
    ragged = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)
    assert set(H.contour(ragged)) == {(1, 0), (2, 1), (1, 2), (0, 1)}


def test_shapes_of_bars(spark):
    rows = [(1, 1, y, 100, 299) for y in range(50, 61)] + [(1, 2, y, 5, 6) for y in range(3)]
    got = {r.label: r for r in H.shapes(spark.createDataFrame(rows, "page_id int, label int, y int, x0 int, x1 int")).collect()}
    line = got[1].centerline
    assert (line[0].x, line[-1].x) == (100, 299) and all(abs(p.y - 55) <= 1 for p in line)
    assert 10 <= got[1].line_height <= 13 and got[1].error is None and abs(got[1].centroid.x - 200) < 10
    assert got[2].error and got[2].centerline is None


def test_simplified_column(spark):
    own = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 2D, 'y', 0D)) AS p UNION ALL SELECT NULL")
    got = [r.p for r in own.select(H.simplified_points("p", 1.0).alias("p")).collect()]
    assert sorted(len(p) if p is not None else -1 for p in got) == [-1, 2]


def test_image_foreground(spark, tmp_path):
    pixels = np.full((6, 8, 3), 230, np.uint8)
    pixels[2:4, 1:5] = (20, 30, 40)
    (tmp_path / "a.png").write_bytes(png(pixels))
    rows = I.read_images(spark, str(tmp_path))
    assert sum(r.n for r in I.histogram(rows).collect()) == 48
    assert sorted((r.y, r.x0, r.x1) for r in I.foreground(rows).collect()) == [(2, 1, 4), (3, 1, 4)]


def test_line_counts(spark):
    """Twelve lines on a page of 240 rows, in patches, in strips and on a page smaller than a patch; an empty page fails."""
    from quire.operators import windows as W

    pages = spark.createDataFrame([(1, 600, 240), (2, 90, 120), (3, 600, 240)], "page_id int, width int, height int")
    runs = [(1, y, 0, 599) for y in range(240) if y % 20 < 8] + [(2, y, 0, 89) for y in range(120) if y % 20 < 8]
    fg = spark.createDataFrame(runs, "page_id int, y int, x0 int, x1 int")
    got = {r.page_id: (r.lines, r.dispersion) for r in W.line_counts(pages, fg, W.count_windows(pages, (100, 80), 5)).collect()}
    assert got == {1: (12, 0.0), 2: (6, 0.0), 3: (-1, -1.0)}
    strips = {r.page_id: r.lines for r in W.line_counts(pages, fg, W.strip_windows(pages)).collect()}
    assert strips[1] in (11, 12) and strips[2] == strips[3] == -1
