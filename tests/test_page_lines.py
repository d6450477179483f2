"""Golden rows and cross-path properties of the page-line jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import raster
from quire.operators import datasets as D
from quire.operators import metrics as M
from quire.operators import spans as S


def runs(spark, image, page=1):
    rows = []
    for label in np.unique(image[image > 0]).tolist():
        for y in range(image.shape[0]):
            x = np.flatnonzero(image[y] == label)
            for part in np.split(x, np.flatnonzero(np.diff(x) != 1) + 1) if len(x) else []:
                rows.append((page, label, y, int(part[0]), int(part[-1])))
    return spark.createDataFrame(rows, "page_id int, label int, y int, x0 int, x1 int")


@pytest.mark.parametrize("counts, expected", [((3917, 730, 141), (0.84291, 0.96525, 0.81809, 0.89994)), ((5782, 66, 192), (0.98871, 0.96786, 0.95728, 0.97818)), ((256, 4901, 2324), (0.04964, 0.09922, 0.03422, 0.06618))])
def test_published_scores(spark, counts, expected):
    row = M.rates(spark.createDataFrame([counts], "tp int, fp int, fn int")).first()
    assert (row.precision, row.recall, row.jaccard, row.f1) == pytest.approx(expected, abs=6e-6)


def test_no_prediction_gives_null(spark):
    row = M.rates(spark.createDataFrame([(0, 0, 5)], "tp int, fp int, fn int")).first()
    assert row.precision is None and row.f1 is None


def test_pairs_against_pixels(spark):
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 4, (12, 20)) for _ in range(2))
    got = {(r.pred_label, r.gt_label): (r.inter, r.uni) for r in M.pair_metrics(runs(spark, a), runs(spark, b)).collect()}
    want = {}
    for p in range(1, 4):
        for g in range(1, 4):
            i = int(((a == p) & (b == g)).sum())
            if i:
                want[p, g] = (i, int((a == p).sum() + (b == g).sum() - i))
    assert got == want


def test_merge_and_depth(spark):
    frame = spark.createDataFrame([(1, 1, 0, 0, 4), (1, 2, 0, 3, 6), (1, 3, 0, 8, 9), (1, 4, 0, 7, 7)], "page_id int, label int, y int, x0 int, x1 int")
    assert [(r.x0, r.x1) for r in S.merged(frame.drop("label"), ["page_id"]).collect()] == [(0, 9)]
    assert sorted((r.x0, r.x1, r.depth) for r in S.depth(frame).collect())[:3] == [(0, 2, 1), (3, 4, 2), (5, 6, 1)]


def test_deep_intersections(spark):
    a = spark.createDataFrame([(1, 1, 0, 0, 3), (1, 2, 0, 2, 5)], "page_id int, label int, y int, x0 int, x1 int")
    b = spark.createDataFrame([(1, 1, 0, 0, 5)], "page_id int, label int, y int, x0 int, x1 int")
    got = {r.pred_label: r.inter for r in M.deep_intersections(a, b).collect()}
    assert got == {1: 3.0, 2: 3.0}


def test_components_eight_neighbours(spark):
    image = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1], [1, 0, 1, 0]])
    out = raster.components(runs(spark, image).drop("label"))
    got = {(r.y, r.x0): r.label for r in out.collect()}
    assert got[0, 0] == got[1, 1] == 1 and got[0, 3] == 2 and got[2, 3] == got[3, 2] == 3 and got[3, 0] == 4


def test_triangle_raster():
    got = raster.polygon_runs([0, 4, 0], [0, 0, 4], 10, 10)
    assert got == [(0, 0, 4), (1, 0, 3), (2, 0, 2), (3, 0, 1), (4, 0, 0)]


def test_flat_strip(spark):
    points = F.array(*[G.point(F.lit(x), F.lit(50)) for x in (10, 20, 30)])
    row = spark.range(1).select(G.strip(points, F.lit(10.0)).alias("p")).first()
    assert [(p.x, p.y) for p in row.p] == [(10, 45), (20, 45), (30, 45), (30, 55), (20, 55), (10, 55), (10, 45)]


def test_tiles(spark):
    got = spark.createDataFrame([(256,), (257,), (100,), (800,)], "n int").select("n", G.tile_starts(F.col("n"), 256).alias("s")).collect()
    assert {r.n: r.s for r in got} == {256: [0], 257: [0, 1], 100: None, 800: [0, 182, 364, 544]}


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_split_sizes(spark, n):
    items = spark.range(n).withColumnRenamed("id", "k")
    got = {r.subset: r["count"] for r in D.split(items, "k").groupBy("subset").count().collect()}
    rest = int(n * 0.8)
    assert got == {k: v for k, v in {"train": int(rest * 0.8), "val": rest - int(rest * 0.8), "test": n - rest}.items() if v}


@pytest.mark.parametrize("parts", [1, 16])
def test_same_scores_for_any_partitioning(spark, parts):
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 3, (10, 10)) for _ in range(2))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        row = M.page_counts(runs(spark, a), runs(spark, b), [0.2]).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert (row.tp + row.fp, row.tp + row.fn) >= (2, 0)


def test_components_of_random_masks(spark):
    """Runs that touch or overlap in a row, and rows that meet at corners, against a flood fill."""
    rng = np.random.default_rng(8)
    image = rng.random((40, 60)) < 0.4
    rows = []
    for y in range(40):
        for part in np.split(np.flatnonzero(image[y]), np.flatnonzero(np.diff(np.flatnonzero(image[y])) != 1) + 1):
            if len(part):
                rows.append((1, y, int(part[0]), int(part[-1])))
                if len(part) > 2:
                    rows.append((1, y, int(part[1]), int(part[-1])))
    want, n = np.zeros(image.shape, int), 0
    for y, x in zip(*np.nonzero(image)):
        if not want[y, x]:
            n, todo = n + 1, [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 40 and 0 <= b < 60 and image[a, b] and not want[a, b]:
                    want[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    got = raster.components(spark.createDataFrame(rows, "page_id int, y int, x0 int, x1 int")).collect()
    assert len(got) == len(rows) and all(r.label == want[r.y, r.x0] == want[r.y, r.x1] for r in got)


def test_full_sweep_equals_single_scores(spark):
    """Every cell of the sweep is the score of the masks that its thresholds leave."""
    rng = np.random.default_rng(9)
    gt = np.zeros((60, 40), int)
    rows = []
    for k in range(6):
        gt[10 * k : 10 * k + 6, 5:35] = k + 1
        left, top, score = int(rng.integers(0, 12)), 10 * k + int(rng.integers(0, 3)), float(rng.choice([0.3, 0.6, 0.9]))
        rows += [(1 + k % 2, k, score, y, left, left + 28, float(rng.choice([0.2, 0.5, 0.8]))) for y in range(top, top + 6)]
    pages = [runs(spark, np.where(np.isin(gt, [k + 1 for k in range(6) if k % 2 == odd]), gt, 0), odd + 1) for odd in (0, 1)]
    gt = pages[0].unionByName(pages[1])
    frame = spark.createDataFrame(rows, "page_id int, det_id int, score double, y int, x0 int, x1 int, mask_score double")
    boxes, masks, ious = [0.25, 0.55, 0.85], [0.1, 0.45, 0.7], [0.3, 0.6, 0.9]
    got = {(r.box_thr, r.mask_thr, r.iou_thr): (r.pages, r.tp, r.fp, r.fn) for r in M.full_sweep(frame, gt, boxes, masks, ious, 40).collect()}
    want = {}
    for b in boxes:
        for m in masks:
            own = frame.filter((F.col("score") >= b) & (F.col("mask_score") >= m)).select("page_id", F.col("det_id").alias("label"), "y", "x0", "x1")
            for r in M.dataset_scores(M.page_counts(S.large(own, 40), gt, ious)).collect():
                want[b, m, r.iou_thr] = (r.pages, r.tp, r.fp, r.fn)
    assert got == want


def test_train_limit(spark):
    got = {r.subset: r["count"] for r in D.split(spark.range(100).withColumnRenamed("id", "k"), "k", digits=3, limit=10).groupBy("subset").count().collect()}
    assert got == {"train": 10, "val": 16, "test": 20}
