"""The 900-score sweep against a score for each combination of thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import metrics as M

BOX, MASK, IOU = [0.35, 0.55, 0.8], [0.25, 0.5, 0.75], [0.2, 0.4, 0.5, 0.75, 0.9]


def cases(seed):
    """Pages of one row each, whose lines are met in part, by too much, by nothing, or not at all."""
    r = random.Random(seed)
    runs, truth = [], []
    for page in range(60):
        for label in range(r.randint(0, 3)):
            truth.append((page, label + 1, 0, 100 * label, 100 * label + 79))
        for det in range(r.randint(0, 4)):
            at, size = r.choice([0, 0, 0, 20, 100, 100, 200, 300]), r.choice([10, 40, 80, 80, 90, 95, 160, 200])
            for part in range(2):
                runs.append((page, det, r.choice([0.1, 0.4, 0.6, 0.9]) if part == 0 else runs[-1][2], 0, at + part * size // 2, at + (part + 1) * size // 2 - 1, r.choice([0.1, 0.3, 0.6, 0.9])))
    return runs, truth


def plain(runs, truth, least):
    out = {}
    for b in BOX:
        for m in MASK:
            for t in IOU:
                sums = [0, 0, 0, 0]
                for page in {x[0] for x in runs}:
                    masks = {}
                    for _, d, score, _, x0, x1, s in (x for x in runs if x[0] == page and x[2] >= b and x[6] >= m):
                        masks.setdefault(d, set()).update(range(x0, x1 + 1))
                    masks = {d: v for d, v in masks.items() if len(v) >= least}
                    lines = {label: set(range(x0, x1 + 1)) for p, label, _, x0, x1 in truth if p == page}
                    if not masks or not lines:
                        continue
                    tp = fp = bad_r = 0
                    touched = {g for g, y in lines.items() if any(v & y for v in masks.values())}
                    for v in masks.values():
                        met = sorted((-(len(v & y) / len(v | y)), g) for g, y in lines.items() if v & y)
                        if not met:
                            fp += 1
                            continue
                        y = lines[met[0][1]]
                        p, r = len(v & y) / len(v), len(v & y) / len(y)
                        tp, fp, bad_r = tp + (p >= t and r >= t), fp + (p < t), bad_r + (r < t)
                    fn = len(lines) - len(touched) + bad_r
                    if tp + fp and tp + fn:
                        sums = [a + c for a, c in zip(sums, (1, tp, fp, fn))]
                if sums[0]:
                    out[b, m, t] = tuple(sums)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sweep_equals_every_threshold_alone(spark, seed):
    runs, truth = cases(seed)
    frame = spark.createDataFrame(runs, "page_id int, det_id int, score double, y int, x0 int, x1 int, mask_score double")
    gt = spark.createDataFrame(truth, "page_id int, label int, y int, x0 int, x1 int")
    got = {(r.box_thr, r.mask_thr, r.iou_thr): (r.pages, r.tp, r.fp, r.fn) for r in M.full_sweep(frame, gt, BOX, MASK, IOU, 12).collect()}
    want = plain(runs, truth, 12)
    assert got == want and len(want) == 45
    assert len({x[0] for x in want.values()}) > 5  # pages without scores leave the sums here and there


def test_no_page_meets_the_grid(spark):
    runs, truth = cases(1)
    frame = spark.createDataFrame(runs, "page_id int, det_id int, score double, y int, x0 int, x1 int, mask_score double")
    gt = spark.createDataFrame(truth, "page_id int, label int, y int, x0 int, x1 int")
    plan = M.full_sweep(frame, gt, BOX, MASK, IOU, 12)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "NestedLoop" not in plan
    assert not M.full_sweep(frame.filter(F.lit(False)), gt, BOX, MASK, IOU).collect()
