"""Comparison of predicted and true lines: pair metrics, matches, scores, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans as S


def intersections(pred: DataFrame, gt: DataFrame, label_distance: int = 0) -> DataFrame:
    """Shared pixels of each pair of labels on a page; with a distance, only of labels so near."""
    p = pred.select("page_id", "y", F.col("label").alias("pred_label"), F.col("x0").alias("p0"), F.col("x1").alias("p1"))
    g = gt.select("page_id", "y", F.col("label").alias("gt_label"), F.col("x0").alias("g0"), F.col("x1").alias("g1"))
    met = p.join(g, ["page_id", "y"]).filter((F.col("p0") <= F.col("g1")) & (F.col("g0") <= F.col("p1")))
    if label_distance > 0:
        met = met.filter(F.abs(F.col("pred_label") - F.col("gt_label")) <= label_distance)
    shared = F.least("p1", "g1") - F.greatest("p0", "g0") + 1
    return met.groupBy("page_id", "pred_label", "gt_label").agg(F.sum(shared).alias("inter"))


def pair_metrics(pred: DataFrame, gt: DataFrame, label_distance: int = 0, areas: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Intersection, union, precision, recall and IoU of all pairs that share pixels; ``areas`` of both maps, where they are at hand."""
    a, b = areas or (S.areas(pred), S.areas(gt))
    a = a.select("page_id", F.col("label").alias("pred_label"), F.col("area").alias("a"))
    b = b.select("page_id", F.col("label").alias("gt_label"), F.col("area").alias("b"))
    met = intersections(pred, gt, label_distance).join(a, ["page_id", "pred_label"]).join(b, ["page_id", "gt_label"])
    i, u = F.col("inter"), F.col("a") + F.col("b") - F.col("inter")
    return met.select("page_id", "pred_label", "gt_label", "inter", u.alias("uni"), (i / F.col("a")).alias("precision"), (i / F.col("b")).alias("recall"), (i / u).alias("iou"))


def best_matches(pairs: DataFrame) -> DataFrame:
    """Each predicted label's pair of highest IoU; ties go to the lowest true label."""
    best = F.min_by(F.struct("gt_label", "inter", "uni", "precision", "recall", "iou"), F.struct((-F.col("iou")).alias("i"), "gt_label"))
    return pairs.groupBy("page_id", "pred_label").agg(best.alias("m")).select("page_id", "pred_label", "m.*")


def _labels(areas: DataFrame, name: str) -> DataFrame:
    return areas.groupBy("page_id").agg(F.count("*").alias(name))


def page_counts(pred: DataFrame, gt: DataFrame, thresholds: list[float], method: str = "icdar", label_distance: int = 0, claim: str = "last") -> DataFrame:
    """(page_id, iou_thr, tp, fp, fn) of every page with predictions.

    ``icdar``: a predicted label's best match is right if precision and recall reach the threshold. Labels that
    touch nothing count as false. ``iou``: a predicted label is right if an IoU exceeds the threshold, and claims the
    highest such true label, or with ``claim="best"`` the one of highest IoU. Pairs meet once, a row a page then holds the matches of its labels, and each threshold counts them there.
    """
    areas = S.areas(pred), S.areas(gt)  # one shuffle each, for the pairs and the counts of labels
    pairs = pair_metrics(pred, gt, label_distance, areas)
    totals = _labels(areas[0], "n_pred").join(_labels(areas[1], "n_gt"), "page_id", "left").fillna(0, ["n_gt"])
    by_iou = F.struct((-F.col("iou")).alias("i"), "gt_label")
    if method == "icdar":
        best = pairs.groupBy("page_id", "pred_label").agg(F.min_by(F.struct("precision", "recall"), by_iou).alias("m"), F.collect_set("gt_label").alias("touched"))
        pages = best.groupBy("page_id").agg(F.collect_list("m").alias("own"), F.array_size(F.array_distinct(F.flatten(F.collect_list("touched")))).alias("gt_met"))
    else:
        pages = pairs.groupBy("page_id", "pred_label").agg(F.collect_list(F.struct((-F.col("iou")).alias("i"), "gt_label")).alias("m")).groupBy("page_id").agg(F.collect_list("m").alias("own"))
    out = totals.join(pages, "page_id", "left").withColumn("own", F.coalesce("own", F.array().cast(pages.schema["own"].dataType)))
    out = out.select("*", F.explode(_doubles(thresholds)).alias("iou_thr"))
    many = lambda test: F.size(F.filter("own", test))
    thr = F.col("iou_thr")
    if method == "icdar":
        tp = many(lambda m: (m["precision"] >= thr) & (m["recall"] >= thr))
        fp = F.col("n_pred") - F.size("own") + many(lambda m: m["precision"] < thr)
        fn = F.col("n_gt") - F.coalesce("gt_met", F.lit(0)) + many(lambda m: m["recall"] < thr)
    else:
        over = lambda m: F.filter(m, lambda x: -x["i"] > thr)
        chosen = (lambda m: F.array_max(F.transform(over(m), lambda x: x["gt_label"]))) if claim == "last" else (lambda m: F.array_min(over(m))["gt_label"])
        out = out.withColumn("claims", F.array_compact(F.transform("own", chosen)))
        tp = F.size("claims")
        fp, fn = F.col("n_pred") - tp, F.col("n_gt") - F.size(F.array_distinct("claims"))
    return out.select("page_id", "iou_thr", tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"), fn.cast("bigint").alias("fn"))


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, Jaccard and F1 from tp, fp, fn; all null where nothing was predicted or nothing is true."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    some = (tp + fp > 0) & (tp + fn > 0)
    one = lambda x: F.when(some, x)
    return counts.withColumns({"precision": one(tp / (tp + fp)), "recall": one(tp / (tp + fn)), "jaccard": one(tp / (tp + fp + fn)), "f1": one(2 * tp / (2 * tp + fp + fn))})


def dataset_scores(pages: DataFrame) -> DataFrame:
    """Micro-averaged scores for each threshold, over the pages that have scores."""
    kept = pages.filter((F.col("tp") + F.col("fp") > 0) & (F.col("tp") + F.col("fn") > 0))
    return rates(kept.groupBy("iou_thr").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def pixel_scores(pairs: DataFrame) -> DataFrame:
    """Per page, intersection over union of all pairs and of the best matches."""
    of = lambda d, name: d.groupBy("page_id").agg((F.sum("inter") / F.sum("uni")).alias(name))
    return of(pairs, "pixel_iu").join(of(best_matches(pairs), "matched_pixel_iu"), "page_id")


def kept_masks(runs: DataFrame, box_thrs: list[float], mask_thrs: list[float], least: int = 100) -> DataFrame:
    """(page_id, det_id, level, mask_thr, area): the masks that detections leave at each mask threshold.

    ``runs`` has (page_id, det_id, score, y, x0, x1, mask_score). ``level`` is the number of box thresholds, sorted, that the score
    reaches; a mask counts if it is one or more, and if ``least`` pixels reach the mask threshold. Thresholds are
    explored once for each mask, not for each run: runs are first summed by the number of mask thresholds they reach.
    """
    step = F.coalesce(F.size(F.filter(_doubles(mask_thrs), lambda t: t <= F.col("mask_score"))), F.lit(0))
    sums = runs.filter(F.col("score") >= min(box_thrs)).withColumn("step", step).filter("step > 0")
    sums = sums.groupBy("page_id", "det_id", "step").agg(F.max("score").alias("score"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    level = F.size(F.filter(_doubles(box_thrs), lambda t: t <= F.col("score")))
    return _down(sums.withColumn("level", level).drop("score"), ["page_id", "det_id", "level"], mask_thrs, "area").filter(F.col("area") >= least)


def _doubles(values: list[float]):
    return F.array(*[F.lit(float(x)) for x in sorted(values)])


def _down(sums: DataFrame, keys: list[str], mask_thrs: list[float], name: str) -> DataFrame:
    """Sums ``n`` by the number of mask thresholds reached (``step``), as sums at each threshold."""
    at = F.explode(F.slice(_doubles(mask_thrs), 1, F.col("step"))).alias("mask_thr")
    return sums.select(*keys, "n", at).groupBy(*keys, "mask_thr").agg(F.sum("n").alias(name))


def full_sweep(runs: DataFrame, gt: DataFrame, box_thrs: list[float], mask_thrs: list[float], iou_thrs: list[float], least: int = 100) -> DataFrame:
    """Dataset scores (box_thr, mask_thr, iou_thr, pages, tp, fp, fn, precision, recall, jaccard, f1) from detections.

    Each detection's mask is a predicted line of its own; masks that touch are to be merged before (``raster.components``).
    Lines match as in ``page_counts`` (icdar); pages without scores at a threshold leave its sums.
    One pixel join serves all thresholds: intersections are summed by the number of mask thresholds they reach. Matches and pages then say only
    where the scores change along the box and IoU thresholds (``_changes``); these changes are summed over all
    pages, and two running sums over the grid make them scores. No page meets the grid.
    """
    boxes, ious, levels = sorted(box_thrs), sorted(iou_thrs), sorted(mask_thrs)
    masks = kept_masks(runs, boxes, levels, least)
    step = F.size(F.filter(_doubles(levels), lambda t: t <= F.col("mask_score")))
    p = runs.filter(F.col("score") >= boxes[0]).select("page_id", "y", "det_id", F.col("x0").alias("p0"), F.col("x1").alias("p1"), step.alias("step")).filter("step > 0")
    g = gt.select("page_id", "y", F.col("label").alias("gt_label"), F.col("x0").alias("g0"), F.col("x1").alias("g1"))
    met = p.join(g, ["page_id", "y"]).filter((F.col("p0") <= F.col("g1")) & (F.col("g0") <= F.col("p1")))
    shared = met.groupBy("page_id", "det_id", "gt_label", "step").agg(F.sum(F.least("p1", "g1") - F.greatest("p0", "g0") + 1).alias("n"))
    areas = S.areas(gt)
    pairs = _down(shared, ["page_id", "det_id", "gt_label"], levels, "inter").join(areas.select("page_id", F.col("label").alias("gt_label"), F.col("area").alias("b")), ["page_id", "gt_label"])
    pairs = masks.join(pairs, ["page_id", "det_id", "mask_thr"], "left")
    i = F.col("inter")
    reach = lambda x: F.size(F.filter(_doubles(ious), lambda t: t <= x))
    found = F.when(i.isNotNull(), F.struct(reach(i / F.col("area")).alias("p"), reach(i / F.col("b")).alias("r")))
    best = pairs.groupBy("page_id", "mask_thr", "det_id").agg(F.max("level").alias("level"), F.min_by(found, F.struct((-(i / (F.col("area") + F.col("b") - i))).alias("iou"), "gt_label")).alias("m"), F.collect_set("gt_label").alias("touched"))
    pages = best.groupBy("page_id", "mask_thr").agg(F.collect_list(F.struct("level", "m", "touched")).alias("masks"))
    pages = pages.join(_labels(areas, "n_gt"), "page_id")
    changes = _changes(pages, len(ious)).groupBy("mask_thr", "level", "step").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return rates(_grid_sums(changes, boxes, levels, ious).filter("pages > 0"))


_COUNTS = ("pages", "tp", "fp", "fn")


def _changes(pages: DataFrame, top: int) -> DataFrame:
    """(mask_thr, level, step, pages, tp, fp, fn): what each page adds at all box thresholds up to ``level`` and IoU thresholds up to ``step``.

    ``pages`` has (mask_thr, n_gt, masks), each mask with the number of box thresholds it reaches (``level``), the numbers of IoU thresholds that its best match's precision
    and recall reach (``m.p``, ``m.r``; null if nothing is met), and the true labels it touches. A page has no scores, and is taken out again, where no mask is right and either
    all are met by recall too low alone (nothing counts as predicted), or all lines are touched and met by precision too low alone (nothing counts as true).
    With the masks from one level up, either is a stretch of IoU thresholds, so a rectangle for each of the page's own levels.
    """
    one = lambda level, step, *n: F.struct(level.cast("int").alias("level"), (step if not isinstance(step, int) else F.lit(step)).cast("int").alias("step"), *[(x if not isinstance(x, int) else F.lit(x)).cast("bigint").alias(c) for c, x in zip(_COUNTS, n)])

    def of_mask(x):
        m, level = x["m"], x["level"]
        hit = F.array(one(level, F.least(m["p"], m["r"]), 0, 1, 0, 0), one(level, top, 0, 0, 1, 1), one(level, m["p"], 0, 0, -1, 0), one(level, m["r"], 0, 0, 0, -1))
        return F.when(m.isNotNull(), hit).otherwise(F.array(one(level, top, 0, 0, 1, 0)))

    own = pages.select("mask_thr", "n_gt", "masks", F.array_sort(F.array_distinct(F.col("masks.level"))).alias("levels"))
    own = own.withColumn("first", F.transform(F.array_distinct(F.flatten("masks.touched")), lambda g: F.array_max(F.transform(F.filter("masks", lambda x: F.array_contains(x["touched"], g)), lambda x: x["level"]))))
    highest = F.element_at("levels", -1)

    def rectangle(level, at):
        below = F.when(at > 0, F.get("levels", at - 1)).otherwise(0)
        live = F.filter("masks", lambda x: x["level"] >= level)
        met = F.filter(live, lambda x: x["m"].isNotNull())
        side = lambda c: F.transform(met, lambda x: x["m"][c])
        n, touched = F.size(live), F.size(F.filter("first", lambda x: x >= level))
        low_r, all_p, low_p, all_r = F.array_max(side("r")), F.array_min(side("p")), F.array_max(side("p")), F.array_min(side("r"))
        gone = lambda after, upto, fp, fn: F.array(*[one(b, t, -s, 0, -fp * s, -fn * s) for b, t, s in ((level, upto, 1), (level, after, -1), (below, upto, -1), (below, after, 1))])
        none = F.array().cast(f"array<struct<level:int,step:int,{','.join(f'{c}:bigint' for c in _COUNTS)}>>")
        unpredicted = F.when((F.size(met) == n) & (low_r < all_p), gone(low_r, all_p, F.lit(0), F.col("n_gt") - touched + n)).otherwise(none)
        untrue = F.when((touched == F.col("n_gt")) & (F.size(met) > 0) & (low_p < all_r), gone(low_p, all_r, n, F.lit(0))).otherwise(none)
        return F.concat(unpredicted, untrue)

    parts = [
        F.flatten(F.transform("masks", of_mask)), F.array(one(highest, top, 1, 0, 0, F.col("n_gt"))),
        F.transform("first", lambda level: one(level, top, 0, 0, 0, -1)), F.flatten(F.transform("levels", rectangle)),
    ]
    return own.select("mask_thr", F.inline(F.concat(*parts))).filter("level > 0 AND step > 0")


def _grid_sums(changes: DataFrame, boxes: list[float], masks: list[float], ious: list[float]) -> DataFrame:
    """Sums (box_thr, mask_thr, iou_thr, pages, tp, fp, fn) of all changes at a level and step or beyond, for each cell of the grid."""
    axis = lambda values, name, k: F.posexplode(_doubles(values)).alias(k, name)
    cells = changes.sparkSession.range(1).select(axis(boxes, "box_thr", "k")).select("box_thr", (F.col("k") + 1).alias("level"), F.explode(_doubles(masks)).alias("mask_thr"))
    cells = cells.select("*", axis(ious, "iou_thr", "k")).select("box_thr", "mask_thr", "iou_thr", "level", (F.col("k") + 1).alias("step"))
    out = cells.join(changes, ["mask_thr", "level", "step"], "left").fillna(0, list(_COUNTS))
    for along, other in (("level", "step"), ("step", "level")):
        by = Window.partitionBy("mask_thr", other).orderBy(F.col(along).desc()).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({c: F.sum(c).over(by) for c in _COUNTS})
    return out.select("box_thr", "mask_thr", "iou_thr", *_COUNTS)


def mean_precision(scores: DataFrame) -> DataFrame:
    """Mean precision over the thresholds, that at .50 and .75, and ``curve``: (recall, precision) by ascending threshold."""
    at = lambda t: F.max(F.when(F.abs(F.col("iou_thr") - t) < 1e-9, F.col("precision")))
    return scores.agg(at(0.5).alias("map50"), at(0.75).alias("map75"), F.avg("precision").alias("map"),
        F.transform(F.array_sort(F.collect_list(F.struct("iou_thr", "recall", "precision"))), lambda x: x.dropFields("iou_thr")).alias("curve"))


def deep_intersections(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Shared pixels of label pairs, each pixel weighed by one over the greater depth of the two maps."""
    def elementary(spans: DataFrame, x: str) -> DataFrame:
        d = S.depth_in_place(spans).select("page_id", "y", F.col("x0").alias("d0"), F.col("x1").alias("d1"), "depth")
        met = spans.join(d, ["page_id", "y"]).filter((F.col("d0") <= F.col("x1")) & (F.col("x0") <= F.col("d1")))
        return met.select("page_id", "y", F.col("label").alias(f"{x}_label"), F.greatest("x0", "d0").alias(f"{x}0"), F.least("x1", "d1").alias(f"{x}1"), F.col("depth").alias(f"{x}_depth"))

    met = elementary(pred, "p").join(elementary(gt, "g"), ["page_id", "y"]).filter((F.col("p0") <= F.col("g1")) & (F.col("g0") <= F.col("p1")))
    size = F.least("p1", "g1") - F.greatest("p0", "g0") + 1
    return met.groupBy("page_id", F.col("p_label").alias("pred_label"), F.col("g_label").alias("gt_label")).agg(F.sum(size / F.greatest("p_depth", "g_depth")).alias("inter"))
