"""The registered queries of the page-line jobs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import raster
from quire.operators import datasets as D
from quire.operators import documents as DOC
from quire.operators import metrics as M
from quire.operators import spans as S
from quire.sources import files, tables
from quire.sources import fixtures as X

IOUS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def maps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Runs of predicted and true lines; dealt by page once, when lines are numbered, and not again within pages."""
    rows = X.numbered(tables.paged(spark), d)
    return S.rectangles(X.pred_boxes(rows)), S.rectangles(X.gt_boxes(rows))


_PAIRS = f"""WITH {X.SQL},
met AS (SELECT page_id, p.label AS pred_label, g.label AS gt_label, (least(p.r, g.r) - greatest(p.l, g.l) + 1) * (least(p.b, g.b) - greatest(p.t, g.t) + 1) AS inter,
    (p.r - p.l + 1) * (p.b - p.t + 1) AS a, (g.r - g.l + 1) * (g.b - g.t + 1) AS bb
  FROM pred p JOIN gt g USING (page_id) WHERE p.l <= g.r AND g.l <= p.r AND p.t <= g.b AND g.t <= p.b),
pairs AS (SELECT page_id, pred_label, gt_label, CAST(inter AS BIGINT) AS inter, CAST(a + bb - inter AS BIGINT) AS uni, inter / a AS precision, inter / bb AS recall, inter / (a + bb - inter) AS iou FROM met),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY page_id, pred_label ORDER BY iou DESC, gt_label) = 1),
tot AS (SELECT page_id, count(*) AS n_pred, (SELECT count(*) FROM gt WHERE gt.page_id = pred.page_id) AS n_gt FROM pred GROUP BY page_id)"""
_ICDAR = """, hit AS (SELECT page_id, iou_thr, count(*) FILTER (precision >= iou_thr AND recall >= iou_thr) AS tp, count(*) FILTER (precision < iou_thr) AS bp, count(*) FILTER (recall < iou_thr) AS br, count(*) AS met FROM best, grid GROUP BY ALL),
tch AS (SELECT page_id, count(DISTINCT gt_label) AS gm FROM pairs GROUP BY page_id),
pages AS (SELECT page_id, iou_thr, coalesce(tp, 0) AS tp, n_pred - coalesce(met, 0) + coalesce(bp, 0) AS fp, n_gt - coalesce(gm, 0) + coalesce(br, 0) AS fn
  FROM tot CROSS JOIN grid LEFT JOIN hit USING (page_id, iou_thr) LEFT JOIN tch USING (page_id))"""
_IOU = """, won AS (SELECT page_id, iou_thr, pred_label, max(gt_label) AS claim FROM pairs, grid WHERE iou > iou_thr GROUP BY ALL),
hit AS (SELECT page_id, iou_thr, count(*) AS tp, count(DISTINCT claim) AS cl FROM won GROUP BY ALL),
pages AS (SELECT page_id, iou_thr, coalesce(tp, 0) AS tp, n_pred - coalesce(tp, 0) AS fp, n_gt - coalesce(cl, 0) AS fn FROM tot CROSS JOIN grid LEFT JOIN hit USING (page_id, iou_thr))"""
_SUM = """, sums AS (SELECT iou_thr, count(*) AS pages, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM pages WHERE tp + fp > 0 AND tp + fn > 0 GROUP BY iou_thr),
scored AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tp / (tp + fp + fn) AS jaccard, 2 * tp / (2 * tp + fp + fn) AS f1 FROM sums)"""


def _g(thr: list[float]) -> str:
    return ", grid AS (SELECT CAST(t AS DOUBLE) AS iou_thr FROM (VALUES " + ", ".join(f"({t})" for t in thr) + ") v(t))"


@query("m1_icdar_dataset_score", _PAIRS + _g([0.75]) + _ICDAR + _SUM + " SELECT * FROM scored")
def m1(spark, d):
    return M.dataset_scores(M.page_counts(*maps(spark, d), [0.75]))


@query("m2_iou_dataset_score", _PAIRS + _g([0.75]) + _IOU + _SUM + " SELECT * FROM scored")
def m2(spark, d):
    return M.dataset_scores(M.page_counts(*maps(spark, d), [0.75], "iou"))


@query("j12_sweep_page_scores", _PAIRS + _g(IOUS) + _ICDAR + " SELECT *, CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN tp / (tp + fp + fn) END AS jaccard, CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM pages")
def j12(spark, d):
    return M.rates(M.page_counts(*maps(spark, d), IOUS))


@query("a5_mean_precision", _PAIRS + _g(IOUS) + _IOU + _SUM + " SELECT max(precision) FILTER (iou_thr = 0.5) AS map50, max(precision) FILTER (iou_thr = 0.75) AS map75, round(avg(precision), 9) AS map FROM scored")
def a5(spark, d):
    return M.mean_precision(M.dataset_scores(M.page_counts(*maps(spark, d), IOUS, "iou"))).drop("curve").withColumn("map", F.round("map", 9))


@query("a5_precision_curve", _PAIRS + _g(IOUS) + _IOU + _SUM + " SELECT CAST(row_number() OVER (ORDER BY iou_thr) - 1 AS INT) AS step, recall, precision FROM scored")
def a5_curve(spark, d):
    scores = M.dataset_scores(M.page_counts(*maps(spark, d), IOUS, "iou"))
    return M.mean_precision(scores).select(F.posexplode("curve").alias("step", "x")).select("step", "x.recall", "x.precision")


_BEST = _IOU.replace("max(gt_label) AS claim", "arg_min(gt_label, (-iou, gt_label)) AS claim")


@query("m2_best_claims", _PAIRS + _g([0.3]) + _BEST + _SUM + " SELECT * FROM scored")
def m2_best(spark, d):
    return M.dataset_scores(M.page_counts(*maps(spark, d), [0.3], "iou", claim="best"))


@query("p12_one_label", f"WITH {X.SQL} SELECT page_id, unnest(range(t, b + 1)) AS y, l AS x0, r AS x1 FROM pred WHERE label = 2")
def p12(spark, d):
    return S.of_labels(maps(spark, d)[0], F.col("label") == 2)


@query("j1_pair_metrics", _PAIRS + " SELECT * FROM pairs")
def j1(spark, d):
    return M.pair_metrics(*maps(spark, d))


@query("j2_band_limited_pairs", _PAIRS + " SELECT page_id, pred_label, gt_label, inter FROM pairs WHERE abs(pred_label - gt_label) <= 1")
def j2(spark, d):
    return M.intersections(*maps(spark, d), label_distance=1)


@query("a4_pixel_scores", _PAIRS + " SELECT a.page_id, pixel_iu, matched_pixel_iu FROM (SELECT page_id, CAST(sum(inter) AS DOUBLE) / sum(uni) AS pixel_iu FROM pairs GROUP BY page_id) a JOIN (SELECT page_id, CAST(sum(inter) AS DOUBLE) / sum(uni) AS matched_pixel_iu FROM best GROUP BY page_id) b USING (page_id)")
def a4(spark, d):
    return M.pixel_scores(M.pair_metrics(*maps(spark, d)))


@query("w1_best_matches", _PAIRS + " SELECT * FROM best")
def w1(spark, d):
    return M.best_matches(M.pair_metrics(*maps(spark, d)))


@query("u2_unmatched_labels", _PAIRS + " SELECT 'pred' AS side, page_id, label FROM pred WHERE (page_id, label) NOT IN (SELECT page_id, pred_label FROM pairs) UNION ALL SELECT 'gt', page_id, label FROM gt WHERE (page_id, label) NOT IN (SELECT page_id, gt_label FROM pairs)")
def u2(spark, d):
    pred, gt = maps(spark, d)
    pairs = M.intersections(pred, gt)
    of = lambda s, side: s.select("page_id", "label").distinct().join(pairs.select("page_id", F.col(f"{side}_label").alias("label")), ["page_id", "label"], "left_anti").select(F.lit(side).alias("side"), "page_id", "label")
    return of(pred, "pred").unionByName(of(gt, "gt"))


_RUNS = f"WITH {X.SQL}, runs AS (SELECT page_id, label, unnest(range(t, b + 1)) AS y, l AS x0, r AS x1 FROM pred)"
_FG = "fg(par, m0, m1) AS (VALUES (0, 0, 799), (1, 0, 99), (1, 101, 299), (1, 301, 799))"


def foreground(spans: DataFrame) -> DataFrame:
    """Even rows are whole, odd rows are cut at 100 and 300."""
    even, odd = F.array(F.struct(F.lit(0).alias("x0"), F.lit(799).alias("x1"))), F.array(*[F.struct(F.lit(a).alias("x0"), F.lit(b).alias("x1")) for a, b in ((0, 99), (101, 299), (301, 799))])
    rows = spans.select("page_id", "y").distinct()
    return rows.select("page_id", "y", F.inline(F.when(F.col("y") % 2 == 0, even).otherwise(odd)))


@query("j3_foreground_areas", _RUNS + f", {_FG} SELECT page_id, label, CAST(sum(least(x1, m1) - greatest(x0, m0) + 1) AS BIGINT) AS area FROM runs JOIN fg ON par = y % 2 AND x0 <= m1 AND m0 <= x1 GROUP BY ALL")
def j3(spark, d):
    pred, _ = maps(spark, d)
    return S.areas(S.clipped(pred, foreground(pred)))


@query("w6_merged_runs", _RUNS + ", o AS (SELECT *, max(x1) OVER (PARTITION BY page_id, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM runs), i AS (SELECT *, sum(CASE WHEN x0 <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT page_id, y, min(x0) AS x0, max(x1) AS x1 FROM i GROUP BY page_id, y, k")
def w6(spark, d):
    return S.merged(maps(spark, d)[0].select("page_id", "y", "x0", "x1"), ["page_id"])


_DEPTH = ", ev AS (SELECT page_id, y, x, sum(d) AS d FROM (SELECT page_id, y, x0 AS x, 1 AS d FROM runs UNION ALL SELECT page_id, y, x1 + 1, -1 FROM runs) GROUP BY ALL), dp AS (SELECT page_id, y, x AS x0, lead(x) OVER w - 1 AS x1, CAST(sum(d) OVER w AS INT) AS depth FROM ev WINDOW w AS (PARTITION BY page_id, y ORDER BY x))"


@query("a9_depth_runs", _RUNS + _DEPTH + " SELECT * FROM dp WHERE depth > 0")
def a9(spark, d):
    return S.depth(S.pages(X.pred_boxes(X.numbered(tables.paged(spark), d))))


@query("p13_map_limits", _RUNS + _DEPTH + " SELECT page_id, max_label, n_labels, max_depth, max_label <= 255 AND max_depth <= 4 AS fits FROM (SELECT page_id, max(label) AS max_label, count(DISTINCT label) AS n_labels FROM runs GROUP BY page_id) JOIN (SELECT page_id, max(depth) AS max_depth FROM dp GROUP BY page_id) USING (page_id)")
def p13(spark, d):
    return S.limits(maps(spark, d)[0])


@query("a8_boxes", f"WITH {X.SQL} SELECT page_id, label, l, t, r, b, CAST((r - l + 1) * (b - t + 1) AS BIGINT) AS area FROM pred")
def a8(spark, d):
    return S.boxes(maps(spark, d)[0])


@query("p11_odd_labels", f"WITH {X.SQL}, runs AS (SELECT page_id, label, unnest(range(t, b + 1)) AS y, l AS x0, r AS x1 FROM gt WHERE label % 2 = 1) SELECT page_id, y, x0, x1 FROM runs")
def p11(spark, d):
    return S.of_labels(maps(spark, d)[1], F.col("label") % 2 == 1)


@query("p14_packed_pixels", "SELECT l_orderkey AS id, l_linenumber AS line, l_partkey % 200 * 256 + l_linenumber AS value, list_filter([l_partkey % 200, l_linenumber], lambda x: x <> 0)::BIGINT[]::VARCHAR AS labels FROM lineitem")
def p14(spark, d):
    own = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array((F.col("l_partkey") % 200).cast("int"), "l_linenumber").alias("x"))
    out = own.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), S.packed(F.col("x")).alias("value"))
    text = F.concat(F.lit("["), F.array_join(S.unpacked(F.col("value")).cast("array<string>"), ", "), F.lit("]"))
    return out.select("id", "line", F.col("value").cast("bigint").alias("value"), text.alias("labels"))


_DET = f"WITH {X.SQL}, det AS (SELECT l_orderkey AS page_id, n AS det_id, 1 - l_discount * 4 AS score, 0.3 + l_tax * 8 AS base, CAST(20 + l_suppkey%30 AS int) AS l, CAST(170 + l_suppkey%30 + l_partkey%200 AS int) AS r, CAST(30*n AS int) AS t, CAST(30*n + 12 + q%10 AS int) AS b FROM numbered)"


def detections(spark, d) -> DataFrame:
    """Runs of scored masks, one for each line."""
    rows = X.numbered(tables.paged(spark), d).selectExpr("l_orderkey AS page_id", "n AS det_id", "1 - l_discount * 4 AS score", "0.3 + l_tax * 8 AS base", "int(20 + l_suppkey % 30) AS l", "int(170 + l_suppkey % 30 + l_partkey % 200) AS r", "int(30 * n) AS t", "int(30 * n + 12 + q % 10) AS b")
    return rows.select("page_id", "det_id", "score", F.explode(F.sequence("t", "b")).alias("y"), F.col("l").alias("x0"), F.col("r").alias("x1"), "base").withColumn("mask_score", F.col("base") + F.col("y") % 5 * 0.02).drop("base")


@query("p8_detection_sweep", _DET + ", px AS (SELECT *, unnest(range(t, b + 1)) AS y FROM det), g AS (SELECT bt, mt FROM (VALUES (0.701), (0.851)) a(bt), (VALUES (0.451), (0.651)) c(mt)), k AS (SELECT bt, mt, page_id, det_id, sum(r - l + 1) AS area FROM px, g WHERE score >= bt AND base + y % 5 * 0.02 >= mt GROUP BY ALL HAVING sum(r - l + 1) >= 100) SELECT CAST(bt AS DOUBLE) AS box_thr, CAST(mt AS DOUBLE) AS mask_thr, count(*) AS masks, CAST(sum(area) AS BIGINT) AS pixels FROM k GROUP BY ALL")
def p8(spark, d):
    boxes = [0.701, 0.851]
    masks = M.kept_masks(detections(spark, d), boxes, [0.451, 0.651])
    counts = masks.groupBy("level", "mask_thr").agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    grid = spark.createDataFrame([(k + 1, b) for k, b in enumerate(boxes)], "b int, box_thr double")
    return counts.join(F.broadcast(grid), F.col("level") >= F.col("b")).groupBy("box_thr", "mask_thr").agg(F.sum("n").alias("masks"), F.sum("area").alias("pixels"))


#: Ten box thresholds and nine mask thresholds, away from the scores of the fixture.
BOX_THRS, MASK_THRS = [round(0.501 + 0.05 * k, 3) for k in range(10)], [round(0.311 + 0.05 * k, 3) for k in range(9)]


def _values(name: str, values: list[float]) -> str:
    return "(VALUES " + ", ".join(f"(CAST({v} AS DOUBLE))" for v in values) + f") v_{name}({name})"


_SWEEP = f"""{_DET}, mts AS (SELECT mask_thr FROM {_values("mask_thr", MASK_THRS)}), grid AS (SELECT box_thr, iou_thr FROM {_values("box_thr", BOX_THRS)}, {_values("iou_thr", IOUS)}),
px AS (SELECT page_id, det_id, score, l AS p0, r AS p1, y, mask_thr FROM (SELECT *, unnest(range(t, b + 1)) AS y FROM det) e, mts WHERE base + y % 5 * 0.02 >= mask_thr),
mk AS (SELECT page_id, det_id, score, mask_thr, sum(p1 - p0 + 1) AS a FROM px GROUP BY ALL HAVING sum(p1 - p0 + 1) >= 100),
gpx AS (SELECT page_id, label, l AS g0, r AS g1, (r - l + 1) * (b - t + 1) AS b, unnest(range(t, b + 1)) AS y FROM gt),
it AS (SELECT page_id, det_id, mask_thr, label, b, sum(least(p1, g1) - greatest(p0, g0) + 1) AS i FROM px JOIN gpx USING (page_id, y) WHERE p0 <= g1 AND g0 <= p1 GROUP BY ALL),
pr AS (SELECT page_id, det_id, mask_thr, label, score, i / a AS p, i / b AS r, i / (a + b - i) AS iou FROM it JOIN mk USING (page_id, det_id, mask_thr)),
bs AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY page_id, det_id, mask_thr ORDER BY iou DESC, label) = 1),
hit AS (SELECT page_id, box_thr, mask_thr, iou_thr, count(*) FILTER (p >= iou_thr AND r >= iou_thr) AS tp, count(*) FILTER (p < iou_thr) AS bp, count(*) FILTER (r < iou_thr) AS br, count(*) AS met FROM bs, grid WHERE score >= box_thr GROUP BY ALL),
tch AS (SELECT page_id, box_thr, mask_thr, count(DISTINCT label) AS gm FROM pr, (SELECT DISTINCT box_thr FROM grid) WHERE score >= box_thr GROUP BY ALL),
np AS (SELECT page_id, box_thr, mask_thr, count(*) AS n_pred FROM mk, (SELECT DISTINCT box_thr FROM grid) WHERE score >= box_thr GROUP BY ALL),
ng AS (SELECT page_id, count(*) AS n_gt FROM gt GROUP BY 1),
pages AS (SELECT page_id, box_thr, mask_thr, iou_thr, coalesce(tp, 0) AS tp, n_pred - coalesce(met, 0) + coalesce(bp, 0) AS fp, n_gt - coalesce(gm, 0) + coalesce(br, 0) AS fn
  FROM np JOIN ng USING (page_id) JOIN grid USING (box_thr) LEFT JOIN hit USING (page_id, box_thr, mask_thr, iou_thr) LEFT JOIN tch USING (page_id, box_thr, mask_thr)),
sums AS (SELECT box_thr, mask_thr, iou_thr, count(*) AS pages, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM pages WHERE tp + fp > 0 AND tp + fn > 0 GROUP BY ALL)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tp / (tp + fp + fn) AS jaccard, 2 * tp / (2 * tp + fp + fn) AS f1 FROM sums"""


@query("j12_full_sweep", _SWEEP)
def j12_full(spark, d):
    """Ten box, nine mask and ten IoU thresholds over all detections, 900 scores from one pixel join."""
    return M.full_sweep(detections(spark, d), maps(spark, d)[1], BOX_THRS, MASK_THRS, IOUS)


@query("h3_components", f"WITH {X.SQL} SELECT page_id, label, y, CASE WHEN y % 2 = 0 THEN l ELSE l + (r - l) // 2 + 1 END AS x0, CASE WHEN y % 2 = 0 THEN l + (r - l) // 2 ELSE r END AS x1 FROM (SELECT *, unnest(range(t, b + 1)) AS y FROM gt)")
def h3(spark, d):
    """Lines whose even rows hold the left half and odd rows the right half, so that they hang together at corners only."""
    gt, middle = maps(spark, d)[1], F.floor((F.col("x1") - F.col("x0")) / 2).cast("int") + F.col("x0")
    even = F.col("y") % 2 == 0
    halves = gt.select("page_id", "y", F.when(even, F.col("x0")).otherwise(middle + 1).alias("x0"), F.when(even, middle).otherwise(F.col("x1")).alias("x1"))
    return raster.components(halves)


@query("h1_polygon_raster", f"WITH {X.SQL} SELECT page_id, label, y, l AS x0, l + (r - l) * (b - y) // (b - t) AS x1 FROM (SELECT *, unnest(range(t, b + 1)) AS y FROM gt)")
def h1(spark, d):
    """Triangles under the diagonal of each line's box."""
    boxes = X.gt_boxes(X.numbered(spark, d))
    corners = F.array(G.point(F.col("l"), F.col("t")), G.point(F.col("r"), F.col("t")), G.point(F.col("l"), F.col("b")))
    return raster.polygons(boxes.select("page_id", "label", corners.alias("coords"), F.lit(800).alias("width"), (F.col("b") + 30).alias("height")))


def line_rows(spark, d) -> DataFrame:
    """Lines with baselines, centres and the region of four lines they belong to."""
    rows = X.numbered(spark, d).selectExpr(
        "l_orderkey AS page_id", "n AS line_idx", "int((n - 1) div 4) AS region_idx", "int(20 + l_suppkey % 30) AS l", "int(170 + l_suppkey % 30 + l_partkey % 200) AS r",
        "int(30 * n + l_partkey % 7) AS t", "int(30 * n + l_partkey % 7 + 12 + q % 10) AS b", "l_partkey AS pk", "l_suppkey AS sk",
    )
    w = F.col("r") - F.col("l")
    xs = [F.col("l"), F.col("l") + F.floor(w / 3), F.col("l") + F.floor(2 * w / 3), F.col("r")]
    base = F.array(*[G.point(x, F.col("b") - (F.col("pk") * k) % 4) for k, x in enumerate(xs)])
    return rows.withColumns({"id": F.concat(F.lit("l"), F.col("line_idx")), "region_id": F.concat(F.lit("r"), F.col("region_idx")), "coords": G.rectangle(*[F.col(c) for c in "ltrb"]), "baseline": base,
        "x_height": F.col("b") - F.col("t"), "text": F.when(F.col("sk") % 5 == 0, " ").otherwise(F.concat(F.lit("line "), F.col("line_idx"))), "cx": (F.col("l") + F.col("r")) / 2, "cy": (F.col("t") + F.col("b")) / 2})


def region_rows(lines: DataFrame) -> DataFrame:
    out = lines.groupBy("page_id", "region_idx").agg((F.min("l") - 5).alias("l"), (F.min("t") - 5).alias("t"), (F.max("r") + 5).alias("r"), (F.max("b") + 5).alias("b"))
    return out.withColumns({"region_id": F.concat(F.lit("r"), F.col("region_idx")), "coords": G.rectangle(*[F.col(c) for c in "ltrb"]), "image_filename": F.concat(F.lit("p"), F.col("page_id"), F.lit(".jpg"))})


_LINES = f"""WITH {X.SQL}, lines AS (SELECT g.page_id, g.label AS line_idx, (g.label - 1) // 4 AS region_idx, g.l, g.t, g.r, g.b, n.l_partkey AS pk, n.l_suppkey AS sk, (g.l + g.r) / 2 AS cx, (g.t + g.b) / 2 AS cy
  FROM gt g JOIN numbered n ON n.l_orderkey = g.page_id AND n.n = g.label),
regions AS (SELECT page_id, region_idx, min(l) - 5 AS l, min(t) - 5 AS t, max(r) + 5 AS r, max(b) + 5 AS b FROM lines GROUP BY ALL)"""


@query("p5_json_round_trip", _LINES + " SELECT page_id, line_idx, 'r' || region_idx AS region_id, 'l' || line_idx AS id, b - t AS x_height, 'line ' || line_idx AS text, CAST(l AS DOUBLE) AS first_x FROM lines WHERE sk % 5 <> 0")
def p5(spark, d):
    lines = line_rows(spark, d)
    pages = DOC.nested(region_rows(lines), lines).select("page_id", F.to_json(F.struct("regions")).alias("doc"))
    read = pages.select("page_id", F.from_json("doc", f"regions array<{DOC.REGION}>, lines array<{DOC.LINE}>").alias("x")).select("page_id", "x.*")
    return DOC.with_text(DOC.flat_lines(read)).select("page_id", "line_idx", "region_id", "id", F.col("x_height").cast("int").alias("x_height"), "text", F.col("coords")[0]["x"].alias("first_x"))


@query("j6_contained_lines", _LINES + " SELECT a.page_id, a.line_idx, b.region_idx FROM lines a JOIN regions b ON a.page_id = b.page_id AND a.l >= b.l AND a.r <= b.r AND a.t >= b.t AND a.b <= b.b")
def j6(spark, d):
    lines = line_rows(spark, d)
    return DOC.contained(lines, region_rows(lines))


@query("a11_grown_regions", _LINES + ", s AS (SELECT page_id, region_idx, l + 20 AS l, t + 8 AS t, r - 20 AS r, b - 8 AS b FROM regions), m AS (SELECT page_id, region_idx, min(l) AS l2, min(t) AS t2, max(r) AS r2, max(b) AS b2 FROM lines GROUP BY ALL) SELECT page_id, region_idx, least(l, l2) AS l, least(t, t2) AS t, greatest(r, r2) AS r, greatest(b, b2) AS b FROM s JOIN m USING (page_id, region_idx)")
def a11(spark, d):
    lines = line_rows(spark, d)
    small = region_rows(lines).selectExpr("page_id", "region_idx", "l + 20 AS l", "t + 8 AS t", "r - 20 AS r", "b - 8 AS b")
    return DOC.grown(small, lines)


@query("g8_promoted_regions", _LINES + " SELECT page_id, region_idx, line_idx, 'p' || page_id || '.r' || region_idx || '.jpg' AS image_filename, g.r - g.l AS width, g.b - g.t AS height, a.l - g.l AS l, a.t - g.t AS t, a.r - g.l AS r, a.b - g.t AS b, a.l - g.l < 0 OR a.t - g.t < 0 AS negative FROM lines a JOIN regions g USING (page_id, region_idx)")
def g8(spark, d):
    lines = line_rows(spark, d)
    return DOC.promoted(region_rows(lines), lines)


@query("p10_schema_audit", _LINES + " SELECT page_id, line_idx, CASE k WHEN 1 THEN 'no_x_height' ELSE 'short_baseline' END AS rule FROM (SELECT *, unnest([CASE WHEN sk % 7 = 0 THEN 1 END, CASE WHEN pk % 11 = 0 THEN 2 END]) AS k FROM lines) WHERE k IS NOT NULL")
def p10(spark, d):
    lines = line_rows(spark, d)
    return DOC.audit(lines.withColumns({"x_height": F.when(F.col("sk") % 7 != 0, F.col("x_height")), "baseline": F.when(F.col("pk") % 11 == 0, F.slice("baseline", 1, 1)).otherwise(F.col("baseline"))}))


@query("a6_line_metrics", _LINES + ", m AS (SELECT *, ((b - 0) + (b - pk % 4) + (b - pk * 2 % 4) + (b - pk * 3 % 4)) / 4 AS y, b - t AS h FROM lines), g AS (SELECT *, lead(y) OVER (PARTITION BY page_id ORDER BY line_idx) - y AS gap FROM m), a AS (SELECT page_id, count(*) AS n, avg(h) AS h, var_pop(h) AS v, avg(gap) AS g, stddev_pop(gap) AS s FROM g GROUP BY page_id) SELECT page_id, round_even(h, 4) AS x_height, round_even(v, 4) AS x_height_std, CASE WHEN n >= 3 THEN round_even(g, 4) END AS spacing, CASE WHEN n >= 3 THEN round_even(s, 4) END AS spacing_std FROM a")
def a6(spark, d):
    return DOC.line_metrics(line_rows(spark, d))


@query("a7_region_spacing", _LINES + ", g AS (SELECT *, cy - lag(cy) OVER (PARTITION BY page_id, region_idx ORDER BY line_idx) AS gap FROM lines) SELECT page_id, region_idx, coalesce(CAST(trunc(avg(gap)) AS INT), -1) AS avg, coalesce(CAST(trunc(min(gap)) AS INT), -1) AS min, coalesce(CAST(trunc(max(gap)) AS INT), -1) AS max, coalesce(CAST(trunc(stddev_pop(gap)) AS INT), -1) AS std FROM g GROUP BY ALL")
def a7(spark, d):
    return DOC.region_spacing(line_rows(spark, d))


@query("w2_reading_order", _LINES + ", o AS (SELECT page_id, region_idx, line_idx, row_number() OVER (PARTITION BY page_id, region_idx ORDER BY cy, cx, line_idx) - 1 AS k FROM lines) SELECT page_id, region_idx, line_idx, 'l' || k AS line_name FROM o")
def w2(spark, d):
    return DOC.reading_order(line_rows(spark, d)).select("page_id", "region_idx", "line_idx", "line_name")


@query("w4_biggest_region", _LINES + " SELECT * FROM regions QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY (r - l) * (b - t) DESC, region_idx) = 1")
def w4(spark, d):
    return DOC.biggest_region(region_rows(line_rows(spark, d)))


@query("g13_points_text", _LINES + " SELECT page_id, line_idx, l || ',' || t || ' ' || r || ',' || t || ' ' || r || ',' || b || ' ' || l || ',' || b AS points FROM lines")
def g13(spark, d):
    return line_rows(spark, d).select("page_id", "line_idx", G.points_text(F.col("coords")).alias("points"))


@query("g2_boxed_baselines", _LINES + " SELECT page_id, line_idx, CAST(least(400, greatest(30, l) + 7) AS DOUBLE) AS x0, CAST(greatest(0, least(300, b - pk * 3 % 4)) - 2 AS DOUBLE) AS y3 FROM lines")
def g2(spark, d):
    out = G.shifted(G.boxed(F.col("baseline"), F.lit(30), F.lit(0), F.lit(393), F.lit(300)), F.lit(7), F.lit(-2))
    return line_rows(spark, d).select("page_id", "line_idx", out[0]["x"].alias("x0"), out[3]["y"].alias("y3"))


_PAGE = f"WITH {X.SQL}, page AS (SELECT l_orderkey AS page_id, 800 AS width, 30 * (max(n) + 2) + CAST(max(l_partkey) % 900 AS INT) AS height FROM numbered GROUP BY 1)"


def page_rows(spark, d) -> DataFrame:
    return X.numbered(spark, d).groupBy(F.col("l_orderkey").alias("page_id")).agg(F.lit(800).alias("width"), (30 * (F.max("n") + 2) + (F.max("l_partkey") % 900).cast("int")).alias("height"))


@query("g9_tile_plan", _PAGE + ", ax AS (SELECT *, CASE WHEN n0 > 1 AND n0 * 256 - len < 20 * (n0 - 1) THEN n0 + 1 ELSE n0 END AS n FROM (SELECT page_id, a, len, CAST(ceil(len / 256) AS INT) AS n0 FROM (SELECT page_id, 'y' AS a, height AS len FROM page UNION ALL SELECT page_id, 'x', width FROM page)) WHERE len >= 256), st AS (SELECT page_id, a, len, n, unnest(range(n)) AS c FROM ax), s AS (SELECT page_id, a, CAST(CASE WHEN n > 1 AND c = n - 1 THEN len - 256 ELSE c * (256 - (n * 256 - len) // greatest(n - 1, 1)) END AS INT) AS s FROM st) SELECT y.page_id, y.s AS tile_y, x.s AS tile_x FROM s y JOIN s x ON x.page_id = y.page_id AND y.a = 'y' AND x.a = 'x'")
def g9(spark, d):
    rows = page_rows(spark, d).select("page_id", F.explode(G.tile_starts(F.col("height"), 256)).alias("tile_y"), "width")
    return rows.select("page_id", "tile_y", F.explode(G.tile_starts(F.col("width"), 256)).alias("tile_x"))


@query("p15_unusual_pages", _PAGE + " SELECT page_id, CASE WHEN height / width >= 2 THEN CAST(ceil(height / width) AS INT) WHEN height / width <= 0.2 THEN 1 ELSE 0 END AS rows, CASE WHEN height / width >= 2 THEN 1 WHEN height / width <= 0.2 THEN CAST(ceil(width / height) AS INT) ELSE 0 END AS cols FROM page")
def p15(spark, d):
    return page_rows(spark, d).select("page_id", G.unusual_patches(F.col("height"), F.col("width")).alias("p")).select("page_id", "p.*")


@query("w7_exact_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('46' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= floor(floor(n * 0.8) * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS subset FROM r")
def w7(spark, d):
    return D.split(X.table(spark, d, "documents").select("doc_id"), "doc_id")


@query("t2_random_files", "SELECT page_id, url FROM pages ORDER BY md5('46' || url), url LIMIT 20")
def t2(spark, d):
    return D.first_items(X.table(spark, d, "pages").select("page_id", "url"), "url", 20, "46")


@query("t3_repeated_samples", "SELECT page_id, repeat, page_id || '-' || repeat AS name FROM (SELECT page_id, CAST(unnest(range(3)) AS INT) AS repeat FROM pages)")
def t3(spark, d):
    return D.repeated(X.table(spark, d, "pages").select("page_id"), "page_id", 3)


@query("j7_unmatched_files", "WITH i AS (SELECT DISTINCT doc_id AS stem FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT DISTINCT doc_id AS stem FROM labels) SELECT coalesce(i.stem, n.stem) AS stem, CASE WHEN i.stem IS NULL THEN 'no image' ELSE 'no annotation' END AS problem FROM i FULL JOIN n ON i.stem = n.stem WHERE i.stem IS NULL OR n.stem IS NULL")
def j7(spark, d):
    images = X.table(spark, d, "documents").filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("stem"))
    return D.unmatched(images, X.table(spark, d, "labels").select(F.col("doc_id").alias("stem")))


@query("j9_pending_work", "SELECT doc_id AS stem FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT page_id FROM pages)")
def j9(spark, d):
    stems = lambda t, c: X.table(spark, d, t).select(F.col(c).alias("stem"))
    return D.pending(stems("documents", "doc_id"), stems("pages", "page_id"), stems("labels", "doc_id"))


@query("j10_cached_predictions", "WITH t AS (SELECT 'm' AS model_md5, md5(url) AS image_md5, min(page_id % 7) AS n_tiles FROM pages GROUP BY 2) SELECT *, n_tiles % 3 <> 0 AS hit FROM t")
def j10(spark, d):
    tiles = X.table(spark, d, "pages").groupBy(F.lit("m").alias("model_md5"), F.md5("url").alias("image_md5")).agg(F.min(F.col("page_id") % 7).alias("n_tiles"))
    cached = tiles.withColumn("n_tiles", F.when(F.col("n_tiles") % 3 != 0, F.col("n_tiles")).otherwise(-1))
    return D.cache_hits(tiles, cached)


@query("a14_otsu", "WITH h AS (SELECT user_id AS image, CAST(trunc(value) AS INT) % 256 AS bin, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT image, bin, sum(n) OVER w AS n0, sum(n * bin) OVER w AS s0, sum(n) OVER (PARTITION BY image) AS n, sum(n * bin) OVER (PARTITION BY image) AS s FROM h WINDOW w AS (PARTITION BY image ORDER BY bin)), g AS (SELECT image, bin, round_even(n0::DOUBLE * (n - n0) * pow(s0 / n0 - (s - s0) / (n - n0), 2), 3) AS gain FROM c WHERE n > n0) SELECT image, bin AS threshold FROM g QUALIFY row_number() OVER (PARTITION BY image ORDER BY gain DESC, bin) = 1")
def a14(spark, d):
    return D.otsu(X.table(spark, d, "events").groupBy(F.col("user_id").alias("image"), (F.col("value").cast("int") % 256).alias("bin")).agg(F.count("*").alias("n")))


@query("h5_line_frequency", "WITH p AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), k AS (SELECT unnest(range(1, 33)) AS k), f AS (SELECT vec_id, k, round(sqrt(pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2)), 6) AS a FROM p, k GROUP BY ALL) SELECT vec_id, CAST(k AS INT) AS lines FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, k) = 1")
def h5(spark, d):
    return X.table(spark, d, "embeddings").select("vec_id", raster.dominant_frequency("embedding").alias("lines"))


@query("p16_estimate_errors", f"WITH {X.SQL}, c AS (SELECT page_id, count(*) AS gt, CAST(min(label) + 3 AS BIGINT) AS est, (SELECT count(*) FROM pred WHERE pred.page_id = gt.page_id) AS pred FROM gt GROUP BY page_id) SELECT page_id, est - gt AS est_err, pred - gt AS pred_err, (est - gt) / gt AS est_rel, (pred - gt) / gt AS pred_rel, least(est, gt) / greatest(est, gt) AS fold FROM c")
def p16(spark, d):
    rows = X.numbered(spark, d)
    gt = X.gt_boxes(rows).groupBy("page_id").agg(F.count("*").alias("gt"), (F.min("label") + 3).cast("bigint").alias("est"))
    pred = X.pred_boxes(rows).groupBy("page_id").agg(F.count("*").alias("pred"))
    return D.estimate_errors(gt.join(pred, "page_id", "left").fillna(0, ["pred"]))


def layout_docs(spark, d) -> DataFrame:
    """Layout documents, boxes in parallel arrays; every tenth page's model does not know seals."""
    names = [F.array(*[F.lit(x) for x in ("Wr:OldText", "Wr:NewText", "Img:Seal")[:k]]) for k in (2, 3)]
    own = F.array_sort(F.collect_list(F.struct("line_idx", (F.col("pk") % 3).cast("int").alias("c"), F.array("l", "t", "r", "b").alias("box"))))
    docs = line_rows(spark, d).groupBy("page_id").agg(own.alias("x"))
    return docs.select("page_id", F.when(F.col("page_id") % 10 == 0, names[0]).otherwise(names[1]).alias("class_names"), F.col("x.c").alias("rect_classes"), F.col("x.box").alias("rect_LTRB"))


@query("p6_layout_boxes", _LINES + " SELECT page_id, CAST(line_idx - 1 AS INT) AS rect_idx, CASE pk % 3 WHEN 0 THEN 'Wr:OldText' ELSE 'Wr:NewText' END AS class_name, l, t, r, b FROM lines WHERE pk % 3 < 2")
def p6(spark, d):
    return files.layout_boxes(layout_docs(spark, d)).filter(F.col("class_name").isin("Wr:OldText", "Wr:NewText"))


@query("p7_layout_flags", _LINES + " SELECT page_id, CASE WHEN page_id % 10 <> 0 THEN bool_or(pk % 3 = 2) END AS seal, CASE WHEN page_id % 10 <> 0 THEN bool_or(pk % 3 = 0) END AS old_text FROM lines GROUP BY page_id")
def p7(spark, d):
    found = files.layout_flags(layout_docs(spark, d), ["Img:Seal", "Wr:OldText"])
    return found.select("page_id", F.col("found")[0].alias("seal"), F.col("found")[1].alias("old_text"))
