"""Registered queries of annotation curation, work lists and deep maps; adds to the catalogue."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import datasets as D
from quire.operators import documents as DOC
from quire.operators import metrics as M
from quire.operators import spans as S
from quire.sources import files, tables
from quire.sources import fixtures as X

from .catalogue import _DEPTH, _LINES, _PAGE, _RUNS, line_rows, maps, page_rows, query, region_rows


@query("a1_label_areas", _RUNS + " SELECT page_id, label, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area FROM runs GROUP BY ALL")
def a1(spark, d):
    return S.areas(maps(spark, d)[0])


@query("p9_large_components", _RUNS + ", a AS (SELECT page_id, label FROM runs GROUP BY ALL HAVING sum(x1 - x0 + 1) >= 3000) SELECT page_id, label, y, x0, x1 FROM runs JOIN a USING (page_id, label)")
def p9(spark, d):
    return S.large(maps(spark, d)[0], 3000)


@query("a10_deep_areas", _RUNS + _DEPTH + " SELECT page_id, label, round(sum((least(r.x1, e.x1) - greatest(r.x0, e.x0) + 1) / e.depth), 6) AS area FROM runs r JOIN dp e USING (page_id, y) WHERE e.depth > 0 AND r.x0 <= e.x1 AND e.x0 <= r.x1 GROUP BY ALL")
def a10_areas(spark, d):
    return S.deep_areas(maps(spark, d)[0]).withColumn("area", F.round("area", 6))


def _deep(name: str, boxes: str) -> str:
    return f"""{name}_runs AS (SELECT page_id, label, unnest(range(t, b + 1)) AS y, l AS x0, r AS x1 FROM {boxes}),
{name}_ev AS (SELECT page_id, y, x, sum(d) AS d FROM (SELECT page_id, y, x0 AS x, 1 AS d FROM {name}_runs UNION ALL SELECT page_id, y, x1 + 1, -1 FROM {name}_runs) GROUP BY ALL),
{name}_dp AS (SELECT page_id, y, x AS x0, lead(x) OVER w - 1 AS x1, sum(d) OVER w AS depth FROM {name}_ev WINDOW w AS (PARTITION BY page_id, y ORDER BY x)),
{name} AS (SELECT page_id, y, label, greatest(r.x0, e.x0) AS x0, least(r.x1, e.x1) AS x1, depth FROM {name}_runs r JOIN {name}_dp e USING (page_id, y) WHERE depth > 0 AND r.x0 <= e.x1 AND e.x0 <= r.x1)"""


@query("a10_deep_intersections", f"WITH {X.SQL}, {_deep('p', 'pred')}, {_deep('g', 'gt')} SELECT page_id, p.label AS pred_label, g.label AS gt_label, round(sum((least(p.x1, g.x1) - greatest(p.x0, g.x0) + 1) / greatest(p.depth, g.depth)), 6) AS inter FROM p JOIN g USING (page_id, y) WHERE p.x0 <= g.x1 AND g.x0 <= p.x1 GROUP BY ALL")
def a10(spark, d):
    return M.deep_intersections(*maps(spark, d)).withColumn("inter", F.round("inter", 6))


@query("h2_summed_label_map", _RUNS + ", ev AS (SELECT page_id, y, x, sum(d) AS d, sum(v) AS v FROM (SELECT page_id, y, x0 AS x, 1 AS d, label AS v FROM runs UNION ALL SELECT page_id, y, x1 + 1, -1, -label FROM runs) GROUP BY ALL), sw AS (SELECT page_id, y, x AS x0, lead(x) OVER w - 1 AS x1, CAST(sum(v) OVER w AS BIGINT) AS label, sum(d) OVER w AS k FROM ev WINDOW w AS (PARTITION BY page_id, y ORDER BY x)) SELECT page_id, y, x0, x1, label FROM sw WHERE k > 0")
def h2(spark, d):
    return S.label_sums(S.pages(X.pred_boxes(X.numbered(tables.paged(spark), d))))


@query("h8_line_crops", f"WITH {X.SQL}, runs AS (SELECT page_id, label, l, t, r, b, unnest(range(t, b + 1)) AS py FROM pred) SELECT page_id, label, l, t, r, b, py - t AS y, 0 AS x0, r - l AS x1 FROM runs")
def h8(spark, d):
    return S.crops(maps(spark, d)[0])


@query("p3_upgraded_documents", _PAGE + " SELECT page_id, width AS image_width, height AS image_height FROM page")
def p3(spark, d):
    old = F.col("page_id") % 2 == 0
    pages = page_rows(spark, d).select("page_id", F.when(old, F.array("width", "height")).alias("image_wh"), F.when(~old, F.col("width")).alias("image_width"), F.when(~old, F.col("height")).alias("image_height"))
    return files.upgraded(pages)


_CORNER = " || ',' || ".join("'{{\"x\":' || CAST({} AS DOUBLE) || ',\"y\":' || CAST({} AS DOUBLE) || '}}'".format(*p) for p in ("lt", "rt", "rb", "lb"))


@query("p4_stripped_documents", _LINES + f" SELECT page_id, region_idx, 'clean' AS comment, '{{\"id\":\"l' || line_idx || '\",\"coords\":[' || {_CORNER} || ']}}' AS first_line FROM lines QUALIFY row_number() OVER (PARTITION BY page_id, region_idx ORDER BY line_idx) = 1")
def p4(spark, d):
    lines = line_rows(spark, d)
    pages = DOC.stripped(DOC.nested(region_rows(lines), lines), ["text", "x_height", "baseline"], "clean")
    rows = pages.select("page_id", "comment", F.posexplode("regions").alias("k", "r"))
    return rows.select("page_id", F.regexp_replace("r.id", "^r", "").cast("int").alias("region_idx"), "comment", F.to_json(F.get("r.lines", F.lit(0))).alias("first_line"))


@query("j5_region_lines", _LINES + " SELECT g.page_id, 'r' || g.region_idx AS region_id, count(a.line_idx) AS n_lines FROM regions g LEFT JOIN (SELECT * FROM lines WHERE sk % 2 = 0) a USING (page_id, region_idx) GROUP BY ALL")
def j5(spark, d):
    lines = line_rows(spark, d)
    pages = DOC.nested(region_rows(lines), lines.filter("sk % 2 = 0"))
    return pages.select("page_id", F.explode("regions").alias("r")).select("page_id", F.col("r.id").alias("region_id"), F.size("r.lines").cast("bigint").alias("n_lines"))


@query("w5_height_cutoff", _LINES + ", m AS (SELECT page_id, region_idx, line_idx, b - t AS line_height, round(avg(b - t) OVER w - 1.5 * stddev_pop(b - t) OVER w, 9) AS least FROM lines WINDOW w AS (PARTITION BY page_id, region_idx)) SELECT page_id, region_idx, line_idx, line_height FROM m WHERE line_height > least")
def w5(spark, d):
    return DOC.tall_enough(line_rows(spark, d).select("page_id", "region_idx", "line_idx", F.col("x_height").alias("line_height")))


@query("a13_biggest_region_lines", _LINES + ", g AS (SELECT * FROM regions QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY (r - l) * (b - t) DESC, region_idx) = 1) SELECT g.page_id, g.region_idx, count(*) AS n_lines FROM g JOIN lines a USING (page_id, region_idx) GROUP BY ALL")
def a13(spark, d):
    lines = line_rows(spark, d)
    return DOC.biggest_region_lines(region_rows(lines), lines)


@query("j13_size_mismatches", _PAGE + " SELECT page_id, width, height, width AS image_width, height + 1 AS image_height FROM page WHERE page_id % 5 = 0")
def j13(spark, d):
    pages = page_rows(spark, d)
    return DOC.size_mismatches(pages, pages.withColumn("height", F.col("height") + (F.col("page_id") % 5 == 0).cast("int")))


@query("j8_work_list", "WITH f AS (SELECT DISTINCT '/fs/' || page_id % 50 || '/' || page_id AS stem FROM pages WHERE page_id % 11 = 0 OR page_id % 50 % 3 <> 0) SELECT stem || '.jpg' AS image, stem || '.layout.json' AS layout_path, stem || '.lines.json' AS output_path FROM f")
def j8(spark, d):
    listed = X.table(spark, d, "pages").select("page_id", F.concat(F.lit("/fs/"), F.col("page_id") % 50, F.lit("/"), F.col("page_id"), F.lit(".jpg")).alias("path"))
    marked = listed.filter("page_id % 50 % 3 <> 0").select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()
    return D.work_list(listed.filter("page_id % 11 = 0"), listed, marked)


@query("j11_line_counts", _LINES + ", big AS (SELECT page_id, l, t, r, b FROM regions QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY (r - l) * (b - t) DESC, region_idx) = 1), c AS (SELECT page_id, count(*) AS n FROM gt GROUP BY 1), p AS (SELECT page_id, count(*) AS n FROM pred GROUP BY 1) SELECT c.page_id, CASE WHEN c.page_id % 3 < 2 THEN c.n + CASE WHEN c.page_id % 3 = 1 THEN 1 ELSE 0 END ELSE -1 END AS gt, CASE WHEN c.page_id % 7 > 0 THEN c.n + 3 ELSE -1 END AS est, coalesce(p.n, -1) AS pred, l, t, r, b FROM c LEFT JOIN p USING (page_id) LEFT JOIN big USING (page_id)")
def j11(spark, d):
    gt, pred = (b.groupBy("page_id").agg(F.count("*").alias("n")) for b in (X.gt_boxes(X.numbered(spark, d)), X.pred_boxes(X.numbered(spark, d))))
    return D.count_rows(gt, gt.filter("page_id % 3 = 0"), gt.filter("page_id % 3 = 1").withColumn("n", F.col("n") + 1), gt.filter("page_id % 7 > 0").withColumn("n", F.col("n") + 3), pred, DOC.biggest_region(region_rows(line_rows(spark, d))))


@query("u3_unsampled_files", "WITH s AS (SELECT page_id FROM pages ORDER BY md5('46' || url), url LIMIT 20) SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM s)")
def u3(spark, d):
    pages = X.table(spark, d, "pages").select("page_id", "url")
    return D.remainder(pages, D.first_items(pages, "url", 20, "46"), "page_id").select("page_id", "url")


_STRIPS = """, pt AS (SELECT page_id, line_idx, unnest(range(4)) AS k, l, r, b, pk, b - t AS xh FROM lines),
pts AS (SELECT page_id, line_idx, k, xh, CAST(CASE k WHEN 0 THEN l WHEN 1 THEN l + (r - l) // 3 WHEN 2 THEN l + 2 * (r - l) // 3 ELSE r END AS DOUBLE) AS x, b - pk * k % 4 - xh / 2 AS y FROM pt),
nb AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM pts WINDOW w AS (PARTITION BY page_id, line_idx ORDER BY k)),
md AS (SELECT *, coalesce(ax, 2 * x - bx) - x AS lx, coalesce(ay, 2 * y - by_) - y AS ly, coalesce(bx, 2 * x - ax) - x AS rx, coalesce(by_, 2 * y - ay) - y AS ry FROM nb),
tn AS (SELECT *, (atan(ly / lx) + atan(ry / rx)) / 2 AS turn, CAST(trunc(xh * 1.25) AS INT) / 2 AS half FROM md),
st AS (SELECT page_id, line_idx, unnest(CASE WHEN k = 0 THEN [0, 7, 8] ELSE [k, 7 - k] END) AS pos, k, x, y, turn, half FROM tn)
SELECT page_id, line_idx, CAST(pos AS INT) AS pos, trunc(CASE WHEN pos = k OR pos = 8 THEN x + half * sin(turn) ELSE x - half * sin(turn) END) AS x, trunc(CASE WHEN pos = k OR pos = 8 THEN y - half * cos(turn) ELSE y + half * cos(turn) END) AS y FROM st"""


@query("g6_rescaled_polygons", _LINES + _STRIPS)
def g6(spark, d):
    out = DOC.rescaled(line_rows(spark, d), 1.25).select("page_id", "line_idx", F.posexplode("coords").alias("pos", "p"))
    return out.select("page_id", "line_idx", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query("g5_boxed_strips", _LINES + _STRIPS.replace("\nSELECT page_id, line_idx, CAST(pos", ",\nq AS (SELECT page_id, line_idx, CAST(pos") + ") SELECT q.page_id, q.line_idx, pos, least(r, greatest(l, x)) AS x, least(b, greatest(t, y)) AS y FROM q JOIN lines USING (page_id, line_idx)")
def g5(spark, d):
    """Strips around the baselines, kept within a box: here each line's own."""
    out = DOC.rescaled(line_rows(spark, d), 1.25, box=list("ltrb")).select("page_id", "line_idx", F.posexplode("coords").alias("pos", "p"))
    return out.select("page_id", "line_idx", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query("g7_baselines", _LINES + " SELECT page_id, line_idx, l AS x, (t + b) / 2 + (b - t) / 2 AS y FROM lines")
def g7(spark, d):
    lines = line_rows(spark, d)
    center = F.array(G.point(F.col("l"), F.col("cy")), G.point(F.col("r"), F.col("cy")))
    own = lines.select("page_id", "line_idx", F.get(G.shifted(center, F.lit(0), F.col("x_height") / 2), F.lit(0)).alias("p"))
    return own.select("page_id", "line_idx", F.col("p.x").cast("int").alias("x"), F.col("p.y").alias("y"))


@query("p13_labels_applied_twice", f"WITH {X.SQL}, two AS (SELECT * FROM pred WHERE label % 5 = 0) SELECT page_id, label, CAST(sum(greatest(0, r - l - 99)) AS BIGINT) AS pixels FROM (SELECT *, unnest(range(t, b + 1)) AS y FROM two) WHERE r - l >= 100 GROUP BY ALL")
def p13_twice(spark, d):
    """Each fifth label once more, from 100 pixels to its right on."""
    pred = maps(spark, d)[0]
    return S.applied_twice(pred.unionByName(pred.filter("label % 5 = 0").withColumns({"x0": F.col("x0") + 100, "x1": F.col("x1") + 100})))


@query("a11_outside_lines", _LINES + " SELECT page_id, region_idx, line_idx FROM lines a JOIN (SELECT page_id, region_idx, l + 30 AS l2, t AS t2, r - 30 AS r2, b AS b2 FROM regions) USING (page_id, region_idx) WHERE l < l2 OR t < t2 OR r > r2 OR b > b2")
def a11_outside(spark, d):
    lines = line_rows(spark, d)
    return DOC.outside(region_rows(lines).withColumns({"l": F.col("l") + 30, "r": F.col("r") - 30}), lines)


def written(spark, name: str) -> str:
    """A new path in the folder that the cluster shares; a temporary folder only on a single machine where none is set, as in tests."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not home:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        home = tempfile.mkdtemp(prefix="quire-files-")
    return f"{home.rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"


@query("s1_document_files", _LINES + """, o AS (SELECT *, page_id % 3 AS gen FROM lines)
SELECT 'p' || page_id || '.jpg' AS image_filename, 800 AS image_width, CAST(page_id % 1000 + 100 AS INT) AS image_height, line_idx, CASE gen WHEN 2 THEN '' ELSE 'r' END || region_idx AS region_id, CASE gen WHEN 2 THEN '' ELSE 'l' END || line_idx AS id, b - t AS x_height,
  CASE WHEN gen = 2 THEN NULL WHEN sk % 5 = 0 THEN ' ' ELSE 'line ' || line_idx END AS text, CAST(l AS DOUBLE) AS first_x, CASE WHEN gen = 2 THEN NULL ELSE 4 END AS n_baseline, CASE WHEN gen = 2 THEN 4 END AS n_centerline FROM o""")
def s1(spark, d):
    """Documents of three generations, written as text and read back: nested regions, lines that name their region, and the old names."""
    lines = line_rows(spark, d)
    regions, gen = region_rows(lines), F.col("page_id") % 3
    size = [F.lit(800).alias("image_width"), (F.col("page_id") % 1000 + 100).cast("int").alias("image_height")]
    file = F.concat(F.lit("p"), F.col("page_id"), F.lit(".jpg"))
    nested = files.plain(DOC.nested(regions.filter(gen == 0), lines.filter(gen == 0)).select("page_id", file.alias("image_filename"), *size, F.lit("x").alias("creator"), "regions"))
    pairs = lambda c: F.transform(c, lambda p: F.array(p["x"], p["y"]))
    flat = F.struct("line_idx", "id", pairs("coords").alias("coords"), pairs("baseline").alias("baseline"), F.col("x_height").alias("x-height"), "text", F.col("region_id").alias("region"))
    named = lines.filter(gen == 1).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(flat)), lambda x: x.dropFields("line_idx")).alias("lines"))
    named = named.select(file.alias("image_filename"), *size, "lines")
    line = F.struct("line_idx", F.col("line_idx").alias("id"), pairs("coords").alias("boundary"), F.col("x_height").alias("stroke_width"), pairs("baseline").alias("centerline"))
    old = lines.filter(gen == 2).groupBy("page_id", "region_idx").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.dropFields("line_idx")).alias("lines"))
    old = old.join(regions.select("page_id", "region_idx", pairs("coords").alias("boundary")), ["page_id", "region_idx"])
    old = old.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col("region_idx").alias("id"), F.lit("text_region").alias("type"), "boundary", "lines"))).alias("regions"))
    old = old.select(file.alias("imagename"), F.array(*size).alias("image_wh"), "regions")
    text = lambda frame: frame.select(F.to_json(F.struct("*")).alias("value"))
    path = written(spark, "documents")
    text(nested).unionByName(text(named)).unionByName(text(old)).write.text(path)
    read = files.read_json(spark, path, lines=True).withColumn("page_id", F.col("image_filename"))
    found = DOC.flat_lines(read).join(read.select("page_id", "image_width", "image_height"), "page_id")
    return found.select(F.col("page_id").alias("image_filename"), "image_width", "image_height", "line_idx", "region_id", "id", F.col("x_height").cast("int").alias("x_height"), "text", F.col("coords")[0]["x"].alias("first_x"), F.array_size("baseline").alias("n_baseline"), F.array_size("centerline").alias("n_centerline"))


def _xml(spark, d):
    """Pages as PageXML whose regions are 20 pixels too narrow, written and read back."""
    lines = line_rows(spark, d)
    small = region_rows(lines).withColumn("coords", G.rectangle(F.col("l") + 20, F.col("t"), F.col("r") - 20, F.col("b")))
    pages = lines.select("page_id").distinct().select("page_id", F.lit(800).alias("width"), F.lit(2000).alias("height"), F.lit("x").alias("creator"), F.lit("a & b").alias("comments"))
    path = written(spark, "pages")
    files.write_xml(files.xml_pages(small, lines, pages), path, per_page=False)
    return files.read_xml(spark, path, lines=True).withColumn("page_id", F.col("image_filename").cast("bigint"))


@query("s2_xml_lines", _LINES + " SELECT page_id, 'r' || region_idx AS region_id, 'l' || line_idx AS id, 'line ' || line_idx AS text, CAST(l AS DOUBLE) AS first_x, CAST(b AS DOUBLE) AS first_y, 'a & b' AS comments FROM lines WHERE sk % 5 <> 0")
def s2(spark, d):
    pages = _xml(spark, d)
    found = files.xml_lines(pages, with_text=True).join(pages.select("page_id", "comments"), "page_id")
    return found.select("page_id", F.element_at("region_path", -1).alias("region_id"), "id", "text", F.col("coords")[0]["x"].alias("first_x"), F.col("baseline")[0]["y"].alias("first_y"), "comments")


@query("s4_xml_regions", _LINES + """, s AS (SELECT page_id, region_idx, l + 20 AS l, t, r - 20 AS r, b FROM regions), o AS (SELECT a.page_id, a.region_idx, min(a.l) AS l2, min(a.t) AS t2, max(a.r) AS r2, max(a.b) AS b2, count(*) AS n FROM lines a JOIN s USING (page_id, region_idx) WHERE a.l < s.l OR a.t < s.t OR a.r > s.r OR a.b > s.b GROUP BY ALL)
SELECT page_id, 'r' || region_idx AS region_id, CAST(least(l, l2) AS DOUBLE) AS l, CAST(least(t, t2) AS DOUBLE) AS t, CAST(greatest(r, r2) AS DOUBLE) AS r, CAST(greatest(b, b2) AS DOUBLE) AS b, coalesce(n, 0) AS n_outside FROM s LEFT JOIN o USING (page_id, region_idx)""")
def s4(spark, d):
    pages = _xml(spark, d)
    regions, lines = files.xml_regions(pages), files.xml_lines(pages)
    return files.xml_boxes(regions, lines).select("page_id", "region_id", *"ltrb", "n_outside")
