"""Pages, lines and detections derived from the general tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their number n on the page (the order) and the whole quantity q."""
    by = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    lines = table(spark, sf_dir, "lineitem")
    return lines.withColumns({"n": F.row_number().over(by), "q": F.col("l_quantity").cast("int")})


def gt_boxes(rows: DataFrame) -> DataFrame:
    """Ground-truth line boxes (page_id, label, l, t, r, b)."""
    return rows.selectExpr(
        "l_orderkey AS page_id", "n AS label", "int(20 + l_suppkey % 30) AS l", "int(30 * n + l_partkey % 7) AS t",
        "int(170 + l_suppkey % 30 + l_partkey % 200) AS r", "int(30 * n + l_partkey % 7 + 12 + q % 10) AS b",
    )


def pred_boxes(rows: DataFrame) -> DataFrame:
    """Shifted copies of the lines, some missed, and spurious ones; labels follow the page order."""
    shifted = rows.filter("NOT (l_returnflag = 'R' AND l_partkey % 3 = 0)").selectExpr(
        "l_orderkey AS page_id", "n", "0 AS extra", "int(20 + l_suppkey % 30 + l_partkey % 11) AS l", "int(30 * n + l_partkey % 7 + q % 6) AS t",
        "int(170 + l_suppkey % 30 + l_partkey % 200 + l_partkey % 11) AS r", "int(30 * n + l_partkey % 7 + q % 6 + 12 + q % 10 + l_suppkey % 3) AS b",
    )
    extra = rows.filter("l_partkey % 10 = 0").selectExpr("l_orderkey AS page_id", "n", "1 AS extra", "500 AS l", "int(30 * n) AS t", "int(560 + l_partkey % 50) AS r", "int(30 * n + 14) AS b")
    by = Window.partitionBy("page_id").orderBy("n", "extra")
    return shifted.unionByName(extra).select("page_id", F.row_number().over(by).alias("label"), "l", "t", "r", "b")


#: The same mapping for DuckDB: CTEs numbered, gt, pred.
SQL = """
numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS int) AS n, CAST(l_quantity AS int) AS q
  FROM lineitem),
gt AS (SELECT l_orderkey AS page_id, n AS label, CAST(20 + l_suppkey%30 AS int) AS l, CAST(170 + l_suppkey%30 + l_partkey%200 AS int) AS r,
    CAST(30*n + l_partkey%7 AS int) AS t, CAST(30*n + l_partkey%7 + 12 + q%10 AS int) AS b FROM numbered),
pred0 AS (SELECT l_orderkey AS page_id, n, 0 AS extra, CAST(20 + l_suppkey%30 + l_partkey%11 AS int) AS l, CAST(170 + l_suppkey%30 + l_partkey%200 + l_partkey%11 AS int) AS r,
    CAST(30*n + l_partkey%7 + q%6 AS int) AS t, CAST(30*n + l_partkey%7 + q%6 + 12 + q%10 + l_suppkey%3 AS int) AS b
  FROM numbered WHERE NOT (l_returnflag='R' AND l_partkey%3=0)
  UNION ALL SELECT l_orderkey, n, 1, 500, CAST(560 + l_partkey%50 AS int), CAST(30*n AS int), CAST(30*n + 14 AS int) FROM numbered WHERE l_partkey%10=0),
pred AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n, extra) AS int) AS label, l, r, t, b FROM pred0)"""
