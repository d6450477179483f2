"""Span tables in buckets of pages: joins and sums within pages read them without an exchange.

A table is written once, its runs dealt by page to a fixed number of buckets and sorted there by page and row. Whatever
joins on page and row, or sums by page and label, then finds the rows it needs in one bucket of each
side. Spark takes a table dealt by page as dealt for a join on (page, row) only if
``spark.sql.requireAllClusterKeysForCoPartition`` is off; ``paged`` gives a session for that and leaves the caller's as it is.
A bucket holds whole pages, so a task needs room for its rows of a sort, which spills, not for a page at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Off in a session for paged work.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def paged(spark: SparkSession) -> SparkSession:
    """A session with the same settings and catalogue in which what is dealt by page stays so; the given one is unchanged."""
    out = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    out.conf.set(_ALL_KEYS, "false")
    return out


def bucket_count(spark: SparkSession) -> int:
    """Buckets for runs of the session's size: as many as a shuffle has partitions, at least 16, so that a bucket's sort stays in memory as tables grow."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_spans(spans: DataFrame, folder: str, buckets: int, name: str | None = None, runs: Callable[[DataFrame], DataFrame] | None = None, dealt: bool = False) -> str:
    """Store runs (page_id, label, y, x0, x1 and further columns) in ``folder`` as a table of ``buckets``; returns the table's name.

    Rows are dealt by page before they are written, so there is one file a bucket, whatever the number of tasks. Tables that are to be joined need the
    same number of buckets, about the runs' bytes over those of a task. Writing again under a name replaces the table, so a failed job is
    run again as it is. Null page ids share one bucket and join nothing. An empty table has its columns and no rows.
    With ``runs`` the rows are something smaller (boxes, say), which is dealt, and made into runs where it lies. Rows that lie in so many
    buckets already (``dealt``: they come from such a table, page by page) are not dealt.
    """
    name = name or f"quire_spans_{uuid.uuid4().hex}"
    lying = spans if dealt else spans.repartition(buckets, "page_id")
    own = runs(lying) if runs else lying
    own.write.format("parquet").bucketBy(buckets, "page_id").sortBy("page_id", "y").option("path", f"{folder.rstrip('/')}/{name}").mode("overwrite").saveAsTable(name)
    return name


def read_spans(spark: SparkSession, name: str) -> DataFrame:
    """A table of spans as ``write_spans`` made it, in a session for paged work."""
    return paged(spark).table(name)


def drop_spans(spark: SparkSession, name: str) -> None:
    """Forget a table; its files stay until their folder is cleared."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def exchanges(frame: DataFrame) -> list[str]:
    """The rows that a frame's plan deals out again, each as the text of its exchange; broadcasts are left out."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange ", 1)[1] for line in plan.splitlines() if "Exchange " in line and "BroadcastExchange" not in line]
