"""Hard negatives by norm-bucketed search over whole-number vectors.

Candidates are sorted by norm and cut into buckets of neighbours, longest first, each with
its greatest norm. By Cauchy-Schwarz no row of a bucket scores above |anchor| x that norm, so an
anchor leaves a group of buckets where this falls below what it still seeks: the running k-th
score, and for negatives the lower limit of their window as well. Buckets are dealt to groups by a hash, so each group
has long and short rows, and blocks of anchors meet every group. One such pass finds the positives,
a second the negatives inside the windows that the positives' scores set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, stored, table

#: Rows of a bucket, of a block of anchors, and their vectors' bytes at most (but one row at least).
BUCKET, BLOCK, BYTES = 1024, 256, 1 << 20
#: Buckets of a group, about: a task holds one group.
GROUP = 32
#: Norms from here on have products beyond 64 bits.
LONGEST = float(1 << 31)
_NONE = np.iinfo(np.int64).min
_PACKED = "dims int, top double, ids binary, keys binary, labels binary, norms binary, vectors binary, windows binary"


def whole_rows(vectors: DataFrame, key: str, vector: str, label) -> DataFrame:
    """(dims, norm, id, key, label, v): usable rows once each, components as whole numbers floor(256 x)."""
    number = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256).cast("double"))
    fine = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    own = vectors.filter(F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & fine)
    rows = own.select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), number.alias("v")).distinct()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select(F.size("v").alias("dims"), norm.alias("norm"), "id", F.xxhash64("id", "label", "v").alias("key"), "label", "v").filter(F.col("norm") < LONGEST)


def _pack(rows: DataFrame, most: int) -> DataFrame:
    """Neighbouring rows of each partition as one row of binary columns; ``windows`` has up to 5 scores of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []

        def out() -> pa.RecordBatch:
            raw = lambda name, kind: np.array([r[name] for r in waiting], kind).tobytes()
            windows = np.full((len(waiting), max([1, *(len(r["windows"]) for r in waiting)])), _NONE)
            for i, r in enumerate(waiting):
                windows[i, : len(r["windows"])] = r["windows"]
            values = [waiting[0]["dims"], max(r["norm"] for r in waiting), raw("id", "<i8"), raw("key", "<i8"), raw("label", "<i8"), raw("norm", "<f8"), raw("v", "<f8"), windows.astype("<i8").tobytes()]
            kinds = [pa.int32(), pa.float64(), *[pa.binary()] * 6]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in _PACKED.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                dims = row["dims"]
                if waiting and (waiting[0]["dims"] != dims or len(waiting) >= max(1, min(most, BYTES // (8 * max(dims, 1))))):
                    yield out()
                waiting.append(row)
        if waiting:
            yield out()

    return mapped(rows.select("dims", "norm", "id", "key", "label", "v", "windows"), run, _PACKED)


class Rows:
    """The arrays of one packed row."""

    def __init__(self, row: dict):
        self.ids, self.keys, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "keys", "labels"))
        self.norms, self.top = np.frombuffer(row["norms"], "<f8"), row["top"]
        self.x = np.frombuffer(row["vectors"], "<f8").reshape(len(self.ids), row["dims"])
        self.windows = np.frombuffer(row["windows"], "<i8").reshape(len(self.ids), -1)

    def scores(self, other: Rows) -> np.ndarray:
        """Exact inner products with another's rows."""
        if self.top * other.top < 1 << 52:
            return (self.x @ other.x.T).astype(np.int64)
        return self.x.astype(np.int64) @ other.x.astype(np.int64).T


def best_of(anchors: Rows, buckets: list[Rows], same: bool, k: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(anchor's place, window, candidate id, score) of the ``k`` best of each anchor's windows in a group of buckets, longest first.

    ``same`` seeks rows of the anchor's label, in one window without limits.
    """
    if same:
        at, asked = np.arange(len(anchors.ids)), np.zeros(len(anchors.ids), np.int64)
        least, most = np.full(len(at), _NONE), np.full(len(at), np.iinfo(np.int64).max)
    else:
        at, slot = np.nonzero(anchors.windows != _NONE)
        asked = anchors.windows[at, slot]
        least, most = (np.array([f(int(p)) for p in asked], np.int64) for f in (lambda p: -(-low * p // 100), lambda p: high * p // 100))
        some = least <= most
        at, asked, least, most = at[some], asked[some], least[some], most[some]
    kept = [np.empty(0, np.int64)] * 3  # window's place, id, score
    seek = least.copy()
    for bucket in buckets:
        live = np.flatnonzero(anchors.norms[at] * bucket.top * (1 + 1e-9) + 1 >= seek.astype(np.float64))
        if not len(live):
            break
        rows, place = np.unique(at[live], return_inverse=True)
        part = Rows.__new__(Rows)
        part.x, part.top = anchors.x[rows], anchors.norms[rows].max()
        score = part.scores(bucket)
        good = anchors.labels[rows][:, None] == bucket.labels[None]
        good = (good if same else ~good) & (anchors.ids[rows][:, None] != bucket.ids[None])
        for s in range(0, len(live), 64):
            w, p = live[s : s + 64], place[s : s + 64]
            found, col = np.nonzero(good[p] & (score[p] >= seek[w][:, None]) & (score[p] <= most[w][:, None]))
            new = w[found], bucket.ids[col], score[p[found], col]
            kept = [np.concatenate(x) for x in zip(kept, new)]
        order = np.lexsort((kept[1], -kept[2], kept[0]))
        kept = [x[order] for x in kept]
        starts = np.searchsorted(kept[0], np.arange(len(at)))
        rank = np.arange(len(kept[0])) - starts[kept[0]]
        kept = [x[rank < k] for x in kept]
        full = kept[0][rank[rank < k] == k - 1]
        seek[full] = np.maximum(seek[full], kept[2][rank[rank < k] == k - 1])
    return at[kept[0]], asked[kept[0]], kept[1], kept[2]


def _meet(buckets: DataFrame, blocks: DataFrame, same: bool, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """(key, anchor_id, positive_score, vec_id, score): the ``k`` best of every anchor's windows over all buckets."""
    groups = max(1, -(-buckets.count() // GROUP))
    tasks = max(1, min(groups, 4 * int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = buckets.withColumns({"group": F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"), "ask": F.lit(False)})
    sent = blocks.withColumns({"group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), "ask": F.lit(True)})
    met = dealt.unionByName(sent).repartition(tasks, "dims", "group").sortWithinPartitions("dims", "group", "ask", F.col("top").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                if (row["dims"], row["group"]) != now:
                    now, own = (row["dims"], row["group"]), []
                if not row["ask"]:
                    own.append(Rows(row))
                    continue
                anchors = Rows(row)
                at, asked, ids, scores = best_of(anchors, own, same, k, low, high)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (anchors.keys[at], anchors.ids[at], asked, ids, scores)], ["key", "anchor_id", "positive_score", "vec_id", "score"])

    found = mapped(met, run, "key bigint, anchor_id bigint, positive_score bigint, vec_id bigint, score bigint").distinct()
    order = Window.partitionBy("key", "anchor_id", "positive_score").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor, label=None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, a row that passes the test ``is_anchor``.

    Scores are exact inner products of the components floor(256 x). An anchor's positives are the ``positives`` best other
    rows of its label; each one's negatives are the ``negatives`` best rows of other labels whose score lies within ``low`` and
    ``high`` per cent of the positive's. Equal scores go by ascending id. Rows with a null id or label, a null vector, or a null
    or non-finite component take no part, nor do vectors of a norm of 2**31 or more, whose products leave 64 bits. Rows that repeat id, label and vector count once; rows that
    share an id only are rows of their own, but never each other's partners. A row meets those of its own length; empty vectors
    score 0. Anchors without positives, and positives without negatives in their window, give no rows; an empty table
    gives an empty table. Other columns play no part. Every anchor meets every group, so the work grows with anchors
    times rows; a task holds one group of buckets and one block of anchors.
    """
    spark = vectors.sparkSession
    rows = stored(whole_rows(vectors, key, vector, F.col("label") if label is None else label), "whole")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.array().cast("array<bigint>").alias("windows")
    ordered = rows.select("*", none).repartitionByRange(n, "dims", F.col("norm").desc(), "id").sortWithinPartitions("dims", F.col("norm").desc(), "id")
    buckets = stored(_pack(ordered, BUCKET), "buckets")
    anchors = rows.filter(is_anchor)
    tasks = max(1, -(-anchors.count() // (16 * BLOCK)))
    blocks = lambda asked: _pack(asked.repartition(tasks, "key").sortWithinPartitions("dims", "norm"), BLOCK)
    near = stored(_meet(buckets, blocks(anchors.select("*", none)), True, positives).select("key", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = near.groupBy("key", F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("windows"))
    hard = _meet(buckets, blocks(anchors.join(windows, ["key", "id"])), False, negatives, low, high)
    hard = hard.select("key", "anchor_id", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(hard, ["key", "anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100; labels of ids divisible by 7 are moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


ORACLE = """WITH own AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM own a JOIN own b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 100 = 0),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
neg AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM pos JOIN met USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10"""
