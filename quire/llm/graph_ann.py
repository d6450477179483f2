"""Nearest neighbours by cosine, through a robust-pruned directed graph on each shard.

Equal vectors are merged first (their smallest ids stay with them), and the distinct ones of one length are
dealt to shards of bounded size by a hash. A shard's task builds a graph: points come in
batches, a greedy search from the entry point proposes each one's neighbours, pruning
keeps a neighbour only if no kept one is nearer to it by the factor ``alpha`` (so long
edges survive), and edges are added both ways and pruned again. A second pass repeats this with
``alpha`` relaxed. A beam search then runs the queries on every shard, and the
best of all shards are merged. Many searches advance together as numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, slices, stored, table

#: Distinct vectors of a shard, about, whatever the session: recall depends on it, and on the beam.
SHARD = 8192
DEGREE = 24
#: Beam of the queries and of the searches that build a graph.
BEAM, BUILD_BEAM = 128, 32
ALPHA = 1.2
_BATCH, _EXPAND = 256, 4


class Graph:
    """A directed graph over unit vectors; distance is 1 - cosine."""

    def __init__(self, unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 11):
        self.x, self.n, self.degree, self.beam = unit, len(unit), degree, beam
        self.edges = np.full((self.n, degree), -1, np.int32)
        self.entry = 0
        if not self.n:
            return
        self.entry = int(np.argmax(unit @ unit.mean(0)))
        order = np.random.default_rng(seed).permutation(self.n)
        for a in (1.0, alpha):
            at, size = 0, 8 if a == 1.0 else _BATCH
            while at < self.n:
                self._insert(order[at : at + size], a)
                at += size
                size = min(2 * size, _BATCH)

    def search(self, queries: np.ndarray, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the beam of every query, nearest first; -1 and 9 where it is short."""
        beam, q = beam or self.beam, len(queries)
        ids = np.full((q, beam), -1, np.int32)
        dist = np.full((q, beam), 9, np.float32)
        done = np.ones((q, beam), bool)
        seen = np.zeros((q, self.n + 1), bool)  # the last column stands for no neighbour
        ids[:, 0], done[:, 0], seen[:, self.entry], seen[:, -1] = self.entry, False, True, True
        dist[:, 0] = 1 - queries @ self.x[self.entry]
        live = np.arange(q)
        while len(live := live[~done[live].all(axis=1)]):
            own_ids, own_dist, own_done = ids[live], dist[live], done[live]
            pick = np.argsort(own_done, axis=1, kind="stable")[:, :_EXPAND]
            at = np.where(np.take_along_axis(own_done, pick, 1), -1, np.take_along_axis(own_ids, pick, 1))
            np.put_along_axis(own_done, pick, True, 1)
            near = np.where(at[:, :, None] < 0, -1, self.edges[at]).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            near.sort(axis=1)
            near = near[:, int((near < 0).sum(1).min()) :]
            d = 1 - np.matmul(self.x[near], queries[live][:, :, None])[:, :, 0]
            d[near < 0] = 9
            all_ids, all_dist = np.concatenate([own_ids, near], 1), np.concatenate([own_dist, d], 1)
            all_done = np.concatenate([own_done, near < 0], 1)
            best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            ids[live], dist[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_dist, all_done))
        return ids, dist

    def _prune(self, points: np.ndarray, near: np.ndarray, alpha: float) -> np.ndarray:
        """At most ``degree`` diverse ones of the candidates [points, k] (-1: none)."""
        near = np.where(near == points[:, None], -1, near)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        d = 1 - np.einsum("pd,pkd->pk", self.x[points], self.x[near])
        d[near < 0] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, : 2 * self.degree]
        near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
        between = 1 - np.matmul(self.x[near], self.x[near].transpose(0, 2, 1))
        open_, rows = np.isfinite(d), np.arange(len(points))
        out = np.full((len(points), self.degree), -1, np.int32)
        for k in range(self.degree):
            pick = np.argmax(open_, axis=1)
            some = open_[rows, pick]
            if not some.any():
                break
            out[some, k] = near[rows, pick][some]
            open_ &= ~((alpha * between[rows, pick] <= d) & some[:, None])
            open_[rows, pick] = False
        return out

    def _insert(self, points: np.ndarray, alpha: float) -> None:
        found, _ = self.search(self.x[points])
        self.edges[points] = self._prune(points, np.concatenate([found, self.edges[points]], 1), alpha)
        to, of = self.edges[points].ravel(), np.repeat(points, self.degree)
        of, to = of[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        targets, start, count = np.unique(to, return_index=True, return_counts=True)
        width = int(count.max()) if len(count) else 0
        for lo in range(0, len(targets), 1024):
            own, s, c = targets[lo : lo + 1024], start[lo : lo + 1024], count[lo : lo + 1024]
            new = np.full((len(own), min(width, int(c.max()))), -1, np.int64)
            cell = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            new[np.repeat(np.arange(len(own)), c), cell] = of[s[0] : s[-1] + c[-1]]
            both = np.concatenate([self.edges[own], new], 1)
            full = (both >= 0).sum(1) > self.degree
            if full.any():
                self.edges[own[full]] = self._prune(own[full], both[full], alpha)
            short = own[~full]
            self.edges[short] = np.sort(both[~full], axis=1)[:, ::-1][:, : self.degree]


def _usable(vector):
    """Neither null, empty nor zero, and all components finite."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their squares neither overflow nor vanish; exact but for vanishing components."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Shard:
    """The points of one shard, their ids, and the graph over them, built when the first query comes."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.names: list[list[int]] = []
        self.graph: Graph | None = None

    def add(self, vectors: np.ndarray, names: list[list[int]]) -> None:
        self.parts.append(vectors)
        self.names += names

    def answers(self, queries: list[int], vectors: np.ndarray, k: int, beam: int) -> pa.RecordBatch | None:
        """(query_id, vec_id, score) of the ``k`` nearest found for each query; none without points."""
        if not self.parts:
            return None
        if self.graph is None:
            self.x = _scaled(np.concatenate(self.parts))
            self.parts = [self.x]
            self.norms = _norm(self.x)[:, 0]
            self.graph = Graph((self.x / self.norms[:, None]).astype(np.float32))
        q = _scaled(vectors)
        size = _norm(q)
        found, _ = self.graph.search((q / size).astype(np.float32), max(beam, k + 1))
        out = []
        for row, ask in enumerate(queries):
            near = found[row][found[row] >= 0]
            score = np.clip((self.x[near] @ q[row]) / (self.norms[near] * size[row, 0]), -1, 1)
            out += [(ask, n, -s) for s, n in sorted((-s, n) for p, s in zip(near.tolist(), score.tolist()) for n in self.names[p] if n != ask)[:k]]
        of, ids, scores = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, beam: int = BEAM, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest of all other vectors found.

    ``queries`` has rows of the same two columns; a candidate with the query's id is the
    query itself. Score is the cosine in double precision, of vectors of any finite size; ties go to the smaller id. Null, empty and zero
    vectors, vectors with null or non-finite components, and null ids take no part. A query meets the vectors
    of its own length. Equal vectors all count as candidates; rows that repeat an id and vector count once. Other columns play no
    part. Empty tables give an empty table. A task holds one shard; every query goes to every shard, so the
    searches grow with queries times shards.
    """
    own = vectors.filter(_usable(vector) & F.col(key).isNotNull())
    first_ids = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
    salted = own.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = salted.groupBy("v", "salt").agg(first_ids.alias("ids"))
    classes = stored(some.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")), "vectors")
    tasks, n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes.count()
    shards = max(1, -(-n // shard))
    size = F.size("v").alias("dims")
    points = classes.select(size, F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("bigint").alias("query"), "v", "ids")
    asked = queries.filter(_usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("query"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["query", "v"])
    sent = asked.select(size, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query", "v", F.lit(None).cast("array<bigint>").alias("ids"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, Shard()
        for batch in slices(batches, 256):
            group = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            ask = batch.column(2).to_pylist()
            starts = [i for i in range(len(group)) if not i or group[i] != group[i - 1] or (ask[i] is None) != (ask[i - 1] is None)]
            for s, e in zip(starts, [*starts[1:], len(group)]):
                if group[s] != now:
                    now, own = group[s], Shard()
                part = batch.slice(s, e - s)
                if ask[s] is None:
                    own.add(_matrix(part.column(3)), part.column(4).to_pylist())
                elif (out := own.answers(ask[s:e], _matrix(part.column(3)), k, beam)) is not None:
                    yield out

    met = points.unionByName(sent).repartition(tasks, "dims", "shard").sortWithinPartitions("dims", "shard", F.col("query").asc_nulls_first())
    found = mapped(met, search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50; unusable and repeated rows as ``nearest`` states."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
