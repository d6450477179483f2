"""Ranked lexical search over shards of variable blocks.

A first pass cuts the documents of each task into shards and writes their posting lists, one
row a shard, with counts of documents and terms; sums over all shards give the weights. The
search reads a shard's lists as whole-number score contributions. Dynamic programming cuts each list into blocks:
a block costs its length times its greatest contribution, plus a constant for being opened, and
the cheapest cut has the least bound error for its number of blocks. Block bounds of a query's terms, added
up along the document axis, bound every stretch of documents; stretches below the running k-th score are
skipped with the blocks that lie in none of the others, so the ranking is exact. Shards of
one task hand the k-th score on.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import byte_texts, chunked, mapped, slices, stored, table

#: Documents and postings of a shard at most (but one document at least).
DOCS, POSTINGS = 16384, 1 << 20
#: Longest block, and what it costs to open one, in units of a list's greatest less its mean contribution.
LONGEST, OPEN = 64, 8
#: Queries searched together, and distinct query terms up to which only their postings are kept.
QUERIES, TERMS = 1024, 1_000_000
#: Bytes of a text that are cut into terms at once.
_PIECE = 1 << 20
_APART = bytes.maketrans(bytes(range(128)), bytes(c if chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(128)))
_SHARD = "docs bigint, tokens bigint, terms array<string>, dfs array<int>, ids binary, nulls binary, lengths binary, places binary, tfs binary"


def term_counts(text: bytes) -> Counter:
    """How often each term occurs: runs of ASCII letters and digits, lower-cased, and of all other characters beyond ASCII."""
    out, at = Counter(), 0
    text = text.translate(_APART)
    while len(text) - at > _PIECE and (cut := text.find(b" ", at + _PIECE)) >= 0:
        out.update(text[at:cut].split(b" "))
        at = cut
    out.update(text[at:].split(b" "))
    del out[b""]
    return out


class Building:
    """Posting lists of a shard's documents as they come."""

    def __init__(self, kept: set[bytes] | None):
        self.kept, self.terms = kept, {}
        self.ids, self.lengths = [], []
        self.of, self.doc, self.tf = array("I"), array("I"), array("Q")

    def add(self, doc_id: int | None, counts: Counter) -> None:
        own = counts if self.kept is None else self.kept & counts.keys()
        place = self.terms.setdefault
        self.of.extend([place(t, len(self.terms)) for t in own])
        self.tf.extend([counts[t] for t in own])
        self.doc.extend([len(self.ids)] * len(own))
        self.ids.append(doc_id)
        self.lengths.append(counts.total())

    def full(self) -> bool:
        return len(self.ids) >= DOCS or len(self.of) >= POSTINGS

    def row(self) -> pa.RecordBatch:
        of, names = np.array(self.of), list(self.terms)
        order = np.argsort(of, kind="stable")
        values = [
            len(self.ids), sum(self.lengths), [x.decode("utf-8", "replace") for x in names], np.bincount(of, minlength=len(names)).tolist(),
            np.array([x or 0 for x in self.ids], "<i8").tobytes(), np.array([x is None for x in self.ids]).tobytes(), np.array(self.lengths, "<i8").tobytes(),
            np.array(self.doc)[order].astype("<u2").tobytes(), np.array(self.tf)[order].astype("<u4").tobytes(),
        ]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in _SHARD.split(", ")])


def index(docs: DataFrame, terms: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of posting lists of all documents with a term, stored; ``terms`` keeps only those terms' lists.

    Documents stay in the task that reads them, so nothing is shuffled and a hot source or frequent term is no hot key.
    Documents without terms, null texts included, are in no shard. A very long text is cut into terms piece by piece.
    """
    sent = None if terms is None else docs.sparkSession.sparkContext.broadcast({x.encode() for x in terms})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        building = Building(sent and sent.value)
        for batch in slices(batches):
            for doc_id, raw in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                if counts := term_counts(raw):
                    building.add(doc_id, counts)
                    if building.full():
                        yield building.row()
                        building = Building(building.kept)
        if building.ids:
            yield building.row()

    return stored(mapped(docs.select(F.col(key).cast("bigint"), F.col(text)), run, _SHARD), "postings")


def blocks(lists: list[np.ndarray], longest: int = LONGEST, opening: float = OPEN) -> list[np.ndarray]:
    """Where the blocks of each list start: the cut of least total bound error plus opening costs.

    The cheapest cut of the first j postings ends with some block of at most ``longest``; lists of like lengths advance together.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lists)
    sizes = np.array([len(x) for x in lists], np.int64)
    order = [i for i in np.argsort(-sizes, kind="stable").tolist() if sizes[i]]
    at = 0
    while at < len(order):
        most = int(sizes[order[at]])
        rows = [i for i in order[at : at + max(1, (1 << 21) // most)] if 2 * sizes[i] >= most]
        at += len(rows)
        value = np.zeros((len(rows), most))
        for r, i in enumerate(rows):
            value[r, : sizes[i]] = lists[i]
        own, w = sizes[rows], min(longest, most)
        cost = opening * (value.max(1) - value.sum(1) / own)
        best = np.full((len(rows), most + w), np.inf)  # w columns stand for no beginning
        best[:, w - 1] = 0
        back = np.zeros((len(rows), most), np.int32)
        top, new, long = np.zeros((len(rows), w)), np.zeros((len(rows), w)), np.arange(1.0, w + 1)
        each = np.arange(len(rows))
        for j in range(most):
            here = value[:, j]
            np.maximum(top[:, :-1], here[:, None], out=new[:, 1:])
            new[:, 0] = here
            total = best[:, j : j + w][:, ::-1] + long * new
            back[:, j] = choice = total.argmin(1)
            best[:, j + w] = total[each, choice] + cost
            top, new = new, top
        ends = own - 1
        starts: list[list[int]] = [[] for _ in rows]
        while (live := np.flatnonzero(ends >= 0)).size:
            ends[live] -= back[live, ends[live]]
            for r in live.tolist():
                starts[r].append(int(ends[r]))
            ends[live] -= 1
        for r, i in enumerate(rows):
            out[i] = np.array(starts[r][::-1], np.int64)
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))


class Shard:
    """A shard's posting lists of some terms as contributions in blocks."""

    def __init__(self, row: dict, weights: dict[str, int], docs: int, tokens: int):
        self.ids, self.nulls = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], bool)
        places, tfs = np.frombuffer(row["places"], "<u2").astype(np.int64), np.frombuffer(row["tfs"], "<u4").astype(np.int64)
        m = np.array([10 + 90 * n * docs // tokens for n in np.frombuffer(row["lengths"], "<i8").tolist()], np.int64)
        ends = np.cumsum(np.array(row["dfs"], np.int64))
        named = [(t, int(e) - n, int(e)) for t, n, e in zip(row["terms"], row["dfs"], ends.tolist()) if t in weights]
        part = lambda t, a, e: weights[t] * (1_000_000_000 * tfs[a:e] // (1000 * tfs[a:e] + 8 * m[places[a:e]]))
        lists = [part(*x) for x in named]
        sizes = np.array([len(x) for x in lists], np.int64)
        self.doc = np.concatenate([places[a:e] for _, a, e in named]) if named else np.zeros(0, np.int64)
        self.value = np.concatenate(lists) if named else np.zeros(0, np.int64)
        cuts, base = blocks(lists), np.concatenate([[0], np.cumsum(sizes)[:-1]]) if named else []
        self.start = np.concatenate([c + b for c, b in zip(cuts, base)]) if named else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.start, len(self.doc)))
        self.bound = np.maximum.reduceat(self.value, self.start) if named else np.zeros(0, np.int64)
        self.first, self.last = self.doc[self.start], self.doc[self.start + self.size - 1] if named else np.zeros(0, np.int64)
        ends = np.cumsum([len(c) for c in cuts]).tolist()
        self.of = {t: (e - len(c), e) for (t, _, _), c, e in zip(named, cuts, ends)}

    def best(self, terms: list[str], k: int, least: int) -> tuple[list[tuple], int]:
        """((-score, no id, id) of every document that may be among the ``k`` best, postings read); ``least`` is the k-th score so far."""
        mine = [self.of[t] for t in terms if t in self.of]
        if not mine:
            return [], 0
        at = np.concatenate([np.arange(a, e) for a, e in mine])
        first, last, bound = self.first[at], self.last[at], self.bound[at]
        points = np.concatenate([first, last + 1])
        order = np.argsort(points, kind="stable")
        here, sums = points[order], np.cumsum(np.concatenate([bound, -bound])[order])
        final = np.flatnonzero(np.diff(here, append=-1))
        edge, limit = here[final], sums[final]  # from edge to the next one, scores stay within limit
        left, right, limit = edge[:-1], edge[1:], limit[:-1]
        score, read, found = np.zeros(len(self.ids), np.int64), 0, np.zeros(0, np.int64)
        todo = np.argsort(-limit, kind="stable")
        share = 4 * k
        while (todo := todo[limit[todo] >= max(least, 1)]).size:
            many = 1 + int(np.searchsorted(np.cumsum((right - left)[todo]), share))
            now, todo, share = todo[:many], todo[many:], 4 * share
            change = np.zeros(len(self.ids) + 1, np.int64)
            np.add.at(change, left[now], 1)
            np.add.at(change, right[now], -1)
            wanted = np.cumsum(change)[:-1] > 0
            upto = np.concatenate([[0], np.cumsum(wanted)])
            hit = at[upto[last + 1] > upto[first]]
            span = _ranges(self.start[hit], self.size[hit])
            span = span[wanted[self.doc[span]]]
            read += len(span)
            np.add.at(score, self.doc[span], self.value[span])
            own = np.flatnonzero(wanted & (score >= max(least, 1)))
            found = np.concatenate([found, own])
            if len(found) > k:
                order = np.lexsort((self.ids[found], self.nulls[found], -score[found]))[:k]
                found = found[order]
            if len(found) == k:
                least = max(least, int(score[found].min()))
        return [(-int(score[d]), bool(self.nulls[d]), int(self.ids[d])) for d in found.tolist()], read


def search(shards: DataFrame, queries: list[tuple[int, list[str]]], weights: dict[str, int], docs: int, tokens: int, k: int = 10) -> DataFrame:
    """(query, doc_id, score): the ``k`` best documents of each task for each of some queries, given as (number, terms)."""
    sent = shards.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own = sent.value
        best: dict[int, list[tuple]] = {q: [] for q, _ in asked}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], own, docs, tokens)
                for q, terms in asked:
                    least = -best[q][-1][0] if len(best[q]) == k else 0
                    best[q] = sorted(best[q] + shard.best(terms, k, least)[0])[:k]
        out = [(q, None if none else d, -s) for q, found in best.items() for s, none, d in found]
        if out:
            q, d, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["query", "doc_id", "score"])

    return mapped(shards.select("terms", "dfs", "ids", "nulls", "lengths", "places", "tfs"), run, "query bigint, doc_id bigint, score bigint")


def _terms_of(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, terms) of each item id: the distinct terms of all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(i, t.decode("utf-8", "replace")) for i, raw in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))) for t in term_counts(raw)]
            if found:
                ids, terms = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string())], ["item_id", "term"])

    met = mapped(items.select(F.col(key).cast("bigint"), F.col(text)), run, "item_id bigint, term string")
    return met.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def rank(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of all documents with a score above 0 for each item.

    A term is a maximal run of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. Scores are the whole-number sums that
    ``Shard`` adds up: weight times a saturated count, damped by the document's length. Equal scores go by ascending id, null ids last; documents that repeat an id, or
    a whole row, are ranked each for itself. Null, empty and term-free texts are in no result and in no count. Rows of one
    item id are one item with the terms of all; an item without terms has no rows. Empty tables give an empty table; other columns play
    no part. Items are searched ``QUERIES`` at a time against every shard; beyond ``TERMS`` distinct query terms all
    posting lists are kept, with the same results. A task holds one shard and one block of queries.
    """
    spark = docs.sparkSession
    asked = stored(_terms_of(items, item, item_text), "items")
    distinct = asked.select(F.explode("terms").alias("term")).distinct()
    few = distinct.count() <= TERMS
    shards = index(docs, [r.term for r in distinct.collect()] if few else None, key, text)
    sums = shards.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).first()
    if not sums.docs:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    dfs = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).withColumnRenamed("terms", "term")
    dfs = stored(distinct.join(dfs, "term"), "frequencies")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    outs, number = [], 0
    for group in chunked(asked.toLocalIterator(), QUERIES):
        queries, names = [], []
        for row in group:
            queries.append((number, row.terms))
            names.append(Row(query=number, item_id=row.item_id))
            number += 1
        mine = spark.createDataFrame(names, "query bigint, item_id bigint")
        wanted = dfs if few else dfs.join(spark.createDataFrame([(t,) for t in sorted({t for _, terms in queries for t in terms})], "term string"), "term")
        weights = {r.term: math.floor(1000 * math.log((2 * sums.docs + 2) / (2 * r.df + 1))) for r in wanted.toLocalIterator()}
        met = search(shards, queries, weights, sums.docs, sums.tokens, k)
        ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = ranked.join(F.broadcast(mine), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        outs.append(out if few and number <= QUERIES else stored(out, "ranked"))
    whole = outs[0] if outs else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for out in outs[1:]:
        whole = whole.unionByName(out)
    return whole


def op13(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item; ties, nulls and repeated rows as ``rank`` states."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
one AS (SELECT r, doc_id, unnest(terms) AS term FROM docs), tf AS (SELECT r, doc_id, term, count(*) AS tf FROM one GROUP BY ALL), len AS (SELECT r, count(*) AS n FROM one GROUP BY r),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM len), df AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, nn),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN len USING (r), whole GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10"""
