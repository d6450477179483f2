"""SimHash near-duplicates, searched through tables of distances to reference fingerprints.

A text's 64-bit fingerprint is the majority vote of the XXH64 values of its word
shingles. Every fingerprint has a *pivot table*: its Hamming distances to many
random reference fingerprints. By the triangle inequality two fingerprints within r bits
differ by at most r in every coordinate. The table serves twice:

* **candidates**: each reference cuts the fingerprints at its middle distance; those within r
  of the cut go to both sides. So two fingerprints within r bits share a side of every reference, and
  meet in the cell that these sides make. The number of references grows with the logarithm of the number of
  fingerprints, so cells stay as large as they are.
* **discarding**: in a cell, pairs go whose coordinates differ by more than r for any
  reference of the whole table; only survivors are verified bit by bit.

Equal fingerprints are merged before the search. A cell with many members is cut into pieces that are compared
two at a time, so no task holds an unbounded group. Only stars of what is connected
leave the task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, mapped, rows_of, slices, stored
from .components import components, joined

SEED = 42
BITS = 64
#: Fingerprints that a cell should hold on average, and the most that are compared in one piece.
CELL, PIECE = 1024, 4096
#: The reference fingerprints, in the order in which they are used.
PIVOTS = np.random.default_rng(SEED).integers(0, 2**64, 64, dtype=np.uint64)
_STEP = 1 << 15


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included; ASCII letters are lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    one = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([one(flat, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return np.array([one(flat[a:b], SEED) for a, b in zip((ends - lengths).tolist(), ends[width - 1 :].tolist())], np.uint64)


def vote(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number; none: zero."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _STEP):
        piece = np.ascontiguousarray(hashes[at : at + _STEP])
        bits = np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)``, a row for each row of ``docs``; null and blank texts get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [vote(shingle_hashes(raw, width)) for raw in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return mapped(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, "doc_id bigint, fp bigint")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances [fingerprints, references]."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def sides(max_bits: int) -> tuple[int, int]:
    """The greatest distance of the near side of a reference and the least one of its far side."""
    return BITS // 2 - 1 + (max_bits + 1) // 2, BITS // 2 - max_bits // 2


def depth(n: int, max_bits: int) -> int:
    """The number of references after which cells of n evenly spread fingerprints hold ``CELL`` on average."""
    low, high = sides(max_bits)
    near, far = (sum(comb(BITS, d) for d in span) / 2**BITS for span in (range(low + 1), range(high, BITS + 1)))
    shrink = (near * near + far * far) / (near + far)
    return min(len(PIVOTS) - 2, max(0, ceil(log(max(1, n / CELL)) / -log(shrink))))


def cells(fps: np.ndarray, references: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every cell that each fingerprint lies in, by the sides of the first references."""
    low, high = sides(max_bits)
    rows, cell = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    for pivot in PIVOTS[:references]:
        d = np.bitwise_count(fps ^ pivot)[rows]
        near, far = d <= low, d >= high
        rows, cell = np.concatenate([rows[near], rows[far]]), np.concatenate([cell[near] << 1, cell[far] << 1 | 1])
    return rows, cell


def dealt(classes: DataFrame, max_bits: int) -> DataFrame:
    """``(cell, fp)``: distinct fingerprints in all their cells."""
    references = depth(classes.count(), max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            rows, cell = cells(fps.view(np.uint64), references, max_bits)
            for part in slices([pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fps[rows])], ["cell", "fp"])], 1 << 16):
                yield part

    return mapped(classes.select("fp"), run, "cell bigint, fp bigint")


def stars(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the groups that these fingerprints make within ``max_bits``; groups of one are left out."""
    table = pivot_table(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    first, n = table[:, 0], len(fps)
    root = np.arange(n)
    for at in range(0, n, 256):
        own = table[at : at + 256]
        met = table[at : int(np.searchsorted(first, int(own[-1, 0]) + max_bits, "right"))]
        near = np.abs(own[:, None, 1] - met[None, :, 1]) <= max_bits
        for k in range(2, 6):
            near &= np.abs(own[:, None, k] - met[None, :, k]) <= max_bits
        left, right = np.nonzero(near)
        keep = right > left
        left, right = left[keep], right[keep]
        for k in range(6, len(PIVOTS), 16):
            keep = (np.abs(own[left, k : k + 16] - met[right, k : k + 16]) <= max_bits).all(axis=1)
            left, right = left[keep], right[keep]
        keep = np.bitwise_count(fps[left + at] ^ fps[right + at]) <= max_bits
        root = joined(root, left[keep] + at, right[keep] + at)
    low = np.flatnonzero(root != np.arange(n))
    return fps[low], fps[root[low]]


def _compared(max_bits: int):
    """Comparison of cells over partitions that are sorted by (cell, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 3, 2):
            fps = np.unique(rows[:, 2]).view(np.uint64)
            if len(fps) > 1:
                a, b = stars(fps, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def in_pieces(some: DataFrame, item: str, most: int) -> DataFrame:
    """``some`` once for each comparison that its rows take part in, numbered by ``piece``.

    Keys whose count ``n`` is beyond ``most`` are cut by a hash of ``item`` into parts of half that size, two of which meet in each comparison.
    """
    parts, own = F.col("parts"), F.col("own")
    cut = some.withColumn("parts", F.when(F.col("n") > most, F.ceil(2 * F.col("n") / most)).otherwise(1).cast("bigint"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64(item, F.lit(7)), parts))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), parts - 1), lambda i: i != own)
    numbers = F.when(parts == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(others, lambda i: F.least(i, own) * parts + F.greatest(i, own)))
    return cut.withColumn("piece", F.explode(numbers)).drop("parts", "own")


def links(keyed: DataFrame, max_bits: int) -> DataFrame:
    """Links ``(a, b)`` that connect the fingerprints within ``max_bits`` of each other among those that share a cell.

    ``keyed`` has distinct rows ``(cell, fp)``. What is connected stays connected; links are those of stars, whose ends
    may lie further apart. Only cells with more than ``PIECE`` members are met with their count.
    """
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = keyed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > PIECE)
    pieces = in_pieces(keyed.join(large, "cell", "left"), "fp", PIECE).select("cell", "piece", "fp")
    return mapped(pieces.repartition(tasks, "cell", "piece").sortWithinPartitions("cell", "piece"), _compared(max_bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``, a row for each row of ``docs``.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is the least
    doc_id reachable. Every link is found. Null and blank texts have
    fingerprint zero and link like any other. Repeated rows, ties and null ids are kept:
    a null id is never a component_id unless its component has nothing else. Columns of
    ``docs`` besides the two named play no part. An empty table gives an empty table.
    """
    prints = stored(fingerprints(docs, width, key, text), "fp")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(dealt(classes, max_bits), max_bits)).withColumnRenamed("node", "fp")
    led = classes.join(roots, "fp")
    leaders = led.groupBy("root").agg(F.min("first").alias("leader"))
    named = led.join(leaders, "root").select("fp", "leader")
    whole = classes.join(named, "fp", "left").select("fp", F.coalesce("leader", "first").alias("component_id"))
    return prints.select("doc_id", "fp").join(whole, "fp").select("doc_id", "fp", "component_id")


def op1(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles over all documents, linked at two bits."""
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The documents less all but the first of each near-duplicate group; its links are verified shingle sets."""
    from .shingle_sets import one_of_each

    return one_of_each(docs, width)
