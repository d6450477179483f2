"""Near-duplicates by the Jaccard similarity of their shingle sets; SimHash pivot tables discard, an exact check decides.

* **fingerprints**: each set has the 64-bit SimHash of its shingles. Similarity 0.8 leaves about 10 differing bits; the fewer shingles, the wider
  the spread, so pairs with a set below ``FEW`` shingles have no bit limit, the others ``MAX_BITS``.
* **cells** of pivot sides bring together the fingerprints within ``CELL_BITS``, as in ``simhash``: the sets of one fingerprint meet the least of them, and
  these meet along the cells' links. Cells cannot bound a search at ``MAX_BITS`` (nearly every fingerprint would lie on both sides of every reference), so
  for the pairs farther apart
* **keys** bound the search: ``ROWS`` least values of the set, each under a hash function of its own, make a key; sets
  of similarity s share one of ``KEYS`` keys with probability 1 - (1 - s^5)^30, 0.99999 at 0.8, at any length.
* **stars**: the members of a key meet its least member. Pairs whose distances to a reference fingerprint
  differ by over ``MAX_BITS`` are discarded, then those whose fingerprints do; the texts of survivors are compared exactly.
* **the rest**: keys whose members are still apart are compared within; a key with over ``PIECE`` members is cut into parts
  that are compared two at a time. Pivot tables discard again, the exact check decides, and only a spanning forest leaves the task.

Equal sets are merged before the search. Only verified links join components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, mapped, slices, stored
from .components import components
from .simhash import PIVOTS, SEED, dealt, in_pieces, links, pivot_table, shingle_hashes, vote

ROWS, KEYS = 5, 30
#: Differing bits beyond which a pair is discarded, if both sets have ``FEW`` shingles or more.
MAX_BITS, FEW = 24, 64
#: Differing bits within which the cells of the pivot tables find every pair of fingerprints.
CELL_BITS = 2
#: Members of one key that are compared at once.
PIECE = 1024
#: Least Jaccard similarity of a link, as a ratio.
LEAST = (4, 5)
_SALTS = np.random.default_rng(SEED).integers(1, 2**64, (2, ROWS * KEYS, 1), dtype=np.uint64) | np.array([[[0]], [[1]]], np.uint64)
_COLUMNS = 2048


def band_keys(found: np.ndarray) -> list[int]:
    """The keys of a set of distinct shingle hashes; the empty set has none."""
    if not len(found):
        return []
    least = np.full(ROWS * KEYS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), _COLUMNS):
        np.minimum(least, ((found[None, at : at + _COLUMNS] ^ _SALTS[0]) * _SALTS[1]).min(axis=1), out=least)
    bands = least.reshape(KEYS, ROWS)
    return [xxhash.xxh3_64_intdigest(band.tobytes(), k) - 2**63 for k, band in enumerate(bands)]


def named(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells rows apart: whether the id is missing, the id, the XXH64 of the text."""
    own = F.col(f"`{key}`")
    return [own.isNull().alias("__none"), F.coalesce(own.cast("bigint"), F.lit(0)).alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__tie")]


NAME = ["__none", "__id", "__tie"]
_NAMED = "__none boolean, __id bigint, __tie bigint"


def sketches(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(__none, __id, __tie, set, m, fp, keys)``, a row for each row of ``docs``.

    ``set`` is a digest of the shingle set, ``m`` its size, ``fp`` its SimHash. Null and blank texts have the empty set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, sizes, fps, keys = [], [], [], []
            for raw in byte_texts(batch.column(3)):
                found = np.unique(shingle_hashes(raw, width))
                names.append(xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63)
                sizes.append(len(found))
                fps.append(vote(found))
                keys.append(band_keys(found))
            own = [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + own, [*NAME, "set", "m", "fp", "keys"])

    return mapped(docs.select(*named(docs, key, text), F.col(f"`{text}`").alias("text")), run, f"{_NAMED}, set bigint, m bigint, fp bigint, keys array<bigint>")


def _similar(shared, m, n):
    """Whether sets of m and n shingles that share so many link."""
    p, q = LEAST
    return q * shared >= p * (m + n - shared)


def _set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", width))


def _pairs(width: int):
    """Of pairs (a, b) with their texts, those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.empty(0, np.uint64)
        for batch in slices(batches):
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), byte_texts(batch.column(2)), byte_texts(batch.column(3))):
                if a != last:
                    last, mine = a, _set(x, width)
                other = _set(y, width)
                keep.append(_similar(len(np.intersect1d(mine, other, True)), len(mine), len(other)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def forest(sets: list[np.ndarray], fps: np.ndarray, groups: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected among sets of distinct shingles; ``groups`` are connected already."""
    table, n, out = pivot_table(fps), len(sets), []
    sizes = np.fromiter(map(len, sets), np.int64, n)
    _, root = np.unique(groups, return_inverse=True)
    p, q = LEAST
    for i in range(n - 1):
        near = (root[i + 1 :] != root[i]) & (q * np.minimum(sizes[i + 1 :], sizes[i]) >= p * np.maximum(sizes[i + 1 :], sizes[i]))
        others = np.flatnonzero(near) + i + 1
        few = np.minimum(sizes[others], sizes[i]) < FEW
        others = others[few | ((np.abs(table[others] - table[i]) <= MAX_BITS).all(axis=1) & (np.bitwise_count(fps[others] ^ fps[i]) <= MAX_BITS))]
        for j in others.tolist():
            if root[i] != root[j] and _similar(len(np.intersect1d(sets[i], sets[j], True)), sizes[i], sizes[j]):
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def _groups(width: int):
    """Forests of the groups (key, piece); rows (key, piece, set, fp, root, text) come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, fps, roots, sets = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(names) > 1:
                linked = forest(sets, np.array(fps, np.int64).view(np.uint64), np.array(roots, np.int64))
                if linked:
                    yield pa.RecordBatch.from_arrays([pa.array([names[x[i]] for x in linked], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in slices(batches):
            for key, piece, name, fp, root, text in zip(*(batch.column(i).to_pylist() for i in range(5)), byte_texts(batch.column(5))):
                if (key, piece) != group:
                    yield from done()
                    group, names, fps, roots, sets = (key, piece), [], [], [], []
                names.append(name)
                fps.append(fp)
                roots.append(root)
                sets.append(_set(text, width))
        yield from done()

    return run


def _within(a: str, b: str, m: Column) -> Column:
    """Whether the pivot tables, and then the fingerprints, of two columns allow a link; ``m`` is the smaller set's size."""
    near = F.lit(True)
    for pivot in PIVOTS[:8].view(np.int64).tolist():
        near &= F.abs(F.bit_count(F.col(a).bitwiseXOR(F.lit(pivot))) - F.bit_count(F.col(b).bitwiseXOR(F.lit(pivot)))) <= MAX_BITS
    return (m < FEW) | (near & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS))


def in_cells(classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets along whose links all sets within ``CELL_BITS`` of each other are connected, by the cells of the pivot tables."""
    prints = stored(classes.groupBy("fp").agg(F.min("set").alias("hub")), "prints")
    same = classes.join(prints, "fp").filter("set <> hub").select(F.col("hub").alias("a"), F.col("set").alias("b"))
    of = lambda x: prints.select(F.col("fp").alias(x), F.col("hub").alias(f"hub_{x}"))
    met = links(dealt(prints, CELL_BITS), CELL_BITS).join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(met.select(F.col("hub_a").alias("a"), F.col("hub_b").alias("b")))


def components_of(docs: DataFrame, prints: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(node, root)`` of the sets of ``prints`` that verified links connect."""
    p, q = LEAST
    classes = stored(prints.dropDuplicates(["set"]), "classes")
    keyed = classes.select(F.explode("keys").alias("key"), "set")
    hubs = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("set").alias("hub")).filter("n > 1")
    some = stored(keyed.join(hubs, "key"), "keys")
    of = lambda x: classes.select(F.col("set").alias(x), F.col("m").alias(f"m_{x}"), F.col("fp").alias(f"fp_{x}"))
    met = some.filter("set <> hub").select(F.col("hub").alias("a"), F.col("set").alias("b")).unionByName(in_cells(classes))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(of("a"), "a").join(of("b"), "b")
    near = stored(pairs.filter((q * F.least("m_a", "m_b") >= p * F.greatest("m_a", "m_b")) & _within("fp_a", "fp_b", F.least("m_a", "m_b"))).select("a", "b"), "pairs")
    # the texts of all sets that may be compared, one row each
    wanted = near.select(F.explode(F.array("a", "b")).alias("set")).unionByName(some.filter("n > 2").select("set")).distinct()
    rows = classes.join(wanted, "set", "left_semi").select("set", *NAME)
    own = docs.select(*named(docs, key, text), F.col(f"`{text}`").alias("text"))
    texts = stored(own.join(rows, NAME).dropDuplicates(NAME).select("set", "text"), "texts")
    side = lambda x: texts.select(F.col("set").alias(x), F.col("text").alias(f"text_{x}"))
    met = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    stars = stored(mapped(met, _pairs(width), "a bigint, b bigint"), "stars")
    roots = components(stars)
    led = some.filter("n > 2").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    state = led.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("members"), F.min("root").alias("low"), F.max("root").alias("high"))
    open_keys = state.filter("low <> high").groupBy("n", "members").agg(F.min("key").alias("key")).select("key")
    rest = led.join(open_keys, "key", "left_semi").join(classes.select("set", "fp"), "set")
    cut = stored(in_pieces(rest, "set", PIECE).select("key", "piece", "set", "fp", "root"), "rest")
    if cut.isEmpty():
        return roots
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = cut.join(texts, "set").select("key", "piece", "set", "fp", "root", "text").repartition(tasks, "key", "piece").sortWithinPartitions("key", "piece")
    return components(stars.unionByName(mapped(full, _groups(width), "a bigint, b bigint")))


def one_of_each(docs: DataFrame, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents less all but the first of each near-duplicate group.

    Texts link if the Jaccard similarity of their sets of ``width``-word shingles is 0.8 or more; groups
    are closed transitively. The first has the least doc_id (null comes last), then the least XXH64 of the text; rows
    are told apart by both, so different texts of one id, or of none, stay unless they are near copies. Of repeated rows one stays.
    Blank and null texts are copies of each other. Other columns play no part; an empty table gives an empty table.
    """
    prints = stored(sketches(docs, width, key, text), "sketches")
    roots = components_of(docs, prints, width, key, text).withColumnRenamed("node", "set")
    owned = prints.select("set", F.struct(*NAME).alias("row")).join(roots, "set", "left")
    chosen = owned.groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("row").alias("row")).select("row.*")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *named(docs, key, text))
    return own.join(chosen, NAME, "left_semi").dropDuplicates(NAME).select(*[F.col(f"row.`{c}`") for c in docs.columns])
