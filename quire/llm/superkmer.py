"""Repeated word windows, counted exactly by super-k-mers.

A window is ``width`` consecutive words. Its minimiser is the least hash of its runs of
``GRAM`` words; consecutive windows with the same minimiser form one super-k-mer, which
travels as one packed string to the bucket of its minimiser. Equal windows have equal
minimisers, so each bucket holds every occurrence of its windows; there, the
windows of the strings that share a minimiser are sorted and counted.

Strings met more than once in a batch of documents are known to repeat: one copy
travels, and what it covers is told at once. So a hot passage sends one string for each batch,
not one for each document. Buckets come sorted and are counted one at a time. The windows of a hot minimiser, and those of a bucket that
outgrows ``BUCKET_BYTES``, go on one by one to tasks chosen by the whole window, where equal windows still meet.
Strings and windows are compared as bytes, so counts are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, chunked, mapped, slices, stored, table

WIDTH = 35
GRAM = 4
#: Words of a document that are cut into super-k-mers at once.
_RUN = 1 << 18
_BATCH = 2048
#: Text bytes for each bucket, unpacked bytes of a bucket and windows of a minimiser beyond which windows go on one by one.
TEXT_BYTES, BUCKET_BYTES, HOT = 4 << 20, 64 << 20, 50_000


def _minima(x: np.ndarray, span: int) -> np.ndarray:
    """Least value of every ``span`` consecutive values."""
    step, out = 1, x
    while 2 * step <= span:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(x) - span + 1], out[span - step :][: len(x) - span + 1])


def super_kmers(words: list[bytes], width: int = WIDTH) -> Iterator[tuple[int, int, int, bytes]]:
    """(minimiser, first window, windows, packed words) of one document's runs of windows."""
    for base in range(0, max(1, len(words) - width + 1), _RUN):
        own = words[base : base + _RUN + width - 1]
        if len(own) < width:
            return
        gram = min(GRAM, width)
        h = np.fromiter(map(crc32, own), np.uint64, len(own))
        with np.errstate(over="ignore"):
            mixed = h[: len(h) - gram + 1].copy()
            for k in range(1, gram):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - gram + 1 + k]
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(28)
        least = _minima((mixed >> np.uint64(20) << np.uint64(20)) | np.arange(len(mixed), dtype=np.uint64), width - gram + 1)
        cut = np.flatnonzero(np.diff(least)) + 1
        starts, ends = [0, *cut.tolist()], [*cut.tolist(), len(least)]
        marks = (least[starts] >> np.uint64(20)).tolist()
        flat = b" ".join(own)
        to = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        at = (to - np.fromiter(map(len, own), np.int64, len(own))).tolist()
        to = to.tolist()
        for mark, s, e in zip(marks, starts, ends):
            yield mark, base + s, e - s, flat[at[s] : to[e + width - 2]]


def _pack(rows: list[tuple], strings: list[bytes]) -> bytes:
    """Occurrences (minimiser, doc, tie, first, windows, string or -1 if known to repeat) with their strings."""
    table_ = np.array(rows, np.int64).reshape(-1, 6)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    head = np.array([len(rows), len(strings)], np.int64).tobytes()
    return zstandard.compress(b"".join([head, table_.T.tobytes(), sizes.tobytes(), *strings]), 3)


def _unpack(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.decompress(raw)
    n, m = np.frombuffer(raw, np.int64, 2)
    rows = np.frombuffer(raw, np.int64, 6 * n, 16).reshape(6, n).T
    sizes = np.frombuffer(raw, np.int64, m, 16 + 48 * n)
    ends = (16 + 48 * n + 8 * m + np.cumsum(sizes)).tolist()
    return rows, [raw[e - s : e] for e, s in zip(ends, sizes.tolist())]


def _buckets(pieces: Iterable[tuple[int, bytes]], most: int) -> Iterator[tuple[bool, list[bytes]]]:
    """(whether they are the whole bucket, packs) of sorted (bucket, pack); those of a bucket beyond ``most`` bytes, unpacked, come in parts."""
    now, packs, size = None, [], 0
    for bucket, raw in pieces:
        if bucket != now:
            if packs:
                yield True, packs
            now, packs, size = bucket, [], 0
        size += zstandard.frame_content_size(raw)
        packs.append(raw)
        if size > most:
            yield False, packs
            packs = []
    if packs:
        yield True, packs


def _windows(packed: bytes, n: int, width: int) -> list[bytes]:
    words = packed.split(b" ")
    if n == 1:
        return [packed]
    out, at, to = [], 0, sum(map(len, words[:width])) + width - 1
    for i in range(n):
        out.append(packed[at:to])
        at += len(words[i]) + 1
        if i + 1 < n:
            to += len(words[i + width]) + 1
    return out


def _strings(rows: np.ndarray, strings: list[bytes]) -> dict[bytes, list]:
    """The occurrences (doc, tie, first, windows) of each string."""
    by: dict[bytes, list] = defaultdict(list)
    for _, doc, tie, first, n, at in rows.tolist():
        by[strings[at]].append((doc, tie, first, n))
    return by


def _one_by_one(rows: np.ndarray, strings: list[bytes], width: int) -> Iterator[tuple[int | None, int, int, int, bytes]]:
    """(doc, tie, first word, whether known to repeat, window) of every window; of a string known to repeat, one copy has no doc."""
    for packed, found in _strings(rows, strings).items():
        many = int(len(found) > 1 or found[0][3] < 0)
        for offset, window in enumerate(_windows(packed, abs(found[0][3]), width)):
            for doc, tie, first, n in found:
                yield doc if n > 0 else None, tie, first + offset, many, window


def _repeats(rows: np.ndarray, strings: list[bytes], width: int) -> Iterator[tuple[int, int, int, int]]:
    """(doc, tie, first word, end) covered by windows of one minimiser that occur more than once."""
    by = _strings(rows, strings)
    entries = []
    for k, (packed, found) in enumerate(by.items()):
        many = len(found) > 1 or any(x[3] < 0 for x in found)
        for offset, window in enumerate(_windows(packed, abs(found[0][3]), width)):
            entries.append((window, k, offset, many))
    entries.sort(key=lambda x: x[0])
    found, i = list(by.values()), 0
    covered: dict[int, list[int]] = defaultdict(list)
    while i < len(entries):
        j, many = i + 1, entries[i][3]
        while j < len(entries) and entries[j][0] == entries[i][0]:
            j, many = j + 1, True
        if many:
            for _, k, offset, _ in entries[i:j]:
                covered[k].append(offset)
        i = j
    for k, offsets in covered.items():
        offsets.sort()
        runs = [[offsets[0], offsets[0] + 1]]
        for x in offsets[1:]:
            if x == runs[-1][1]:
                runs[-1][1] += 1
            else:
                runs.append([x, x + 1])
        for doc, tie, first, n in found[k]:
            if n > 0:
                for a, b in runs:
                    yield doc, tie, first + a, first + b + width - 1


def repeated_spans(docs: DataFrame, width: int = WIDTH, buckets: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, tie, spans)``: word spans [first, end) of each document covered by windows that occur more than once.

    ``tie`` is the XXH64 of the text, so rows that share a doc_id stay apart; a null id reads
    as the least number. Spans may touch or overlap; documents without any have no row. Rows that share id and text repeat
    each other and share their spans. A task holds one bucket, or one batch of texts with its strings.
    """
    if not buckets:
        size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
        buckets = max(1, -(-size // TEXT_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _BATCH):
            at: dict[bytes, list] = defaultdict(list)
            for doc, tie, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2))):
                for mark, first, n, packed in super_kmers(raw.split(), width):
                    at[packed].append((mark, doc, tie, first, n))
            dealt: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
            for packed, found in at.items():
                mark, doc, tie, first, n = found[0]
                rows, strings = dealt[mark % buckets]
                if len(found) == 1:
                    rows.append((mark, doc, tie, first, n, len(strings)))
                else:
                    rows.append((mark, 0, 0, 0, -n, len(strings)))
                    for _, doc, tie, first, n in found:
                        dealt[(doc + first) % buckets][0].append((0, doc, tie, first, n, -1))
                strings.append(packed)
            if dealt:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(dealt, pa.int32()), "packed": pa.array([_pack(*x) for x in dealt.values()], pa.binary())})

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        doc, tie, first, b, window = zip(*rows)
        numbers = [pa.array(x, pa.int64()) for x in (doc, tie, first, b)]
        return pa.RecordBatch.from_arrays([*numbers, pa.array(window, pa.binary())], ["doc_id", "tie", "a", "b", "window"])

    def told(rows: np.ndarray) -> list[tuple]:
        return [(d, t, f, f + n + width - 1, None) for _, d, t, f, n, at in rows[rows[:, 5] < 0].tolist()]

    def counted(packed: list[bytes]) -> Iterator[tuple]:
        tables, strings = [], []
        for raw in packed:
            rows, own = _unpack(raw)
            yield from told(rows)
            rows = rows[rows[:, 5] >= 0]
            rows[:, 5] += len(strings)
            tables.append(rows)
            strings += own
        rows = np.concatenate(tables)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        edge = np.flatnonzero(np.diff(rows[:, 0])) + 1
        for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(rows)]):
            if e - s > 1:
                if np.abs(rows[s:e, 4]).sum() > HOT:
                    yield from _one_by_one(rows[s:e], strings, width)
                else:
                    yield from ((*x, None) for x in _repeats(rows[s:e], strings, width))

    def passed_on(raw: bytes) -> Iterator[tuple]:
        rows, strings = _unpack(raw)
        yield from told(rows)
        yield from _one_by_one(rows[rows[:, 5] >= 0], strings, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            pieces = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for whole, packs in _buckets(pieces, BUCKET_BYTES):
                if whole:
                    yield from counted(packs)
                else:
                    for own in packs:
                        yield from passed_on(own)

        for rows in chunked(found(), 1 << 15):
            yield batch_of(rows)

    own = docs.select(_id(F.col(key)).alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))
    packed = mapped(own, cut, "bucket int, packed binary").repartition(F.col("bucket")).sortWithinPartitions("bucket")
    found = stored(mapped(packed, count, "doc_id bigint, tie bigint, a bigint, b bigint, window binary"), "spans")
    spans = found.filter("window IS NULL").select("doc_id", "tie", "a", "b")
    single = found.filter("window IS NOT NULL")
    if not single.isEmpty():
        many = single.groupBy("window").agg(F.count("*").alias("n"), F.max("b").alias("known")).filter("n > 1 OR known = 1").select("window")
        met = single.filter("doc_id IS NOT NULL").join(many, "window", "left_semi")
        spans = spans.unionByName(met.select("doc_id", "tie", "a", (F.col("a") + width).alias("b")))
    return spans.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _id(column):
    return F.coalesce(column.cast("bigint"), F.lit(-(2**63)))


def remove_repeats(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, kept, n_words, n_removed)``: each row of ``docs`` as a struct, and its text without the covered words.

    ``kept`` has the remaining words joined by one space. A null text has no words. Repeated
    rows repeat each other's windows; a document with fewer words than a window keeps all.
    """
    spans = repeated_spans(docs, width, None, key, text)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _id(F.col(key)).alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"))
    met = own.join(spans, ["doc_id", "tie"], "left").select("row", F.col(f"row.{text}").alias("text"), "spans")
    schema = f"row {own.schema['row'].dataType.simpleString()}, kept string, n_words bigint, n_removed bigint"

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, total, gone = [], [], []
            for raw, spans in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist()):
                words = raw.split()
                total.append(len(words))
                if spans:
                    out, at = [], 0
                    for a, b in sorted((x["a"], x["b"]) for x in spans):
                        if a > at:
                            out += words[at:a]
                        at = max(at, b)
                    words = out + words[at:]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["row", "kept", "n_words", "n_removed"])

    return mapped(met, strip, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated windows; nulls, repeated rows and long texts as ``remove_repeats`` states."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with their repeated passages taken out; untouched texts stay as they are."""
    out = remove_repeats(docs, width)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d),
v AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS v FROM s),
r AS (SELECT doc_id, s FROM v WHERE v IN (SELECT v FROM v GROUP BY v HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM r),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM p ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""
