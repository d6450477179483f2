"""Sum-of-squares packing of token ids into windows.

A document's ids are first cut into whole windows; what is left is placed online: of all
fill levels at which partially filled windows wait, and the empty window, the one is taken
that makes the sum of squares of the levels' counts least. The counts live in a level
array. Windows that no later document fits into would pile up, so when more than ``OPEN`` of them wait, the emptier ones
give their pieces, cut freely, to the fuller ones until half as many are left. When a task's rows end, the rest is closed in
that way; only the last window is short, and it is cut at powers of two, where windows take no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, public_tokenizer, slices, table
from .encoding import encoder

WINDOW = 2048
END = 1
#: Windows that may wait at once.
OPEN = 1024
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class LevelPacker:
    """Online sum-of-squares packing; pieces are (item, start, ids as bytes, total)."""

    def __init__(self, window: int = WINDOW):
        self.window, self.counts = window, np.zeros(window + 1, np.int64)
        self.waiting: list[list[list]] = [[] for _ in range(window + 1)]
        self.sequences = self.open = 0

    def level(self, size: int) -> int:
        """The fill level to put ``size`` ids on: least sum of squares, fuller first."""
        n, top = self.counts, self.window - size
        after = n[size:].copy()
        after[top] = 0
        gain = 2 * (after - n[: top + 1]) + 2
        gain[top] -= 1
        gain[0] = 2 * after[0] + 1 if top else 0
        gain[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(gain[::-1]))

    def _done(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for item, start, ids, total in pieces:
            yield item, start, ids, total, self.sequences, at
            at += len(ids) // 4
        self.sequences += 1

    def add(self, item: int | None, ids: bytes) -> Iterator[tuple]:
        """Place one document; yields the pieces of windows that became full."""
        total, at, w = len(ids) // 4, 0, self.window
        while total - at >= w:
            yield from self._done([(item, at, ids[4 * at : 4 * (at + w)], total)])
            at += w
        size = total - at
        if not size:
            return
        h = self.level(size)
        pieces = self.waiting[h].pop() if h else []
        self.counts[h] -= bool(h)
        self.open -= bool(h)
        pieces.append((item, at, ids[4 * at :], total))
        if h + size == w:
            yield from self._done(pieces)
        else:
            self._wait(h + size, pieces)
            if self.open > OPEN:
                yield from self._merged(OPEN // 2)

    def _wait(self, h: int, pieces: list) -> None:
        self.waiting[h].append(pieces)
        self.counts[h] += 1
        self.open += 1

    def _merged(self, keep: int) -> Iterator[tuple]:
        """Fill the fuller open windows from the emptier ones until ``keep`` are left."""
        left = [(h, p) for h in range(self.window, -1, -1) for p in self.waiting[h]]
        self.waiting = [[] for _ in range(self.window + 1)]
        self.counts[:] = self.open = 0
        lo, hi = 0, len(left) - 1
        while hi - lo >= keep:
            h, pieces = left[lo]
            given, source = left[hi]
            while h < self.window and source:
                item, start, ids, total = source.pop()
                n = min(len(ids) // 4, self.window - h)
                if n < len(ids) // 4:
                    source.append((item, start + n, ids[4 * n :], total))
                pieces.append((item, start, ids[: 4 * n], total))
                h += n
                given -= n
            left[hi] = (given, source)
            left[lo] = (h, pieces)
            if h == self.window:
                yield from self._done(pieces)
                lo += 1
            if not source:
                hi -= 1
        for h, pieces in left[lo : hi + 1]:
            self._wait(h, pieces)

    def close(self) -> Iterator[tuple]:
        """All that is left, whole windows first."""
        yield from self._merged(1)
        for last in [p for level in self.waiting for p in level]:
            yield from self._tail(last)

    def _tail(self, pieces: list) -> Iterator[tuple]:
        pieces = pieces[::-1]
        total = sum(len(p[2]) // 4 for p in pieces)
        for bit in range(total.bit_length() - 1, -1, -1):
            want, own = total & 1 << bit, []
            while want:
                item, start, ids, whole = pieces.pop()
                n = min(want, len(ids) // 4)
                own.append((item, start, ids[: 4 * n], whole))
                if n < len(ids) // 4:
                    pieces.append((item, start + n, ids[4 * n :], whole))
                want -= n
            if own:
                yield from self._done(own)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents, each with its window (``sequence_id``) and its place there.

    Every task packs the rows of its own partition; no row moves. A null or empty text
    has the end id alone, a very long one many windows. Null ids, repeated rows and other columns are harmless: each row is a
    document of its own. A task holds the ids of at most ``OPEN`` open windows and of one batch. ``ids`` adds the pieces' ids as binary. An empty table gives
    an empty table. Window numbers hold the partition number, so they never clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = LevelPacker(window), TaskContext.get().partitionId() << 32
        last, encode = np.array([end], "<u4").tobytes(), encoder(tokenizer, True).encode

        def rows(found: list[tuple]) -> pa.RecordBatch:
            item, start, raw, total, sequence, at = zip(*found)
            out = {
                "doc_id": pa.array(item, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array([len(x) // 4 for x in raw], pa.int64()),
                "ids_crc32": pa.array(map(crc32, raw), pa.int64()), "doc_tokens": pa.array(total, pa.int64()),
                "sequence_id": pa.array([base + x for x in sequence], pa.int64()), "offset": pa.array(at, pa.int64()),
            }
            if ids:
                out["ids"] = pa.array(raw, pa.binary())
            return pa.RecordBatch.from_pydict(out)

        for batch in slices(batches, 2048):
            found = []
            for item, raw in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()])):
                found += packer.add(item, raw + last)
            if found:
                yield rows(found)
        if found := list(packer.close()):
            yield rows(found)

    return mapped(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, SCHEMA + ", ids binary" * ids)


def op4(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in windows of 2048 ids; nulls, repeated rows and long texts as ``pack`` states."""
    return pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizer("byte_bpe_50k.json"))
