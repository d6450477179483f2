"""Token ids in directly addressable codes, a file format with random access.

A file holds the ids of consecutive documents. Ids are split into levels of eight bits:
level k has the k-th byte of every id that reaches so far. A bitmap at each level
says which of its ids go on, and a directory of ranks, one for each 512 bits, tells where an
id's next byte is. Any id is found by a lookup and a short popcount at each level;
nothing is decoded around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, public_tokenizer, slices, stored, table
from .encoding import encoder
from .packing import END

MAGIC = b"QDAC0001"
RANK_BITS = 512
#: Ids after which a file is closed.
FILE_IDS = 1 << 20


def write_file(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The bytes of one file: header, document directory, levels."""
    all_ids = np.frombuffer(b"".join(ids), "<u4")
    sizes = np.array([len(x) // 4 for x in ids], "<i8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    levels, rest = [], all_ids
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        per = RANK_BITS // 8
        counts = np.bitwise_count(np.pad(bits, (0, -len(bits) % per))).reshape(-1, per).sum(1, dtype=np.int64)
        ranks = np.r_[0, np.cumsum(counts)[:-1]].astype("<u4")
        levels.append((len(rest), (rest & 255).astype(np.uint8), bits, ranks))
        rest = rest[more] >> 8
    head = np.array([len(ids), len(all_ids), len(levels), *[x[0] for x in levels]], "<i8").tobytes()
    named = np.array([x or 0 for x in doc_ids], "<i8")
    body = [named.tobytes(), known.tobytes(), sizes.tobytes()]
    for _, low, bits, ranks in levels:
        body += [low.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join([MAGIC, head, *body])


class IdFile:
    """Reads one file; ``ids[i]`` is random access."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        self.raw, self.at = raw, 8
        n, self.total, depth = self._take("<i8", 3)
        counts = self._take("<i8", depth)
        self.doc_ids, self.known, self.sizes = self._take("<i8", n), self._take("u1", n), self._take("<i8", n)
        self.levels = []
        for m in counts:
            bits = -(-int(m) // 8)
            self.levels.append((self._take("u1", m), self._take("u1", bits), self._take("<u4", -(-bits // (RANK_BITS // 8)))))

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, int(n), self.at)
        self.at += out.nbytes
        return out

    def __len__(self) -> int:
        return int(self.total)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.total:
            raise IndexError(i)
        value = 0
        for k, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            before = bits[block * (RANK_BITS // 8) : i >> 3]
            inside = int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[block]) + inside
        return value

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places, each found through the bitmaps and rank directories of its levels."""
        at, out, live = np.asarray(places, np.int64), np.zeros(len(places), np.int64), np.arange(len(places))
        wide = RANK_BITS // 8
        for k, (low, bits, ranks) in enumerate(self.levels):
            out[live] |= low[at].astype(np.int64) << 8 * k
            more = (bits[at >> 3] >> (at & 7) & 1).astype(bool)
            live, at = live[more], at[more]
            if not len(at):
                break
            block = at // RANK_BITS
            cell = block[:, None] * wide + np.arange(wide)
            before = np.where(cell < (at >> 3)[:, None], bits[np.minimum(cell, len(bits) - 1)], 0)
            inside = bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)
            at = ranks[block].astype(np.int64) + np.bitwise_count(before).sum(1, dtype=np.int64) + np.bitwise_count(inside)
        return out

    def all(self) -> np.ndarray:
        """Every id of the file."""
        rest = None
        for low, bits, _ in reversed(self.levels):
            out = low.astype("<u4")
            more = np.unpackbits(bits, count=len(low), bitorder="little").view(bool)
            if rest is not None:
                out[more] |= rest << 8
            rest = out
        return rest if rest is not None else np.empty(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) in file order."""
        ids, at = self.all(), 0
        for doc, known, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.sizes.tolist()):
            yield (doc if known else None), at, ids[at : at + n]
            at += n


def write_ids(docs: DataFrame, tokenizer: str, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Files of the ids of all documents in ascending doc_id order: ``(part, file, n_ids, content)``.

    Rows are dealt to ranges of doc_id and sorted there, so parts and files follow each
    other in order. Null ids come first; equal ids are ordered by a hash of the text, repeated rows are documents of their own. A null text has the end
    id alone. A file is closed after ``FILE_IDS`` ids and holds whole documents, so a task holds one file, or one very long document. Other columns
    play no part; an empty table makes no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        encode, last = encoder(tokenizer, False).encode, np.array([end], "<u4").tobytes()
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "file": pa.array([number], pa.int32()),
                "n_ids": pa.array([size], pa.int64()), "content": pa.array([write_file(names, held)], pa.binary()),
            })

        for batch in slices(batches, 2048):
            for name, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()])):
                names.append(name)
                held.append(ids + last)
                size += len(ids) // 4 + 1
                if size >= FILE_IDS:
                    yield file()
                    names, held, size, number = [], [], 0, number + 1
        if names:
            yield file()

    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    sorted_docs = own.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return mapped(sorted_docs, run, "part int, file int, n_ids bigint, content binary")


def read_ids(files: DataFrame, ends: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files.

    ``ends`` adds each document's ``first_id``, ``middle_id`` and ``last_id``, looked up by their places alone (-1 in a document without ids). ``start`` counts the ids of all documents before it. Only the totals of parts, one row
    for each partition that wrote, meet in one task; file totals are summed within their part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                part, number = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                file = IdFile(batch.column(2)[n].as_py())
                rows = [(d, at, len(x), crc32(x.tobytes())) for d, at, x in file.documents()]
                doc, at, size, crc = zip(*rows)
                start, many = np.array(at, np.int64), np.array(size, np.int64)
                places = np.concatenate([start + k for k in (0, many // 2, many - 1)])
                first, middle, last = np.where(many > 0, file.take(np.where(many[None] > 0, places.reshape(3, -1), 0).ravel()).reshape(3, -1), -1) if ends else [[None] * len(rows)] * 3
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(rows), pa.int32()), "file": pa.array([number] * len(rows), pa.int32()), "doc_id": pa.array(doc, pa.int64()),
                    "at": pa.array(at, pa.int64()), "n_tokens": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                    "first_id": pa.array(first, pa.int64()), "middle_id": pa.array(middle, pa.int64()), "last_id": pa.array(last, pa.int64()),
                })

    sizes = files.select("part", "file", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select("part", "file", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("file_start"))
    docs = mapped(files.select("part", "file", "content"), run, "part int, file int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, first_id bigint, middle_id bigint, last_id bigint")
    return docs.join(starts, ["part", "file"]).select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["first_id", "middle_id", "last_id"][: 3 * ends])


def op9(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Ids of all documents, written as files in the shared folder and read back; nulls, repeated rows and long texts as ``write_ids`` states."""
    return read_ids(stored(write_ids(table(spark, sf_dir, "documents"), tokenizer or public_tokenizer("word_bpe_49k.json")), "ids"), ends=True)
