"""Shared helpers of the corpus operators: table access, stored tables, batches."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows, and bytes, of the batches that go to Python workers; long texts make them smaller.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches that stay small whatever the rows hold; the session keeps these two settings."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(run.__qualname__)
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(tidy, schema)


_held: dict = {}
_running: list[str] = []


def _enter(operator: str) -> None:
    """A worker that goes on to another operator lets go of what it held for the one before."""
    if _running != [operator]:
        _held.clear()
        _running[:] = [operator]


def held(name: object, make: Callable[[], object]) -> object:
    """The worker's object of this name, kept over the tasks of one operator."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_tokenizer(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a single-machine session
    (tests) gets a temporary folder, and a cluster is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quire-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a bounded number of rows, so that Python objects stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def rows_of(batches: Iterable[pa.RecordBatch], columns: int, key: int) -> Iterator[np.ndarray]:
    """Whole groups of sorted whole-number rows, as arrays; the first ``key`` columns make a group."""
    kept: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)])
        if kept and (kept[-1][-1, :key] != rows[0, :key]).any():
            yield np.concatenate(kept)
            kept = []
        cut = np.flatnonzero((np.diff(rows[:, :key], axis=0) != 0).any(axis=1)) + 1
        for at, to in zip([0, *cut.tolist()], [*cut.tolist(), None]):
            if at and kept:
                yield np.concatenate(kept)
                kept = []
            kept.append(rows[at:to])
    if kept:
        yield np.concatenate(kept)


def chunked(items: Iterable, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items."""
    it = iter(items)
    while part := list(itertools.islice(it, size)):
        yield part
