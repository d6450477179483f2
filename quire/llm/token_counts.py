"""Token counts of whole texts through a cache of digests.

A text is known by a digest of its normalised content together with a digest of the
tokenizer's version (library, its release, the bytes of the vocabulary file). Counts are stored by that
digest in a Parquet table in the shared folder. A run joins the distinct digests of its texts to
the table, encodes one text of each digest that is missing, appends those counts, and joins the
documents to what was found and what was new. A text travels compressed, and only if it is a miss.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, held, mapped, public_tokenizer, shared_dir, slices, stored, table
from .encoding import encoder

#: Bytes of a digest.
DIGEST = 16
_STORED = "version string, digest binary, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    """Digest of the library, its release and the vocabulary file."""
    with open(path, "rb") as f:
        content = f.read()
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(f"{library} {version(library)} ".encode() + content).hexdigest()


class Counter:
    """Counts tokens as the file's library gives them: no begin, end or added special tokens, no truncation or padding."""

    def __init__(self, path: str):
        self.path, self.special = path, []
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self.pieces = SentencePieceProcessor(model_file=path)
            self.normalizer = None
        else:
            from tokenizers import Tokenizer

            self.pieces = None
            self.plain = Tokenizer.from_file(path)
            self.plain.no_truncation()
            self.plain.no_padding()
            self.normalizer = self.plain.normalizer
            self.special = [x.content for x in self.plain.get_added_tokens_decoder().values()]

    def normal(self, text: bytes) -> bytes:
        """What is digested: the tokenizer's own normal form, or the text where that could make or unmake a special string."""
        if self.normalizer is None:
            return text
        own = text.decode("utf-8")
        form = self.normalizer.normalize_str(own)
        return text if any(s in own or s in form for s in self.special) else form.encode()

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; texts with special strings are encoded whole, the others by their words."""
        if self.pieces is not None:
            return [len(x) for x in self.pieces.encode(texts, out_type=int)]
        odd = [i for i, x in enumerate(texts) if any(s in x for s in self.special)]
        out = [len(x) // 4 for x in encoder(self.path, self.normalizer is None).encode(["" if i in set(odd) else x for i, x in enumerate(texts)])] if texts else []
        for i in odd:
            out[i] = len(self.plain.encode(texts[i], add_special_tokens=False).ids)
        return out


def _counter(path: str) -> Counter:
    return held(("counter", path), lambda: Counter(path))


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=DIGEST).digest()


def _missing(texts: DataFrame, known: DataFrame | None, path: str, edition: str) -> DataFrame:
    """(version, digest, n_tokens) of the distinct digests that the cache lacks: one text of each is encoded."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal, squeeze = _counter(path).normal, zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            seen = {}
            for text in byte_texts(batch.column(0)):
                content = normal(text)
                if (digest := _digest(content)) not in seen:
                    seen[digest] = squeeze(text)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array(seen.values(), pa.binary())], ["digest", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, open_ = _counter(path).counts, zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 2048):
            found = counts([open_(x).decode("utf-8") for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([edition] * batch.num_rows, pa.string()), batch.column(0), pa.array(found, pa.int64())], ["version", "digest", "n_tokens"])

    one = mapped(texts, carry, "digest binary, text binary").groupBy("digest").agg(F.first("text").alias("text"))
    if known is not None:
        one = one.join(known, "digest", "left_anti")
    return mapped(one, count, _STORED)


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """What the cache holds, (version, digest, n_tokens); nothing where there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/*.parquet"))
    return spark.read.schema(_STORED).parquet(cache) if there else spark.createDataFrame([], _STORED)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, through the digest cache at ``cache``.

    A null text is empty. Null ids and repeated rows stay rows of their own; equal texts are encoded once, and not at
    all if the cache knows them; very long texts are counted whole. Another vocabulary file or release of the library has another version, so its counts never mix.
    Without ``cache`` the run has one of its own in the shared folder. Misses are appended when all are counted, so a
    lost executor or a failed run leaves the cache as it was; runs that append the same digests at the same time leave equal rows,
    of which one is read. An empty table gives an empty table; other columns play no part.
    """
    spark, edition = docs.sparkSession, tokenizer_version(tokenizer)
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = _counter(tokenizer).normal
        for batch in slices(batches):
            raw = byte_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([_digest(normal(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "digest"])

    digests = mapped(own, named, "doc_id bigint, n_bytes bigint, digest binary")
    cache = cache or f"{shared_dir(spark).rstrip('/')}/quire-token-counts-{uuid.uuid4().hex}"
    held_now = read_cache(spark, cache).filter(F.col("version") == edition)
    hits = None
    if not held_now.isEmpty():
        before = held_now.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        hits = stored(before.join(digests.select("digest").distinct(), "digest", "left_semi"), "known-counts")
    fresh = stored(_missing(own.select("text"), hits and hits.select("digest"), tokenizer, edition), "new-counts")
    fresh.write.mode("append").parquet(cache)
    counts = fresh.select("digest", "n_tokens")
    counts = counts if hits is None else counts.unionByName(hits)
    met = digests.join(counts, "digest")
    return met.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Counts of all documents, those over 512 tokens marked; each call has a cache of its own, so it encodes every distinct text once."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer or public_tokenizer("byte_bpe_50k.json"))
