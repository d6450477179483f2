"""A training corpus from the documents table, stage by stage.

Languages are told and undecidable documents go; one document of each near-duplicate group stays; repeated
passages are taken out; private values get pseudonyms; what is left is packed into windows.
Each stage reads the Parquet that the stage before it wrote. Null and repeated ids stay rows of their own, null texts go with
the first stage, columns besides the five pass through unchanged, and an empty table gives an empty table; long texts are
worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import langid, packing, pii, simhash, superkmer
from quire.llm.common import public_tokenizer, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without letters, and those the network is unsure of, go."""
    return langid.with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group, by least id (none comes last), then by a hash of the text; of repeated rows one."""
    return simhash.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less every word of a 35-word window that occurs more than once; n_chars follows."""
    return superkmer.without_repeats(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for private values; n_chars follows."""
    return pii.without_private(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 token ids, each id in one piece."""
    return packing.pack(docs, public_tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("private", private),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Training a network and encoding token ids are not expressible in SQL.
ORACLE_SQL = None
