"""The near-duplicate stage finds near fingerprints through the cells of the pivot tables, whatever the keys hold."""

import random

import pytest

pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from quire.llm import shingle_sets  # noqa: E402


def test_near_fingerprints_link_without_keys(spark):
    r = random.Random(11)
    rows = []
    for _ in range(40):
        base = [f"w{r.getrandbits(40):x}" for _ in range(900)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + ["end"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    prints = shingle_sets.sketches(docs, 5).withColumn("keys", F.array().cast("array<bigint>")).cache()
    of = {x["__id"]: x for x in prints.collect()}
    want = {frozenset((of[i]["set"], of[i + 1]["set"])) for i in range(0, 80, 2) if ((of[i]["fp"] ^ of[i + 1]["fp"]) % 2**64).bit_count() <= shingle_sets.CELL_BITS}
    assert len(want) > 25
    groups: dict = {}
    for x in shingle_sets.components_of(docs, prints, 5).collect():
        groups.setdefault(x.root, set()).add(x.node)
    assert {frozenset(x) for x in groups.values()} == want
