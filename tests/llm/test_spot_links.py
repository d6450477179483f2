"""Links of spot signatures against brute force, with signatures so common that they are cut, and classes beside hot copies."""

import random
from itertools import combinations

import pytest

pytest.importorskip("quire.llm")
from pyspark.sql import functions as F  # noqa: E402

from quire.llm import spotsigs  # noqa: E402


def texts() -> list[str | None]:
    """Families of texts of one base with a few words changed, left out or added, short texts, copies and nulls."""
    dice = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    out: list[str | None] = [None, "", "   ", "the", "the one", "the one", "no anchors here whatever"]
    for family in range(12):
        base = [x for _ in range(dice.choice((3, 5, 8, 20, 60))) for x in ("the", *dice.sample(words, 3))]
        for _ in range(45):
            now = list(base)
            for _ in range(dice.choice((0, 1, 1, 2, 6))):
                at = dice.randrange(len(now))
                now[at : at + dice.choice((0, 1))] = [dice.choice(words)] if dice.random() < 0.6 else []
            out.append(" ".join(now))
    return out + [out[20]] * 30


def brute(sets: dict[str, set]) -> dict[tuple[str, str], float]:
    found = {}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
            found[a, b] = both / (len(sets[a]) + len(sets[b]) - both)
    return found


@pytest.fixture(scope="module")
def many(spark):
    rows = [(None if i == 9 else i, t) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()


@pytest.mark.parametrize("piece", [4, 1024])
def test_links_are_those_of_brute_force(many, piece):
    told = many.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).withColumn("f", spotsigs.digest(F.col("s"))).collect()
    classes, pairs = spotsigs.similar(many, piece=piece)
    got = [(*sorted((r.a, r.b)), r.score) for r in pairs.collect()]
    want = brute({r.f: set(r.s) for r in told})
    assert len(want) > 1000 and len({r.f for r in told}) > 300
    assert {(a, b): s for a, b, s in got} == pytest.approx(want) and len(got) == len(want)
    ids: dict = {}
    for r in told:
        ids.setdefault(r.f, []).append(r.doc_id)
    assert {r.fingerprint: (r.class_id, r.copies) for r in classes.collect()} == {
        f: (min((i for i in x if i is not None), default=None), len(x)) for f, x in ids.items()
    }


def test_query_keeps_all_rows_beside_hot_classes(spark, many, tmp_path):
    """Classes sent to all tasks and classes that are joined give the same columns; clashing columns and empty tables do no harm."""
    many.withColumns({"links": F.lit(1), "class_id": F.lit("x"), "told": F.lit(2)}).write.parquet(str(tmp_path / "documents.parquet"))
    got = spotsigs.op7(spark, str(tmp_path)).collect()
    of = {r.fingerprint: r for r in spotsigs.with_links(many).collect()}
    assert len(got) == many.count() and all((r.class_id, r.links) == (of[r.fingerprint].class_id, of[r.fingerprint].links) for r in got)
    rows = many.select("doc_id", spotsigs.digest(spotsigs.signatures(F.col("text"))).alias("fingerprint"))
    few = spotsigs._beside(rows, spotsigs.with_links(many), F.lit("-"), most=2).collect()
    assert sorted(few, key=str) == sorted(spotsigs._beside(rows, spotsigs.with_links(many), F.lit("-")).collect(), key=str)
    many.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert spotsigs.op7(spark, str(tmp_path / "empty")).count() == 0
