"""Links are counted where sets meet: no operator makes a row for each pair of a family of near copies."""

import random

import pytest

pytest.importorskip("quire.llm")
from pyspark.sql import functions as F  # noqa: E402
from test_spot_links import brute  # noqa: E402

from quire.llm import spotsigs  # noqa: E402


@pytest.fixture(scope="module")
def family(spark):
    """Near copies of one text, each with a few words of its own, of several lengths, and some unlike texts."""
    dice = random.Random(5)
    base, out = [x for i in range(30) for x in ("the", f"w{i}", f"v{i}", f"u{i}")], []
    for i in range(320):
        now = base[: 4 * dice.choice((24, 29, 30))]
        for _ in range(dice.choice((1, 1, 2))):
            now[4 * dice.randrange(len(now) // 4) + 1] = f"x{dice.randrange(60)}"
        out.append(" ".join(now))
    out += [" ".join(f"the {dice.random()}" for _ in range(12)) for _ in range(20)]
    return spark.createDataFrame(list(enumerate(out)), "doc_id bigint, text string").repartition(3).cache()


@pytest.mark.parametrize("piece", [8, 50, 1024])
def test_counts_are_those_of_brute_force(family, piece):
    told = family.select(spotsigs.signatures(F.col("text")).alias("s")).withColumn("f", spotsigs.digest(F.col("s"))).collect()
    want = {r.f: 0 for r in told}
    for a, b in brute({r.f: set(r.s) for r in told}):
        want[a], want[b] = want[a] + 1, want[b] + 1
    assert sum(want.values()) > 5000
    assert {r.fingerprint: r.links for r in spotsigs.with_links(family, piece=piece).collect()} == want


def _made(plan) -> list[tuple[str, int]]:
    """Rows made by each join and explode of a plan that has run."""
    name, children = plan.nodeName(), plan.children()
    if name == "AdaptiveSparkPlan":
        return _made(plan.executedPlan())
    if name.endswith("QueryStage"):
        return _made(plan.plan())
    rows = plan.metrics().get("numOutputRows")
    own = [(plan.nodeName(), rows.get().value())] if ("Join" in name or name == "Generate") and rows.isDefined() else []
    return own + [x for i in range(children.size()) for x in _made(children.apply(i))]


def test_rows_do_not_grow_with_the_square_of_a_family(family, monkeypatch):
    frames = []
    monkeypatch.setattr(spotsigs, "stored", lambda df, name: frames.append(df) or df)
    pairs = sum(r.links for r in spotsigs.with_links(family).collect()) // 2
    made = _made(frames[0]._jdf.queryExecution().executedPlan())
    if not any(n for _, n in made):
        frames[0].collect()
        made = _made(frames[0]._jdf.queryExecution().executedPlan())
    prefixes = max(n for name, n in made if name == "Generate")
    assert pairs > 2 * prefixes > 0 and all(n <= prefixes for _, n in made), (pairs, made)
