"""Recall and precision of the pipeline's near-duplicate stage at its Jaccard limit, by text length."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from quire.llm import shingle_sets, simhash  # noqa: E402

SCHEMA = "doc_id bigint, text string"
LENGTHS = (4, 8, 32, 100, 400)


def words(r, n):
    return [f"w{r.getrandbits(40):x}" for _ in range(n)]


def test_copies_at_the_limit_go_and_others_stay(spark):
    """A text of n shingles and its extension by n / 4 words have Jaccard similarity 0.8, with one word more less."""
    r = random.Random(3)
    rows, gone = [], set()
    for n in LENGTHS:
        for k in range(60):
            base, more = words(r, n + 4), n // 4 + k % 2
            rows.append((len(rows), " ".join(base)))
            if k % 2 == 0:
                gone.add(len(rows))
            rows.append((len(rows), " ".join(base + words(r, more))))
    left = {x.doc_id for x in simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, _ in rows} - left == gone


@pytest.mark.parametrize("n", (5, 30, 67, 270, 1000))
def test_recall_of_keys(n):
    rng = np.random.default_rng(n)
    lost = 0
    for _ in range(300):
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        c = a[: n - n // 5]
        assert 0.8 <= len(c) / len(a) < 0.81
        lost += not set(shingle_sets.band_keys(np.unique(a))) & set(shingle_sets.band_keys(np.unique(c)))
    assert lost <= 1


def test_forest_equals_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 50, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(36, 51)], rng.integers(0, 2**64, rng.integers(0, 6), dtype=np.uint64)]) for _ in range(60)]
    near = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8}
    fps = np.array([simhash.vote(x) for x in sets], np.int64).view(np.uint64)
    linked = shingle_sets.forest(sets, fps, np.arange(60))
    assert set(linked) <= near

    def groups(pairs):
        of = list(range(60))
        for _ in range(60):
            for i, j in pairs:
                of[i] = of[j] = min(of[i], of[j])
        return of

    assert groups(linked) == groups(near)


def test_a_key_with_many_members(spark, monkeypatch):
    """A group whose members link in a chain only, none with the least member of their keys, cut into parts."""
    monkeypatch.setattr(shingle_sets, "PIECE", 8)
    r = random.Random(7)
    long = words(r, 400)
    rows = [(i, " ".join(long[4 * i : 4 * i + 104])) for i in range(60)]
    assert [x.doc_id for x in simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]


def test_rows_that_share_an_id_or_have_none(spark):
    r = random.Random(9)
    a, b, c, d, e = (" ".join(words(r, 60)) for _ in range(5))
    rows = [(3, b), (5, a), (5, b + " end"), (5, a), (None, c), (None, c + " end"), (None, d), (None, a), (7, e), (7, e + " end")]
    left = [tuple(x) for x in simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(left) == 5 and {(3, b), (5, a), (None, d)} <= set(left)
    assert len({(None, c), (None, c + " end")} & set(left)) == 1 and len({(7, e), (7, e + " end")} & set(left)) == 1
