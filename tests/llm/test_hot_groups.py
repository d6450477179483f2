"""Hot minimisers and large buckets of repeated windows, against brute force."""

import random

import pytest

pytest.importorskip("public_tokenizers")
from quire.llm import superkmer  # noqa: E402


def brute(texts, width):
    seen = {}
    for d, t in enumerate(texts):
        w = (t or "").split()
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i : i + width]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + width))
    return [" ".join(w for i, w in enumerate((t or "").split()) if i not in gone[d]) for d, t in enumerate(texts)]


@pytest.mark.parametrize("hot, bucket", ((50_000, 32 << 20), (20, 32 << 20), (50_000, 2_000)))
def test_hot_passage(spark, monkeypatch, hot, bucket):
    """A short line inside different texts, a passage many share, and copies; windows go on one by one where limits are small."""
    monkeypatch.setattr(superkmer, "HOT", hot)
    monkeypatch.setattr(superkmer, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(superkmer, "_BATCH", 16)
    r = random.Random(5)
    some = lambda n: [f"w{r.randrange(300)}" for _ in range(n)]
    line, passage = some(6), some(30)
    texts = [" ".join(some(r.randrange(20)) + line + some(r.randrange(20)) + (passage if i % 3 == 0 else []) + some(5)) for i in range(120)]
    texts += [texts[0], texts[7] + " end", None, "", "one two"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in superkmer.remove_repeats(frame, 12).select("row.doc_id", "kept", "n_words", "n_removed").collect()}
    want = brute(texts, 12)
    assert [got[i].kept for i in range(len(texts))] == want
    assert all(got[i].n_words - got[i].n_removed == len(want[i].split()) for i in range(len(texts)))


def test_bucket_is_bounded_unpacked():
    """Alike strings pack to almost nothing; what counts for a task's memory is their unpacked size."""
    packs = []
    for k in range(8):
        strings = [b"%d " % (1000 * k + i) + b"0 " * 500 for i in range(1000)]
        packs.append(superkmer._pack([(1, i, 0, 0, 1, i) for i in range(1000)], strings))
    assert sum(map(len, packs)) < 1 << 20
    held = [(whole, len(own)) for whole, own in superkmer._buckets([(0, packs[0])] + [(1, x) for x in packs] + [(2, packs[0])], 3 << 20)]
    assert held == [(True, 1), (False, 3), *[(False, 1)] * 5, (True, 1)]
