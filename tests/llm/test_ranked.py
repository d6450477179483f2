"""Hard negatives, token counts and lexical search against brute force, libraries and edge cases."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from quire.llm import hard_negatives, lexical, token_counts  # noqa: E402

NAN, INF = float("nan"), float("inf")


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


# hard negatives


def plain_negatives(given, positives=5, negatives=10):
    own = {(i, c, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, c in given if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in own:
        if a[0] % 10:
            continue
        met = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in own if b[0] != a[0] and len(b[2]) == len(a[2]))
        for p, pid, _ in [m for m in met if m[2] == a[1]][:positives]:
            hits = [(-s, i) for s, i, c in met if c != a[1] and -30 * p <= -100 * s <= -90 * p]
            out += [(a[0], pid, r + 1, i, -p, s) for r, (s, i) in enumerate(hits[:negatives])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["unit", "norms", "ties", "huge"])
def test_negatives_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "GROUP", 3)
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 8))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif kind == "norms":
        x *= r.lognormal(0, 2, 400)[:, None]
    elif kind == "ties":
        x = r.integers(0, 2, (400, 8)) / 16
    else:
        x *= 1e4 * r.lognormal(0, 1, 400)[:, None]
    given = [(i, v, int(c)) for i, (v, c) in enumerate(zip(x.astype(np.float32).tolist(), r.integers(0, 4, 400)))]
    given += [given[0], given[10], (20, [0.5] * 8, 1), (None, [0.5] * 8, 1), (1000, None, 1), (1001, [0.5] * 8, None), (1002, [NAN] * 8, 1), (1003, [INF] + [0.1] * 7, 2), (1004, [None] * 8, 2), (1010, [], 1), (1011, [], 2), (1020, [0.2] * 3, 1), (1021, [0.2] * 3, 1), (1022, [0.1] * 3, 2)]
    frame = spark.createDataFrame([(*g, "x", 1) for g in given], "vec_id bigint, embedding array<float>, label int, key string, norm int")
    want = plain_negatives(given)
    assert len(want) > 100
    assert rows(hard_negatives.mine(frame, F.col("id") % 10 == 0)) == want


def test_negatives_of_nothing(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert not hard_negatives.mine(spark.createDataFrame([], kind), F.lit(True)).collect()
    assert not hard_negatives.mine(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], kind), F.lit(True)).collect()
    assert not hard_negatives.mine(spark.createDataFrame([(0, [3e38], 1), (1, [3e38], 1), (2, [3e38], 2)], kind), F.lit(True)).collect()


# token counts

TEXTS = ["the river and  the stone", None, "", "the river and  the stone", "<|endoftext|> at the start", "café Stone \n\n two", "café stone two", " ".join(f"w{i % 991} the" for i in range(60_000)), "x" * 100_000, "é" * 300, "<|EndOfText|>"]


def frame_of(spark, texts):
    return spark.createDataFrame([(i if i % 7 != 6 else None, t, b"x", "k") for i, t in enumerate(texts)], "doc_id bigint, text string, digest binary, version string")


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_library(spark, file):
    path = public.path(file)
    if file.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        count = lambda t, p=SentencePieceProcessor(model_file=path): len(p.encode(t))
    else:
        from tokenizers import Tokenizer

        count = lambda t, p=Tokenizer.from_file(path): len(p.encode(t, add_special_tokens=False).ids)
    want = sorted(((i if i % 7 != 6 else None, len((t or "").encode()), n := count(t or ""), n > 512) for i, t in enumerate(TEXTS)), key=repr)
    assert rows(token_counts.count_tokens(frame_of(spark, TEXTS), path)) == want


def test_cache_encodes_only_misses(spark, tmp_path):
    cache, path = str(tmp_path / "counts"), public.path("byte_bpe_50k.json")
    first = rows(token_counts.count_tokens(frame_of(spark, TEXTS[:6]), path, cache))
    kept = spark.read.parquet(cache)
    assert kept.count() == 4 and kept.select("digest").distinct().count() == 4  # null and "" are one text, and so are the equal ones
    again = rows(token_counts.count_tokens(frame_of(spark, TEXTS[:6]), path, cache))
    assert again == first and spark.read.parquet(cache).count() == 4
    more = rows(token_counts.count_tokens(frame_of(spark, TEXTS), path, cache))
    assert set(first) <= set(more) and spark.read.parquet(cache).count() == 9
    token_counts.count_tokens(frame_of(spark, TEXTS[:1]), public.path("word_bpe_49k.json"), cache)
    held = spark.read.parquet(cache)
    assert held.count() == 10 and held.select("version").distinct().count() == 2
    held.write.mode("append").parquet(cache)  # as runs at the same time would leave it
    assert rows(token_counts.count_tokens(frame_of(spark, TEXTS), path, cache)) == more


def test_spaces_of_one_normal_form_are_encoded_once(spark, tmp_path):
    cache = str(tmp_path / "counts")
    got = token_counts.count_tokens(frame_of(spark, ["Café stone", "café  STONE"]), public.path("word_bpe_49k.json"), cache).collect()
    assert len({r.n_tokens for r in got}) == 1 and len({r.n_bytes for r in got}) == 2 and spark.read.parquet(cache).count() == 1


def test_counts_of_nothing(spark):
    out = token_counts.count_tokens(frame_of(spark, ["a"]).filter("false"), public.path("byte_bpe_50k.json"))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and not out.collect()


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(docs, items, k=10):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [x for x in own if x[1]]
    n, whole = len(own), sum(c.total() for _, c in own)
    df = Counter(itertools.chain.from_iterable(c.keys() for _, c in own))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c in own:
            m = 100 - 90 + 90 * c.total() * n // whole
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted & c.keys())
            scored += [(-s, doc is None, doc or 0)] if s else []
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["été", "Ünder", "3d", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, "".join(w + r.choice([" ", ", ", "-", "_", "\n"]) for w in r.choices(words, weights, k=r.randint(0, 60)))) for i in range(700)]
    docs += [docs[3], (3, docs[4][1]), (None, docs[5][1]), (800, None), (801, ""), (802, "?! --"), (803, " ".join(words * 3000)), (804, "W1 w1 W2")]
    docs += [(900 + i, "ties of w1 and w2") for i in range(30)]
    items = [(i, " ".join(r.choices(words, weights, k=r.randint(1, 25)))) for i in range(40)] + [(1, "W7 w8"), (None, "été"), (50, None), (51, ""), (52, "unknown"), (53, "ties"), (54, "été w1 " + "日本-3D")]
    return docs, items


@pytest.mark.parametrize("sizes", [(16384, 1 << 20, 1024, 1_000_000), (37, 900, 7, 5)])
def test_ranks_equal_brute_force(spark, corpus, monkeypatch, sizes):
    for name, size in zip(("DOCS", "POSTINGS", "QUERIES", "TERMS"), sizes):
        monkeypatch.setattr(lexical, name, size)
    docs, items = corpus
    frame = spark.createDataFrame([(*d, 1, "t") for d in docs], "doc_id bigint, text string, query int, terms string").repartition(3)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id bigint, text string, rank int")
    got = rows(lexical.rank(frame, asked))
    assert got == plain_ranks(docs, items)


def test_ranks_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert not lexical.rank(docs, items).collect()
    full = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert not lexical.rank(full, items.filter("false")).collect()
    assert [tuple(r) for r in lexical.rank(full, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_terms_of_pieces_are_terms_of_the_text(monkeypatch):
    text = " ".join(f"Wörd{i % 17}-x{i % 5}" for i in range(5000)).encode()
    want = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "_PIECE", 100)
    assert lexical.term_counts(text) == want == Counter(x.encode() for x in TERM.findall(text.decode().translate(LOWER)))


def test_blocks_cost_least():
    r = random.Random(2)
    lists = [np.array([r.randint(0, 50) for _ in range(n)]) for n in (1, 2, 7, 11, 13, 12, 3)] + [np.zeros(0, np.int64), np.full(9, 4)]
    cost = lambda x, cuts, fee: sum(len(b) * b.max() + fee for b in np.split(x, cuts[1:]))
    for x, got in zip(lists, lexical.blocks(lists, longest=5, opening=2)):
        if not len(x):
            assert not len(got)
            continue
        fee = 2 * (x.max() - x.mean())
        assert got[0] == 0 and (np.diff([*got, len(x)]) <= 5).all()
        every = ([0, *c] for k in range(len(x)) for c in itertools.combinations(range(1, len(x)), k))
        assert cost(x, got, fee) == pytest.approx(min(cost(x, c, fee) for c in every if (np.diff([*c, len(x)]) <= 5).all()))


def test_blocks_are_skipped(spark):
    """A rare strong term makes the other term's blocks needless but for the documents that hold both."""
    n = 4000
    docs = [(i, "common " + ("rare " if i < 12 else "") + " ".join(f"u{i}x{j}" for j in range(i % 9))) for i in range(n)]
    building = lexical.Building({b"common", b"rare"})
    for i, t in docs:
        building.add(i, lexical.term_counts(t.encode()))
    row = building.row().to_pylist()[0]
    shard = lexical.Shard(row, {"common": 10, "rare": 9000}, n, sum(building.lengths))
    found, read = shard.best(["common", "rare"], 10, 0)
    assert {d for _, _, d in found} <= set(range(12)) and len(found) == 10 and read < n / 10
