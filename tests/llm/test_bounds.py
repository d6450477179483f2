"""What operators hold at once, and results at production sizes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

from quire.llm import dac, graph_ann, packing, shingle_sets, suffix_pieces  # noqa: E402


@pytest.mark.parametrize("low, high", [(1030, 2047), (1, 2047), (2040, 2047)])
def test_open_windows_are_bounded(low, high):
    """Documents of over half a window fit with none before; all ids are packed once and without padding."""
    r, packer, most, sizes, got, filled = random.Random(4), packing.LevelPacker(), 0, [], {}, {}

    def note(found):
        for item, start, ids, total, sequence, offset in found:
            got.setdefault(item, []).append((start, len(ids) // 4))
            assert total == sizes[item] and offset == filled.get(sequence, 0)
            filled[sequence] = offset + len(ids) // 4

    for item in range(60_000 if low == 1030 else 8_000):
        sizes.append(r.randint(low, high))
        note(packer.add(item, bytes(4 * sizes[item])))
        assert packer.open == packer.counts[1:].sum() and packer.open <= packing.OPEN
        most = max(most, packer.open)
    note(packer.close())
    assert most > packing.OPEN // 2
    for item, pieces in got.items():
        pieces.sort()
        assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) == sizes[item]
    assert len(got) == len(sizes) and sum(n != 2048 for n in filled.values()) == bin(sum(sizes) % 2048).count("1") and all(n & (n - 1) == 0 for n in filled.values())


def test_pairs_of_pieces_are_bounded(monkeypatch):
    path = public.path("piece_bpe_32k.model")
    monkeypatch.setattr(suffix_pieces, "PAIRS", 500)
    encoder = suffix_pieces.Encoder(suffix_pieces.load(path))
    from sentencepiece import SentencePieceProcessor

    library, r = SentencePieceProcessor(model_file=path), random.Random(1)
    for _ in range(20):
        texts = [" ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 300 if k == 0 else 12))) for k in range(20)) for _ in range(10)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == library.encode(texts)
        assert len(encoder.pairs) < 500 + 200 * 300


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_recall_of_a_whole_shard(kind):
    """At the production size of a shard, of the production beam; random directions are the hard case."""
    r, n = np.random.default_rng(7), graph_ann.SHARD
    x = r.normal(size=(n + 400, 64))
    if kind == "clustered":
        x = r.normal(size=(40, 64))[r.integers(0, 40, n + 400)] + 0.3 * x
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = graph_ann.Graph(x[:n])
    found, _ = graph.search(x[n:], graph_ann.BEAM)
    true = np.argsort(-(x[n:] @ x[:n].T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found[:, :5].tolist(), true.tolist())]) >= 0.9


def test_neighbours_do_not_depend_on_the_session(spark):
    r = np.random.default_rng(2)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(r.normal(size=(3000, 16)).astype(np.float32).tolist())], "vec_id bigint, embedding array<float>").repartition(5)
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for tasks in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            got.append(sorted(tuple(x) for x in graph_ann.nearest(frame, frame.filter(F.col("vec_id") % 100 == 0), shard=1000).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [x[:3] for x in got[0]] == [x[:3] for x in got[1]] and np.allclose([x[3] for x in got[0]], [x[3] for x in got[1]], rtol=1e-12)


def test_ids_are_found_by_their_places(spark):
    r = np.random.default_rng(5)
    ids = np.concatenate([r.integers(0, 200, 3000), r.integers(0, 70_000, 3000), r.integers(0, 1 << 31, 500), np.zeros(700, np.int64)]).astype("<u4")
    r.shuffle(ids)
    file = dac.IdFile(dac.write_file([1], [ids.tobytes()]))
    places = r.integers(0, len(ids), 4000)
    assert file.take(places).tolist() == ids[places].tolist() == [file[int(p)] for p in places]
    assert file.take(np.empty(0, np.int64)).tolist() == []
    docs = spark.createDataFrame([(1, "the river and the stone"), (2, None), (3, "light " * 700)], "doc_id bigint, text string")
    path = public.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    own = {i: [*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs.collect()}
    got = dac.read_ids(dac.write_ids(docs, path), ends=True).collect()
    assert {x.doc_id: (x.first_id, x.middle_id, x.last_id) for x in got} == {i: (x[0], x[len(x) // 2], x[-1]) for i, x in own.items()}


def test_small_sets_have_no_bit_limit():
    """Sets of four and five shingles at a similarity of 0.8 may lie more than ``MAX_BITS`` apart."""
    r, far = np.random.default_rng(8), 0
    for _ in range(60):
        b = r.integers(1, 1 << 63, (2000, 5), dtype=np.uint64)
        a = b[:, :4]
        bits = lambda x: ((x[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(1) * 2 > x.shape[1]
        apart = (bits(a) != bits(b)).sum(1)
        for k in np.flatnonzero(apart > shingle_sets.MAX_BITS).tolist():
            far += 1
            fps = np.array([int("".join("1" if v else "0" for v in row[::-1]), 2) for row in (bits(a)[k], bits(b)[k])], np.uint64)
            assert shingle_sets.forest([np.sort(a[k]), np.sort(b[k])], fps, np.arange(2)) == [(0, 1)]
    assert far
