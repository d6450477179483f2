"""Brute-force, round-trip and edge-case tests of the corpus operators."""

import datetime
import math
import os
import random
from zlib import crc32

import numpy as np
import pytest

from quire.llm import components, dac, graph_ann, langid, licenses, packing, pii, simhash, spotsigs, suffix_pieces, superkmer

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and river stone light moon grass to in wind door house is that tree".split()


def rows(n=40, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(r.choice(WORDS) + r.choice(["", "a", "er", "."]) for _ in range(r.randint(1, 150)))
        out.append((i, text, "en" if i % 2 else "fr", "s", len(text)))
    out += [(n, out[0][1], "en", "s", 1), (n + 1, out[3][1] + " moon", "en", "s", 1), (n + 2, "  ", "en", None, 2), (n + 3, None, None, None, None), (n + 4, "", "fr", "s", 0)]
    return out + [(None, "no id here", "en", "s", 10), (5, out[5][1], "en", "s", 1), (n + 5, "x" * 3000 + " " + "é " * 50, "fr", "s", 3101)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_fingerprint(text, width):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    of = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and of[a] != of[b]:
                    of[a] = of[b] = min(of[a], of[b])
                    changed = True
    return of


def test_simhash_equals_brute_force(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    want = [(r[0], plain_fingerprint(r[1], 3)) for r in rows()]
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1)) for r in got) == sorted((str(a), b) for a, b in want)
    fps = sorted({f for _, f in want})
    of = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, f in want:
        if d is not None:
            least[of[f]] = min(least.get(of[f], d), d)
    assert all(r.component_id == least.get(of[r.fp & (2**64 - 1)]) for r in got)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_a_large_bucket(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62)
    fps = sorted({int(base) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (2500, 2))})
    keyed = spark.createDataFrame([(1, f) for f in fps], "cell bigint, fp bigint")
    found = components.components(simhash.links(keyed, 2)).collect()
    assert {r.node for r in found} == set(fps) and len({r.root for r in found}) == 1

def test_cells_and_stars_equal_brute_force(spark, monkeypatch):
    """Random and planted fingerprints, with cells so small that several references cut and pieces are made."""
    rng = np.random.default_rng(4)
    near = rng.integers(-(2**63), 2**63 - 1, 500)
    near = np.concatenate([near ^ (np.int64(1) << a) ^ (np.int64(1) << b) for a, b in rng.integers(0, 63, (4, 2))])
    chain = [int(near[0])]
    for bit in range(60):
        chain.append(chain[-1] ^ (1 << bit))
    fps = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, 3000), near, np.array(chain), [0, -1, 1, 3]]))
    bits = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :])
    for most in (0, 1, 2, 3):
        left, right = np.nonzero(np.triu(bits <= most, 1))
        want = components.joined(np.arange(len(fps)), left, right)
        monkeypatch.setattr(simhash, "CELL", 16)
        monkeypatch.setattr(simhash, "PIECE", 64)
        classes = spark.createDataFrame([(int(f),) for f in fps], "fp bigint")
        found = {r.node: r.root for r in components.components(simhash.links(simhash.dealt(classes, most), most)).collect()}
        assert [found.get(int(f), int(f)) for f in fps] == fps[want].tolist()


def test_pairs_within_reach_share_a_cell():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**64 - 1, 300, dtype=np.uint64)
    for most in (1, 2, 5):
        b = a.copy()
        for _ in range(most):
            b ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
        own, other = ({(r, c) for r, c in zip(*(x.tolist() for x in simhash.cells(x, 12, most)))} for x in (a, b))
        assert {r for r, _ in own & other} == set(range(300))


def test_one_of_each(docs, empty, spark):
    kept = simhash.one_of_each(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and 40 not in ids and 0 in ids and ids.count(5) == 1 and None in ids
    assert simhash.one_of_each(empty).count() == 0


def test_components_of_a_path(spark):
    frame = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(frame).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


@pytest.mark.parametrize("text", ["", "  Hello  world\n\0 a<s>b 日本x\U0001f600 ", "   ", "a" * 200, "the" * 400, "ééé ñññ", "<unk> 1234", "a\tb \U0010ffff"])
def test_pieces_equal_library(text):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), suffix_pieces.encoder(path)
    ids = own.encode([text, "and " + text])
    assert np.frombuffer(ids[0], "<u4").tolist() == lib.encode(text)
    assert np.frombuffer(ids[1], "<u4").tolist() == lib.encode("and " + text)
    assert own.decode(ids[0]) == text


def test_encode_rows(docs, empty):
    path = public.path("piece_bpe_32k.model")
    got = suffix_pieces.encode(docs, path).collect()
    assert len(got) == len(rows()) and all(r.decoded == r.text for r in got)
    assert suffix_pieces.encode(empty, path).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[100:140] = x[100]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (None, [1.0] * 16)]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = graph_ann.nearest(frame, frame.filter("vec_id % 50 = 0"), shard=200).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        score = u @ u[q]
        score[q] = -9
        top = np.lexsort((np.arange(600), -np.round(score, 12)))[:5]
        hits += len({r.vec_id for r in mine} & set(top.tolist()))
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(math.isclose(r.score, score[r.vec_id], abs_tol=1e-9) for r in mine)
        if q == 100:
            assert [r.vec_id for r in mine] == [101, 102, 103, 104, 105]
    assert hits >= 0.9 * 60
    assert graph_ann.nearest(frame.limit(0), frame).count() == 0


@pytest.mark.parametrize("file, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_library(file, spaced):
    from quire.llm.encoding import PieceEncoder

    own = PieceEncoder(public.path(file), spaced)
    texts = ["", "  Hello  world\n", " a\n b", "a\n b \n c  d", " ", "it's  <|endoftext|> y", "ÀÉ ﬁ Σς\t\tq", own.divider + " x" + own.divider] + [r[1] or "" for r in rows()]
    want = [np.array(e.ids, "<u4").tobytes() for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want and own.encode(texts) == want


def test_packing(docs, empty):
    path = public.path("byte_bpe_50k.json")
    got = packing.pack(docs, path, window=256).collect()
    from quire.llm.encoding import PieceEncoder

    own = PieceEncoder(path, True)
    want = {}
    for r in rows():
        want.setdefault(r[0], []).append(own.encode([r[1] or ""])[0] + np.array([1], "<u4").tobytes())
    assert sum(r.length for r in got) == sum(len(x) // 4 for v in want.values() for x in v)
    for r in got:
        assert any(len(x) // 4 == r.doc_tokens and crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for x in want[r.doc_id])
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert all(n == 256 or n & (n - 1) == 0 for n in fill.values())
    assert packing.pack(empty, path).count() == 0


def test_level_choice():
    packer = packing.LevelPacker(8)
    packer.counts[[3, 5]] = [4, 1]
    best = {}
    for h in (0, 3, 5):
        after = packer.counts.copy()
        if h:
            after[h] -= 1
        after[h + 3] += 1
        best[h] = int((after[:8] ** 2)[1:].sum())
    assert best[packer.level(3)] == min(best.values())


def test_languages(spark):
    r = random.Random(2)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(30))
    texts = [(i, make(["the", "ing", "er"]) if i % 2 else make(["eau", "oux", "é"]), "en" if i % 2 else "fr") for i in range(200)]
    model = langid.fit(spark.createDataFrame(texts, "doc_id bigint, text string, lang string"), per_lang=60)
    odd = [(1000, None, "en"), (1001, "123 456", None), (1002, "", "fr"), (None, "thing", "en"), (1003, "ing" * 500, "en")]
    frame = spark.createDataFrame(texts + odd, "doc_id bigint, text string, lang string")
    got = langid.predict(frame, model).select("row.*", "lang_pred", "score", langid.held_out("row.doc_id").alias("h")).collect()
    held = [x for x in got if x.h and (x.doc_id or 0) < 1000]
    assert held and all(x.lang == x.lang_pred for x in held) and all(0 <= x.score <= 1 for x in got)
    assert all(x.h == (crc32(str(x.doc_id).encode()) % 3 == 1) for x in got if x.doc_id is not None)
    by = {x.doc_id: x.lang_pred for x in got}
    assert (by[1000], by[1001], by[1002], by[None], by[1003]) == ("und", "und", "und", "en", "en")
    assert langid.predict(frame.limit(0), model).count() == 0
    assert langid.predict(frame, langid.fit(frame.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_gradients():
    model = langid.Tagger(["a", "b"], hidden=4)
    codes, target = np.random.default_rng(1).integers(0, 256, (3, 5)).astype(np.uint8), np.array([0, 1, 0])
    _, grads = model.step(codes, target)
    for p, g in zip(model.params(), grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = p[i], 1e-2
        p[i] = old + e
        up = model.step(codes, target)[0]
        p[i] = old - e
        down = model.step(codes, target)[0]
        p[i] = old
        assert (up - down) / (2 * e) == pytest.approx(float(g[i]), rel=0.02, abs=1e-4)


def plain_removal(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])] = seen.get(tuple(w[i : i + width]), 0) + 1
    out = []
    for w in words:
        gone = {k for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for k in range(i, i + width)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("width", [1, 3, 8])
def test_repeats_equal_brute_force(docs, width):
    got = superkmer.remove_repeats(docs.select("doc_id", "text"), width).select("row.doc_id", "kept", "n_words", "n_removed").collect()
    want = [(str(r[0]), *x) for r, x in zip(rows(), plain_removal([r[1] for r in rows()], width))]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept.encode()) for r in got) == sorted(want)


def test_repeats_in_one_text_and_empty(spark, empty):
    text = " ".join(["ing"] * 50)
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = superkmer.remove_repeats(frame, 35).first()
    assert (row.n_removed, row.kept) == (50, "")
    assert superkmer.without_repeats(empty).count() == 0


def test_spot_signatures(spark, docs, empty):
    from pyspark.sql import functions as F

    text = "The red fox of a small blue house"
    got = spark.range(1).select(spotsigs.signatures(F.lit(text)).alias("s")).first().s
    import hashlib

    want = sorted(hashlib.md5(x.encode()).hexdigest()[:12] for x in ("the red fox small", "a small blue house"))
    assert got == want
    classes, pairs = spotsigs.similar(docs, 0.8)
    names = {r.doc_id: r.f for r in docs.select("doc_id", spotsigs.digest(spotsigs.signatures(F.col("text"))).alias("f")).collect()}
    assert names[0] == names[40] and any({r.a, r.b} == {names[3], names[41]} for r in pairs.collect())
    assert {r.class_id for r in classes.filter(F.col("fingerprint") == names[0]).collect()} == {0}
    assert spotsigs.similar(empty)[1].count() == 0 and spotsigs.with_next(empty).count() == 0


def test_next_document(docs):
    got = spotsigs.with_next(docs).collect()
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    want = {order[i][0]: order[(i + 1) % len(order)][1] or "" for i in range(len(order))}
    assert len(got) == len(order) and all(r.next_text == want[r.doc_id] for r in got if r.doc_id != 5)


def test_licenses(spark, empty):
    known = licenses.known_licenses(spark)
    mit = licenses.KNOWN[1][1]
    changed = "Copyright (c) 2020 Somebody\n" + mit.upper().replace(",", "").replace("SUBLICENSE", "SUB-LICENSE")
    data = [(1, changed), (2, "words\nReleased under the MIT licence!\nmore"), (3, None), (None, "x"), (4, mit + " but not")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(data, "doc_id bigint, text string"), known).collect()}
    assert got[1].license == "MIT" and got[2].license is None and got[2].notices == "MIT" and got[4].license is None and got[3].notices == "" and len(got) == 5
    assert licenses.scan(empty, known).count() == 0


def test_id_files(docs, empty):
    path = public.path("word_bpe_49k.json")
    got = dac.read_ids(dac.write_ids(docs.filter("doc_id is not null and doc_id <> 5"), path)).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.doc_id):
        assert r.start == at
        at += r.n_tokens
    assert dac.read_ids(dac.write_ids(empty, path)).count() == 0
    ids = np.random.default_rng(1).choice([1, 255, 256, 65535, 65536, 2**32 - 1], 3000).astype("<u4")
    file = dac.IdFile(dac.write_file([1, None], [ids[:10].tobytes(), ids[10:].tobytes()]))
    assert [file[i] for i in range(3000)] == ids.tolist() and file.all().tolist() == ids.tolist()
    assert [d for d, _, _ in file.documents()] == [1, None]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_private_values(spark, empty):
    card, date = "4111 1111-1111 1111", "2024-02-29"
    data = [(1, f"a {card} b {date} c x.y@z.com d 123-45-6789 e +1 (988) 555-2485 f 70.1.2.3"), (2, f"{date} 4111111111111111 x.y@z.com"), (3, "1234567890123456 2024-02-30 300.1.1.1"), (4, None), (5, "plain"), (None, "")]
    frame = spark.createDataFrame([(*x, 7) for x in data], "doc_id bigint, text string, n_pii int")
    got = {r.doc_id: r for r in pii.mask(frame, "k").collect()}
    assert got[1].n_pii == 6 and got[2].n_pii == 3 and got[3].n_pii == 0 and got[3].text == data[2][1] and got[4].text is None and got[5].text == "plain"
    words = got[1].text.split(" ")
    new_card = "".join(words[1:4])
    digits = "".join(c for c in new_card if c.isdigit())
    assert luhn(digits) and len(digits) == 16 and digits != "4111111111111111"
    assert got[2].text.split()[1] == digits and got[2].text.split()[0] in got[1].text and datetime.date.fromisoformat(got[2].text.split()[0])
    assert "x.y@z.com" not in got[1].text and got[2].text.split()[2] in got[1].text
    assert pii.mask(empty, "k").count() == 0


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    out = spark.range(7 * 11).select(pii.feistel("k", "t", F.floor(F.col("id") / 11), F.col("id") % 11, F.lit(7), F.lit(11)).alias("x")).select("x.*")
    assert out.distinct().count() == 77 and out.filter("l < 0 or l >= 7 or r < 0 or r >= 11").count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "private", "packed"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= {r[0] for r in rows()}
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables are absent")
@pytest.mark.parametrize("name", ["op6_substrings", "op7_spotsigs", "op8_licenses"])
def test_query_equals_sql(spark, name):
    import duckdb

    from quire.llm import queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, d).toPandas()[list(want.columns)]
    a, b = (x.sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    for c in want.columns:
        x, y = (z[c].where(z[c].notna(), None).tolist() for z in (a, b))
        assert x == pytest.approx(y) if a[c].dtype.kind == "f" else x == y

