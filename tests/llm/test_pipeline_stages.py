"""The whole pipeline against plain versions of its stages, each on its own input."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

EN = "the river stone and light of a moon grass to in wind door house that is tree was with for".split()
FR = "le vent est dans la maison et une porte sur des pierre avec pour qui les arbre lune au du".split()


def fixture():
    r = random.Random(11)
    some = lambda words, n: " ".join(r.choice(words) + r.choice(["", "", "s", "er"]) for _ in range(n))
    passage = some(EN, 60)
    rows = [(i, some(EN if i % 2 else FR, r.randint(30, 200)), "en" if i % 2 else "fr") for i in range(60)]
    rows += [(60 + i, rows[i][1] + " more", rows[i][2]) for i in range(0, 12, 3)] + [(70, rows[1][1], "en"), (71, rows[1][1].upper(), "en")]
    rows += [(80 + i, some(EN, 40) + " " + passage + " " + some(EN, 40), "en") for i in range(4)]
    rows += [(90, some(EN, 50) + " Write.Me@Example.org " + some(EN, 20), "en"), (91, "123 456", None), (92, None, None), (None, some(EN, 45), "en"), (None, some(FR, 45), "fr"), (3, some(EN, 33), "en")]
    return [(a, b, c, "s", len(b or "")) for a, b, c in rows]


def shingles(text):
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each(rows):
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (not union or len(sets[i] & sets[j]) * 5 >= union * 4) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return [[r for r, h in zip(rows, group) if h == g] for g in sorted(set(group))]


def without_repeats(rows, width=35):
    seen = {}
    words = [r[1].split() for r in rows]
    for d, w in enumerate(words):
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i : i + width]), []).append((d, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        for d, i in places if len(places) > 1 else ():
            gone[d].update(range(i, i + width))
    return [" ".join(x for i, x in enumerate(w) if i not in gone[d]) if gone[d] else r[1] for d, (w, r) in enumerate(zip(words, rows))]


def test_stages_equal_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    frame = spark.createDataFrame(fixture(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    now, outs = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        outs.append([tuple(r) for r in now.collect()])
        assert k == 4 or now.columns == frame.columns
    told, single, cut, private, packed = outs
    assert {r[0] for r in fixture()} - {r[0] for r in told} == {91, 92}
    groups = one_of_each(told)
    assert len(single) == len(groups) and all(sum(r in single for r in g) == 1 for g in groups)
    least = {min((r[0] is None, r[0] or 0) for r in g) for g in groups}
    assert {(r[0] is None, r[0] or 0) for r in single} == least
    by = sorted(single, key=repr)
    want = sorted(((r[0], t, r[2], r[3], len(t)) for r, t in zip(by, without_repeats(by))), key=repr)
    assert sorted(cut, key=repr) == want
    mail = "u" + hashlib.sha256(b"quire-demo-key|email|write.me@example.org").hexdigest()[:32] + "@example.invalid"
    hidden = [(r[0], t := r[1].replace("Write.Me@Example.org", mail), r[2], r[3], len(t)) for r in cut]
    assert sorted(private, key=repr) == sorted(hidden, key=repr) and any(mail in r[1] for r in private)
    library, texts = Tokenizer.from_file(public.path("byte_bpe_50k.json")), {}
    for r in private:
        texts.setdefault(r[0], []).append(np.array([*library.encode(r[1], add_special_tokens=False).ids, 1], "<u4"))
    pieces, fills = {}, {}
    for doc, start, length, crc, total, sequence, offset in packed:
        pieces.setdefault(doc, []).append((start, length, crc, total))
        fills.setdefault(sequence, []).append((offset, length))
    for doc, found in texts.items():
        if len(found) == 1:
            at = 0
            for start, length, crc, total in sorted(pieces[doc]):
                assert start == at and total == len(found[0]) and crc == crc32(found[0][start : start + length].tobytes())
                at += length
            assert at == len(found[0])
        assert sum(p[1] for p in pieces[doc]) == sum(map(len, found))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(map(repr, (tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))) == sorted(repr(p[:5]) for p in packed)
