"""Extra columns with clashing names, long texts, repeated rows and ties, for the operators and the pipeline's stages."""

import datetime
import hashlib
from zlib import crc32

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from quire.llm import dac, graph_ann, langid, licenses, packing, pii, simhash, spotsigs, suffix_pieces, superkmer  # noqa: E402

CLASH = ["row", "fp", "set", "tie", "spans", "__id", "__none", "__tie", "masked", "digest", "license", "lang_pred", "kept", "bucket", "key", "piece", "sigs", "range", "text_a", "n_pii"]
LONG = " ".join(f"word{i % 977} and the {i * 7919 % 1009}" for i in range(40_000))
ROWS = [(1, "the river and the stone", "en"), (2, LONG, "en"), (2, LONG, "en"), (3, None, "en"), (None, "", None), (None, "le vent est dans la maison", "fr"), (4, "le vent est dans la maison", "fr"), (5, "call 212-555-0187 or a.b@c.org", "en"), (6, "x" * 200_000, "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b, c, "s", len(b or "")) for a, b, c in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASH])


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("name", ("op1", "op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10"))
def test_other_columns_play_no_part(docs, clashing, name):
    run = {
        "op1": lambda d: simhash.near_duplicates(d),
        "op2": lambda d: suffix_pieces.encode(d, public.path("piece_bpe_32k.model")).select("doc_id", "ids", F.expr("decoded <=> coalesce(text, '')")),
        "op4": lambda d: packing.pack(d.repartition(1), public.path("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")),
        "op5": lambda d: langid.predict(d, langid.train(["the river and", "le vent dans"], ["en", "fr"], 20)).select("row.doc_id", "lang_pred", "score"),
        "op6": lambda d: superkmer.remove_repeats(d).select("row.doc_id", "n_words", "n_removed", F.md5("kept")),
        "op7": lambda d: spotsigs.with_next(d).select("doc_id", F.md5("text"), spotsigs.digest(F.col("sigs"))),
        "op8": lambda d: licenses.scan(d, licenses.known_licenses(d.sparkSession)),
        "op9": lambda d: dac.read_ids(dac.write_ids(d, public.path("word_bpe_49k.json"))),
        "op10": lambda d: pii.mask(d, "k").select("doc_id", F.md5("text"), "n_pii"),
    }[name]
    got = rows(run(docs))
    assert got == rows(run(clashing))
    if name not in ("op4",):
        assert len(got) == len(ROWS)
    if name == "op2":
        assert all(r[2] for r in got)


def test_stages_keep_foreign_columns(clashing):
    for stage in (langid.with_language, simhash.one_of_each, superkmer.without_repeats, pii.without_private):
        out = stage(clashing)
        assert out.columns == clashing.columns and out.dtypes == clashing.dtypes
        kept = out.collect()
        assert kept and all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in kept for c in CLASH)
    found = pii.without_private(clashing).filter("doc_id = 5").first()
    assert "555-0187" not in found.text and found.n_chars == len(found.text)


def test_long_and_repeated_rows_of_ids(docs):
    """Starts, counts and checksums of every document, by the library, in order; null and repeated ids, null and long texts."""
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library, at, want = Tokenizer.from_file(path), 0, []
    order = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).orderBy(F.col("doc_id").asc_nulls_first(), "tie").collect()
    for r in order:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, at, len(ids), crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in dac.read_ids(dac.write_ids(docs, path)).collect()), key=lambda r: r[1]) == want


def test_language_pieces_hold_whole_characters():
    text = ("日本語" * 40 + " é" * 3 + " " + "x" * 120).encode()
    parts = langid.pieces(text)
    assert b"".join(parts) == b"".join(text.split()) and all(len(p) <= langid.LONGEST and p.decode() for p in parts)


@pytest.mark.parametrize("scale", (1e200, 1e-200, 1.0))
def test_nearest_of_any_size_and_length(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)).round(3)
    rows_ = [(i, (v * (scale if i % 2 else 1.0)).tolist()) for i, v in enumerate(x)] + [(900, [1.0, 1.0]), (901, [scale, 2 * scale]), (902, [3.0, 1.0]), (903, [0.0, 0.0]), (904, [float("nan"), 1.0]), (905, None), (906, []), (907, [1.0])]
    frame = spark.createDataFrame(rows_, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "salt", "ids", "shard", "dims", "query")})
    got = graph_ann.nearest(frame, frame.filter("vec_id % 50 = 0 OR vec_id >= 900"), shard=128).collect()
    assert all(np.isfinite(r.score) and -1 <= r.score <= 1 for r in got)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 300, 50):
        want = sorted(((-float(unit[q] @ unit[i]), i) for i in range(300) if i != q))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hits += len({m[1] for m in mine} & {i for _, i in want})
    assert hits >= 27
    short = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got if r.query_id >= 900)
    c = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    a, b, d = c([1, 1], [1, 2]), c([1, 1], [3, 1]), c([1, 2], [3, 1])
    assert short == [(900, 1, 901, a), (900, 2, 902, b), (901, 1, 900, a), (901, 2, 902, d), (902, 1, 900, b), (902, 2, 901, d)]


def digest_number(*parts):
    return int(hashlib.sha256("|".join(str(p) for p in parts).encode()).hexdigest()[:15], 16)


def feistel(kind, left, right, a, b, key="k"):
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            left = (left + digest_number(key, kind, i, a, b, right) % a) % a
        else:
            right = (right + digest_number(key, kind, i, a, b, left) % b) % b
    return left, right


def check_digit(payload):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str((10 - total % 10) % 10)


def test_pseudonyms_equal_a_plain_version(spark):
    card, phone, ssn, ip, date, mail = "4111111111111111", "212-555-0187", "123-45-6789", "70.1.2.3", "2024-02-29", "A.b@c.org"
    l, r = feistel("card", int(card[:7]), int(card[7:15]), 10**7, 10**8)  # noqa: E741
    payload = f"{l:07d}{r:08d}"
    want = {card: payload + check_digit(payload)}
    l, r = feistel("phone", 212 - 200, 5550187 - 2000000, 800, 8000000)  # noqa: E741
    want[phone] = f"{l + 200}-{str(r + 2000000)[:3]}-{str(r + 2000000)[3:]}"
    l, r = feistel("ssn", 122, 44 * 9999 + 6788, 898, 99 * 9999)  # noqa: E741
    want[ssn] = f"{l + (2 if l >= 665 else 1):03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"
    l, r = feistel("ip", 70 * 256 + 1, 2 * 256 + 3, 65536, 65536)  # noqa: E741
    want[ip] = f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
    first = datetime.date(1900, 1, 1)
    day, days = (datetime.date(2024, 2, 29) - first).days, (datetime.date(2100, 1, 1) - first).days
    while True:
        l, r = feistel("date", day // 261, day % 261, 280, 261)  # noqa: E741
        day = l * 261 + r
        if day < days:
            break
    want[date] = (first + datetime.timedelta(day)).isoformat()
    want[mail] = "u" + hashlib.sha256(f"k|email|{mail.lower()}".encode()).hexdigest()[:32] + "@example.invalid"
    frame = spark.createDataFrame(list(want.items()), "text string, want string")
    for x in pii.mask(frame, "k").collect():
        assert x.text == x.want and x.n_pii == 1


def test_phones_stay_in_their_format(spark):
    frame = spark.createDataFrame([(f"{200 + 13 * i % 800}-{200 + 7 * i % 800:03d}-{i:04d}",) for i in range(300)], "text string")
    out = [r.text for r in pii.mask(frame, "k").collect()]
    assert len(set(out)) == 300 and all(x[0] in "23456789" and x[4] in "23456789" and len(x) == 12 for x in out)


def test_recall_on_the_given_vectors(spark):
    """The query's rows against brute force in double precision, on all vectors of a table."""
    path = "/root/testdata/sf0.01"
    rows_ = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows_ = [(i, v) for i, v in rows_ if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([i for i, _ in rows_]), np.array([v for _, v in rows_], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in graph_ann.op3(spark, path).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for q in got:
        near = unit @ unit[np.flatnonzero(ids == q)[0]]
        near[ids == q] = -9
        best = np.lexsort((ids, -near))[:5]
        hits += len(set(ids[best].tolist()) & set(got[q]))
        total += 5
        assert all(abs(s - near[np.flatnonzero(ids == i)].max()) < 1e-9 for i, s in got[q].items())
    assert total == 5 * len(set(ids[ids % 50 == 0].tolist())) and hits >= 0.9 * total
