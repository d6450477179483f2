"""Long words without spaces, and rows of the sf0.001 table, against the library."""

import random
import time

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
from quire.llm import suffix_pieces  # noqa: E402


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    return suffix_pieces.encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_long_words_equal_library(both, monkeypatch):
    own, library = both
    r = random.Random(1)
    words = ["the", "ing", "station", "x", "é", "日", "☃", "qu", "zz", "1234", "\0"]
    texts = ["".join(r.choice(words) for _ in range(k)) for k in (100, 300, 900)] + ["a" * 700, "ab c" + "de" * 400]
    want = [library.encode(x) for x in texts]
    assert [ids(x) for x in own.encode(texts)] == want
    monkeypatch.setattr(suffix_pieces, "TOGETHER", 97)
    assert [ids(x) for x in own.encode(texts)] == want


def test_a_megabyte_without_spaces_is_quick(both):
    own, library = both
    r = random.Random(2)
    text = "".join(r.choice("etaoinshrdlucmfw") for _ in range(1_000_000))
    began = time.process_time()
    got = own.encode([text])[0]
    assert time.process_time() - began < 20
    assert own.decode(got) == text
    assert ids(own.encode([text[:20_000]])[0]) == library.encode(text[:20_000])


def test_rows_equal_library(both, spark):
    own, library = both
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert [ids(x) for x in own.encode(texts)] == [library.encode(x) if x else [] for x in texts]
