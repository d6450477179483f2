"""Pieces of a lower-casing tokenizer are put together from their runs; their ids are the library's, and few reach the library."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from quire.llm import encoding  # noqa: E402
from quire.llm.encoding import PieceEncoder  # noqa: E402

ODD = [
    "Don't I'LL we'Re 'Tis it's, 's 's' x's.y ..!?'s ''' '", "a\n\nB\tC 12a3 ÀÉß ÿŸ İI Σς ΑΣ, x×y÷z ªº µ ŉ é É", "\x0b\x0c a\x85b　c d 　 e",
    "<|endoftext|>x a<b>c </w> A ǅ ﬁ Ｆ", "   \n ", "", "Word, WORD (word) word! word-word Word.\nWord",
]


def library(encoder, text: str) -> bytes:
    return np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_are_the_librarys():
    encoder = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    for texts in (ODD, ODD[::-1]):
        assert encoder.encode(texts) == [library(encoder, x) for x in texts]


def test_forms_of_a_word_reach_the_library_once(monkeypatch):
    encoder, asked = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), False), []
    together = encoder._together
    monkeypatch.setattr(encoder, "_together", lambda pieces: asked.extend(pieces) or together(pieces))
    forms = [f"x {a}{w}{b}" for w in ("qualoria", "Qualoria", "QUALORIA") for a in ("", "(") for b in ("", ",", ".", "!\n")]
    assert encoder.encode(forms) == [library(encoder, x) for x in forms]
    assert sorted(asked) == ["!", "(", ",", ".", "qualoria"]


def test_other_tokenizers_keep_whole_pieces():
    assert not PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), True).in_runs


def test_cache_holds_runs_alone(monkeypatch):
    encoder = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    before, text = set(encoder.inner), "Qualoria, (QUALORIA) qualoria.\nVant-qualoria! 12's"
    monkeypatch.setattr(encoder, "_divided", lambda pieces: pytest.fail("runs are told by their last tokens"), raising=False)
    assert encoder.encode([text, "", text]) == [library(encoder, x) for x in (text, "", text)]
    assert set(encoder.inner) - before == {"qualoria", "vant", ",", "(", ")", ".", "-", "!", "'s"}


@pytest.mark.parametrize("full", (False, True))
def test_any_mix_of_characters(monkeypatch, full):
    """Plain and odd words in one batch and over batches, with and without room in the cache."""
    if full:
        monkeypatch.setattr(encoding, "CACHE_BYTES", 0)
    monkeypatch.setattr(encoding, "_PLACES", 7, raising=False)
    encoder, r = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), False), random.Random(4)
    signs = [*"abtzßéÉÑ019'’.,!<>/w", *" \n\t\r\x0b\x0c\0\x1c\x85\xa0　", *"µªİΣςДж日́²🙂", "'s", "'LL", "</w>", "the", "Station"]
    for n in (0, 1, 60):
        texts = ["".join(r.choices(signs, [4] * 20 + [3] * (len(signs) - 20), k=r.randrange(90))) for _ in range(n)]
        for texts in (texts, [x.replace("\0", "").encode("ascii", "ignore").decode() for x in texts]):
            assert encoder.encode(texts) == [library(encoder, x) for x in texts]
