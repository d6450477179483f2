"""Predictions of the byte network against a plain version: one position at a time, no cache, no batches of words."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import langid


def plain_states(side, codes):
    """A gated recurrent unit in double precision, a byte at a time."""
    h, x, u, c = side.h, side.x.astype(float), side.u.astype(float), side.c.astype(float)
    state, out = np.zeros(h), []
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for code in codes:
        s = state @ u
        z, r = sigmoid(x[code, :h] + s[:h]), sigmoid(x[code, h : 2 * h] + s[h : 2 * h])
        new = np.tanh(x[code, 2 * h :] + r * (s[2 * h :] + c))
        state = (1 - z) * new + z * state
        out.append(state)
    return out


def plain_prediction(model, text):
    if text is None or not any(ch.isalpha() for ch in text):
        return "und", 0.0
    n = len(model.langs)
    logs, probs, size = np.zeros(n), np.zeros(n), 0
    for piece in langid.pieces(text.encode()):
        there, back = plain_states(model.sides[0], piece), plain_states(model.sides[1], piece[::-1])[::-1]
        for a, b in zip(there, back):
            out = np.concatenate([a, b]) @ model.w.astype(float) + model.b.astype(float)
            p = np.exp(out - out.max())
            p /= p.sum()
            logs, probs, size = logs + np.log(p), probs + p, size + 1
    best = int(np.argmax(logs))
    return model.langs[best], float(probs[best] / size)


@pytest.mark.parametrize("cache", [4, 300_000])
def test_predictions_equal_the_plain_version(monkeypatch, cache):
    monkeypatch.setattr(langid, "CACHE", cache)
    en, fr, de = "the river and the stone by the old house", "le vent est dans la maison de pierre", "der fluss und das licht auf dem stein"
    model = langid.train([en, fr, de], ["en", "fr", "de"], 60)
    r = random.Random(3)
    words = (en + " " + fr + " " + de).split()
    texts = [None, "", "123 ?!", en, fr, de, "été à Zürich", "漢字" * 60, "x" * 200, "Ünß" + "é" * 70 + " the"] + [" ".join(r.choices(words, k=r.randint(1, 40))) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["row", "text"])
    got = [(row["lang_pred"], row["score"]) for out in langid._predictions(model)(iter([batch.slice(0, 20), batch.slice(20)])) for row in out.to_pylist()]
    want = [plain_prediction(model, t) for t in texts]
    assert len(got) == len(want) and len({x[0] for x in want}) == 4
    for t, a, b in zip(texts, got, want):
        assert a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=2e-4), (t, a, b)
