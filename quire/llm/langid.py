"""Language identification by a bidirectional gated recurrent network over bytes.

A sequence is a word, or up to ``LONGEST`` bytes of one, so scripts without spaces are read in such parts.
Two gated recurrent layers read its bytes, one from each side, and every position gets
probabilities of the languages. A document's log probabilities are pooled over all of its positions.
The network is trained here, in numpy, by backpropagation through time, on a bounded sample of
labelled documents. Equal words get equal outputs, so a task runs the network once for each
distinct word and pools by counting.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, table

LONGEST = 48
HIDDEN = 24
#: Documents of each language in the training sample, on average.
PER_LANG = 250
CACHE = 300_000


def _cut(word: bytes) -> list[bytes]:
    """A word in parts of at most ``LONGEST`` bytes, none of which splits a character."""
    out, at = [], 0
    while at < len(word):
        to = min(at + LONGEST, len(word))
        while to < len(word) and word[to] & 0xC0 == 0x80:
            to -= 1
        out.append(word[at:to])
        at = to
    return out


def pieces(text: bytes) -> list[bytes]:
    """The sequences of a text: its words, long ones cut between characters. Together they hold every byte but white space."""
    words = text.split()
    if all(len(w) <= LONGEST for w in words):
        return words
    return [part for w in words for part in (_cut(w) if len(w) > LONGEST else [w])]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Gru:
    """One direction: input rows by byte, hidden-to-hidden weights, bias of the candidate."""

    def __init__(self, rng: np.random.Generator | None, hidden: int):
        self.h = hidden
        if rng is not None:
            self.x = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.u = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
            self.c = np.zeros(hidden, np.float32)

    def run(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States [steps, words, hidden] of codes [words, steps]."""
        n, steps, h = len(codes), codes.shape[1], self.h
        state, out = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32)
        for t in range(steps):
            x, s = self.x[codes[:, t]], state @ self.u
            gates = _sigmoid(x[:, : 2 * h] + s[:, : 2 * h])
            z, r, inner = gates[:, :h], gates[:, h:], s[:, 2 * h :] + self.c
            new = np.tanh(x[:, 2 * h :] + r * inner)
            if keep is not None:
                keep.append((state, z, r, inner, new))
            out[t] = state = new + z * (state - new)
        return out

    def back(self, codes: np.ndarray, keep: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of x, u, c from those of the states, through time."""
        h = self.h
        gx, gu, gc, carry = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(self.c), 0
        for t in range(codes.shape[1] - 1, -1, -1):
            state, z, r, inner, new = keep[t]
            g = grad[t] + carry
            pre = g * (1 - z) * (1 - new * new)
            parts = np.concatenate([g * (state - new) * z * (1 - z), pre * inner * r * (1 - r), pre], 1)
            np.add.at(gx, codes[:, t], parts)
            parts[:, 2 * h :] *= r
            gc += parts[:, 2 * h :].sum(0)
            gu += state.T @ parts
            carry = g * z + parts @ self.u.T
        return [gx, gu, gc]


class Tagger:
    """The whole network, with its languages."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.sides = langs, [Gru(rng, hidden), Gru(rng, hidden)]
        self.w = rng.normal(0, 0.1, (2 * hidden, len(langs))).astype(np.float32)
        self.b = np.zeros(len(langs), np.float32)

    def params(self) -> list[np.ndarray]:
        return [p for g in self.sides for p in (g.x, g.u, g.c)] + [self.w, self.b]

    def positions(self, codes: np.ndarray, keep: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States and log probabilities [words, steps, languages] of every position."""
        there = self.sides[0].run(codes, keep and keep[0])
        back = self.sides[1].run(codes[:, ::-1], keep and keep[1])[::-1]
        states = np.concatenate([there, back], 2).transpose(1, 0, 2)
        out = states @ self.w + self.b
        out -= out.max(2, keepdims=True)
        return states, out - np.log(np.exp(out).sum(2, keepdims=True))

    def step(self, codes: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of one batch of words of one length."""
        keep: tuple[list, list] = ([], [])
        states, logp = self.positions(codes, keep)
        n, steps = codes.shape
        g = np.exp(logp)
        g[np.arange(n)[:, None], np.arange(steps), target[:, None]] -= 1
        g /= n * steps
        loss = -float(logp[np.arange(n), :, target].mean())
        flat = g.reshape(n * steps, -1)
        gw, gb, gs = states.reshape(n * steps, -1).T @ flat, flat.sum(0), (g @ self.w.T).transpose(1, 0, 2)
        h = self.sides[0].h
        return loss, self.sides[0].back(codes, keep[0], gs[:, :, :h]) + self.sides[1].back(codes[:, ::-1], keep[1], gs[::-1, :, h:]) + [gw, gb]

    def sums(self, words: list[bytes]) -> np.ndarray:
        """For each word, its positions' log probabilities and probabilities, summed: [words, 2 languages]."""
        out = np.empty((len(words), 2 * len(self.langs)), np.float32)
        by = defaultdict(list)
        for i, w in enumerate(words):
            by[len(w)].append(i)
        for size, at in by.items():
            for k in range(0, len(at), 2048):
                own = at[k : k + 2048]
                codes = np.frombuffer(b"".join([words[i] for i in own]), np.uint8).reshape(-1, size)
                logp = self.positions(codes)[1]
                out[own] = np.concatenate([logp.sum(1), np.exp(logp).sum(1)], 1)
        return out


def train(texts: list[str], langs: list[str], steps: int = 900, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Tagger:
    """Fit the network to labelled texts: whole texts, each word by the square root of its count."""
    names = sorted(set(langs))
    counts: Counter = Counter()
    for text, lang in zip(texts, langs):
        at = names.index(lang)
        counts.update((w, at) for w in pieces(text.encode()))
    by = defaultdict(list)
    for (word, at), n in sorted(counts.items()):
        by[len(word)].append((word, at, n**0.5))
    model, rng = Tagger(names, seed=seed), np.random.default_rng(seed)
    if not by:
        return model
    sizes = sorted(by)
    groups = {}
    for size in sizes:
        words, at, weight = zip(*by[size])
        weight = np.array(weight)
        groups[size] = (np.frombuffer(b"".join(words), np.uint8).reshape(-1, size), np.array(at), np.cumsum(weight) / weight.sum(), weight.sum())
    odds = np.array([groups[s][3] for s in sizes])
    odds /= odds.sum()
    first, second = ([np.zeros_like(p) for p in model.params()] for _ in range(2))
    for k in range(1, steps + 1):
        codes, at, up_to, _ = groups[sizes[int(rng.choice(len(sizes), p=odds))]]
        own = np.minimum(np.searchsorted(up_to, rng.random(batch)), len(at) - 1)
        _, grads = model.step(codes[own], at[own])
        now = rate * min(1, k / 50) * (1 - 0.95 * k / steps)
        for p, g, m, v in zip(model.params(), grads, first, second):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= now * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return model


def held_out(key: str = "doc_id"):
    """Whether the remainder of the id's CRC-32 is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Tagger:
    """Train on about ``per_lang`` whole documents of each language, drawn by a hash of the id.

    Held-out documents, and those without id, text or language, are never drawn. Only the sample
    and one count for each language come to the driver.
    """
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(~held_out("k")).dropna()
    counts = dict(own.groupBy("l").count().collect())
    if not counts:
        return Tagger([])
    share = F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(1.0, per_lang / n))])[F.col("l")]
    drawn = own.filter((F.pmod(F.xxhash64("k"), F.lit(1 << 32)) / float(1 << 32)) < share).toPandas().sort_values(["k", "t"])
    return train(list(drawn.t), list(drawn.l))


def _predictions(model: Tagger):
    """Batches (row, text) to (row, language, score)."""
    n = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        rows = np.empty((CACHE, 2 * n), np.float32)
        for batch in slices(batches, 256):
            lang, score = [], []
            texts = batch.column(1).to_pylist()
            usable = [bool(n) and x is not None and any(map(str.isalpha, x)) for x in texts]
            words = [pieces(x.encode()) if ok else [] for x, ok in zip(texts, usable)]
            new = list({w for own in words for w in own if w not in index})
            extra, known = model.sums(new) if new else np.empty((0, 2 * n), np.float32), len(index)
            free = min(len(new), CACHE - known)
            rows[known : known + free] = extra[:free]
            index.update(zip(new[:free], range(known, known + free)))
            late = dict(zip(new[free:], range(free, len(new))))
            for own, ok in zip(words, usable):
                if not ok:
                    lang.append("und")
                    score.append(0.0)
                    continue
                if late:
                    total = np.zeros(2 * n)
                    at = [index.get(w, -1) for w in own]
                    total += rows[[i for i in at if i >= 0]].sum(0, dtype=np.float64)
                    total += extra[[late[w] for w, i in zip(own, at) if i < 0]].sum(0, dtype=np.float64)
                else:
                    total = rows[list(map(index.__getitem__, own))].sum(0, dtype=np.float64)
                best = int(np.argmax(total[:n]))
                lang.append(model.langs[best])
                score.append(min(1.0, max(0.0, float(total[n + best]) / sum(map(len, own)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Tagger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, lang_pred, score)``: each row of ``docs`` as a struct, its language, and the mean probability of that language.

    Only the text is read. ``und`` with score zero where the text is null or has no letter,
    or no language is known. Other columns pass through in ``row``. Rows do not meet, so null and repeated ids change nothing; whole
    texts are read, however long, and a task holds the outputs of ``CACHE`` words. Equal scores go to the first language by name.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return mapped(own, _predictions(model), f"row {own.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def op5(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by a network trained on those that are not held out; nulls and long texts as ``predict`` states."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """The documents whose language is told with a mean probability of ``least`` or more."""
    out = predict(docs, fit(docs))
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
