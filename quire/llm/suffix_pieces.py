"""SentencePiece encoding by suffix-array matching, and decoding.

The words of a batch of texts that the worker has not met yet are concatenated, and the suffixes of that
text are sorted as far as the longest piece reaches. Each piece of the model finds its occurrences as one
range of that array by binary search. The occurrences are edges from a start to
an end; sorted by position they are relaxed in one sweep over the ends.

The model merges by rank, so an edge is taken if the edge that ends where it starts may stand
before it: if merging by rank leaves the two pieces apart. Of the edges into one
position exactly one passes, so the sweep gives the same ids as the merges. Pieces hold the space mark
only in front; a text may therefore be cut before a mark that follows another character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, mapped, public_tokenizer, slices, table
from .encoding import CACHE_BYTES, drop, weight

MARK = "▁"
#: Characters that are indexed together.
TOGETHER = 400_000
#: Characters of a word beyond which it is relaxed alone and not kept.
LONG = 256
_CUT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NONE = 1 << 30
#: Pairs of pieces whose verdict a worker keeps.
PAIRS = 250_000


@dataclass
class Model:
    """Pieces by id, merge ranks, and for each piece the two that its last merge joined."""

    pieces: list[str]
    usable: np.ndarray
    rank: np.ndarray
    split: np.ndarray
    byte_ids: np.ndarray

    def __post_init__(self):
        self.unknown = len(self.pieces)


def merged(text: str, ids: dict[str, int], rank: list[int]) -> tuple[list[int], tuple[int, int]]:
    """Merge the characters of ``text`` by rank, leftmost first; the ids, and the last pair merged."""
    parts, last = [ids[c] for c in text], (-1, -1)
    words = list(text)
    while True:
        best, at = _NONE, -1
        for i in range(len(words) - 1):
            to = ids.get(words[i] + words[i + 1])
            if to is not None and rank[to] < best:
                best, at = rank[to], i
        if at < 0:
            return parts, last
        last = (parts[at], parts[at + 1])
        words[at : at + 2] = [words[at] + words[at + 1]]
        parts[at : at + 2] = [ids[words[at]]]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    """Read a model that merges by rank, has byte pieces and leaves texts as they are but for a space in front."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    n = proto.normalizer_spec
    if proto.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
        raise ValueError("this kind of model is not supported")
    pieces = [p.piece for p in proto.pieces]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("pieces with an inner space mark are not supported")
    kinds = [p.type for p in proto.pieces]
    order = sorted((i for i, k in enumerate(kinds) if k == 1), key=lambda i: -proto.pieces[i].score)
    rank = [_NONE] * len(pieces)
    for r, i in enumerate(order):
        rank[i] = r
    ids = {pieces[i]: i for i in order}
    split, usable = np.full((len(pieces) + 1, 2), -1, np.int32), np.zeros(len(pieces), bool)
    for i in order:
        if len(pieces[i]) == 1:
            usable[i] = True
        elif all(c in ids for c in pieces[i]):
            got, last = merged(pieces[i], ids, rank)
            if got == [i]:
                split[i], usable[i] = last, True
    bytes_ = np.array([i for i, k in enumerate(kinds) if k == 6])
    return Model(pieces, usable, np.array([*rank, _NONE]), split, bytes_)


class Encoder:
    """Encodes and decodes texts with one model; holds the alphabet, the sorted pieces and caches."""

    def __init__(self, model: Model):
        self.m = model
        own = np.flatnonzero(model.usable)
        self.alphabet = np.array(sorted({ord(c) for i in own for c in model.pieces[i]}), np.int64)
        self.longest = max(len(model.pieces[i]) for i in own)
        self.ids, self.sizes = own, np.array([len(model.pieces[i]) for i in own])
        self.low = self._keys([model.pieces[i] for i in own], b"\0\0")
        self.high = self._keys([model.pieces[i] for i in own], b"\xff\xff")
        self.joins = {model.pieces[i]: i for i in own}
        self.pairs: dict[int, bool] = {}  # at most PAIRS, then begun anew
        self.known: dict[str, bytes] = {}
        self.size = 0
        spelled = [p.encode().replace(MARK.encode(), b" ") for p in model.pieces]
        for b, i in enumerate(model.byte_ids):
            spelled[i] = bytes([b])
        spelled[1] = spelled[2] = b""
        self.spelled, self.widths = np.frombuffer(b"".join(spelled), np.uint8), np.fromiter(map(len, spelled), np.int32, len(spelled))
        self.places = np.cumsum(self.widths, dtype=np.int32) - self.widths

    def _codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, np.where(points == 0, 0, len(self.alphabet) + 1)).astype(">u2")

    def _keys(self, pieces: list[str], fill: bytes) -> np.ndarray:
        width = 2 * self.longest
        return np.array([(self._codes(p).tobytes() + fill * self.longest)[:width] for p in pieces], f"S{width}")

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves these two pieces side by side."""
        rank, split, pieces, limit = self.m.rank, self.m.split, self.m.pieces, (_NONE, 0)
        while True:
            to = self.joins.get(pieces[a] + pieces[b])
            if to is not None and (rank[to], 0) < limit:
                return False
            left, right = split[a][0] >= 0, split[b][0] >= 0
            if not left and not right:
                return True
            # undo the later of the two merges; the left one comes first among equals
            if left and (not right or rank[a] > rank[b]):
                limit, a = (rank[a], 0), int(split[a][1])
            else:
                limit, b = (rank[b], 1), int(split[b][0])

    def _passes(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        out = (before < 0) | (before == self.m.unknown) | (after == self.m.unknown)
        ask = np.flatnonzero(~out)
        key, back = np.unique(before[ask].astype(np.int64) << 32 | after[ask], return_inverse=True)
        known, keys = self.pairs, key.tolist()
        if len(known) > PAIRS:
            known.clear()
        for k in [k for k, got in zip(keys, map(known.get, keys)) if got is None]:
            known[k] = self._apart(k >> 32, k & 0xFFFFFFFF)
        out[ask] = np.fromiter(map(known.__getitem__, keys), bool, len(keys))[back]
        return out

    def _edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, piece, end) of every occurrence of a piece in the text, and of characters that no piece has."""
        codes = self._codes(text + "\0" * self.longest)
        n = len(codes) - self.longest + 1
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, self.longest)[:n]).view(f"S{2 * self.longest}").ravel()
        array = np.argsort(suffixes, kind="stable")
        ranked = suffixes[array]
        lo, hi = np.searchsorted(ranked, self.low), np.searchsorted(ranked, self.high)
        counts = hi - lo
        at = array[np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - lo, counts)]
        unknown = np.flatnonzero(codes[:n] == len(self.alphabet) + 1)
        starts = np.concatenate([at, unknown])
        piece = np.concatenate([np.repeat(self.ids, counts), np.full(len(unknown), self.m.unknown)])
        return starts, piece, np.concatenate([at + np.repeat(self.sizes, counts), unknown + 1])

    def _long(self, word: str) -> bytes:
        """Ids of one long word, indexed ``TOGETHER`` characters at a time; edges are relaxed one by one, sorted by their ends."""
        n, reach, unknown, known = len(word), self.longest, self.m.unknown, self.pairs
        text = word.replace("\0", "\U0010ffff")
        piece_to, size_to = np.full(n + 1, -2, np.int32), np.zeros(n + 1, np.int32)
        piece_to[0] = -1
        for at in range(0, n, TOGETHER):
            starts, piece, ends = self._edges(text[at : at + TOGETHER + reach - 1])
            own = np.flatnonzero((starts < TOGETHER) & (at + ends <= n))
            own = own[np.argsort(ends[own], kind="stable")]
            best, size = piece_to[at : at + TOGETHER + reach].tolist(), size_to[at : at + TOGETHER + reach].tolist()
            for s, p, e in zip(starts[own].tolist(), piece[own].tolist(), ends[own].tolist()):
                b = best[s]
                if b == -2:
                    continue
                if b >= 0 and b != unknown and p != unknown:
                    key = b << 32 | p
                    apart = known.get(key)
                    if apart is None:
                        if len(known) > PAIRS:
                            known.clear()
                        apart = known[key] = self._apart(b, p)
                    if not apart:
                        continue
                best[e], size[e] = p, e - s
            piece_to[at : at + TOGETHER + reach], size_to[at : at + TOGETHER + reach] = best, size
        found, at = [], n
        while at > 0:
            p, width = int(piece_to[at]), int(size_to[at])
            found += [p] if p != unknown else self.m.byte_ids[list(word[at - 1].encode())].tolist()[::-1]
            at -= width
        return np.array(found[::-1], "<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, all indexed together."""
        text = "\0".join(w.replace("\0", "\U0010ffff") for w in words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first, n = np.cumsum(sizes + 1) - sizes - 1, len(text) + 1
        starts, piece, ends = self._edges(text)
        word = np.searchsorted(first, starts, side="right") - 1
        reach = ends - first[word]
        order = np.argsort(reach, kind="stable")
        starts, piece, ends, reach, word = starts[order], piece[order], ends[order], reach[order], word[order]
        best, back = np.full(n + 1, -2, np.int64), np.zeros(n + 1, np.int64)
        best[first] = -1
        cuts = np.r_[0, np.flatnonzero(np.diff(reach)) + 1, len(reach)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            before = best[starts[a:b]]
            good = before > -2
            good[good] = self._passes(before[good], piece[a:b][good])
            best[ends[a:b][good]] = piece[a:b][good]
            back[ends[a:b][good]] = starts[a:b][good]
        on, at = np.zeros(n + 1, bool), first + sizes
        at = at[sizes > 0]
        while len(at):
            on[at] = True
            at = back[at]
            at = at[best[at] >= 0]
        path = np.flatnonzero(on)
        ids, of = best[path], np.searchsorted(first, path - 1, side="right") - 1
        to = np.cumsum(np.bincount(of, minlength=len(words))) * 4
        raw, ends = ids.astype("<u4").tobytes(), to.tolist()
        out = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        for k in np.unique(of[ids == self.m.unknown]).tolist():
            at, own = slice(ends[k - 1] // 4 if k else 0, ends[k] // 4), []
            for e, t in zip(path[at].tolist(), ids[at].tolist()):
                own += self.m.byte_ids[list(words[k][e - 1 - int(first[k])].encode())].tolist() if t == self.m.unknown else [t]
            out[k] = np.array(own, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [_CUT.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        known = self.known
        new = sorted(set().union(*cut).difference(known))
        long = {w: self._long(w) for w in new if len(w) > LONG}
        new = [w for w in new if len(w) <= LONG]
        now: dict[str, bytes] = {}
        group, size = [], 0
        for w in [*new, None]:
            if group and (w is None or size + len(w) > TOGETHER):
                now.update(zip(group, self._words(group)))
                group, size = [], 0
            if w is not None:
                group.append(w)
                size += len(w) + 1
        known.update(now)
        known.update(long)
        out = [b"".join(map(known.__getitem__, own)) for own in cut]
        drop(known, long)
        if self.size < CACHE_BYTES:
            self.size += weight(now)
        else:
            drop(known, now)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of these ids: pieces joined, marks as spaces, the space in front dropped."""
        out = []
        for at in range(0, len(ids), 4 * TOGETHER):
            own = np.frombuffer(ids[at : at + 4 * TOGETHER], "<u4")
            widths = self.widths[own]
            ends = np.cumsum(widths, dtype=np.int32)
            take = np.arange(ends[-1], dtype=np.int32) + np.repeat(self.places[own] - ends + widths, widths)
            out.append(self.spelled[take].tobytes())
        return b"".join(out).decode("utf-8", "replace").removeprefix(" ")


def encoder(path: str) -> Encoder:
    """The worker's encoder of this model."""
    return held(("pieces", path), lambda: Encoder(load(path)))


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, ids, decoded)`` of every row: ids as little-endian unsigned 32-bit binary, and their text again.

    A null text counts as empty and has no ids. Repeated rows and null ids stay; other columns
    play no part. Texts are whole, however long; a word without spaces takes about 30 bytes of memory a character. ``decoded`` equals the text unless it holds the space mark itself, which reads as a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in slices(batches, 2048):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = own.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())], ["doc_id", "text", "ids", "decoded"])

    return mapped(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, "doc_id bigint, text string, ids binary, decoded string")


def op2(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """Ids of all documents and what they decode to; nulls, repeated rows and long texts as ``encode`` states."""
    out = encode(table(spark, sf_dir, "documents"), model or public_tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))
