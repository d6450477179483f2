"""Token ids of whole texts by the tokenizers library, with a word cache per Python worker.

Public BPE tokenizers cut a text before a space that stands between two other
characters, whatever else the text holds, so the ids of a text are those of its pieces.
Texts repeat their words, so each worker keeps the ids of the pieces it has met, up to
``CACHE_BYTES``; further ones are encoded as they come. New pieces are encoded many at a
time, set apart by a word that is one token: where it is counted too often,
the pieces are encoded one by one. Where the tokenizer lower-cases and cuts letters, digits and
marks apart, the cache holds the ids of such runs ("word" and "," of "Word,"), which repeat far more often: Arrow finds
the distinct words of a batch, these are cut into runs, and their ids are dealt out to all places of a word at once.
New runs skip the steps that they have behind them; each ends with the only token that ends a word.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import chunked, held

#: Bytes of a worker's cache, and what an entry takes besides its piece and ids.
CACHE_BYTES, ENTRY = 140 << 20, 170
_TOGETHER = 64
#: Places of words that get their ids at a time.
_PLACES = 1 << 17
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: The steps of a tokenizer whose ids of a text are those of its runs.
_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Words that are cut into runs here: letters that are one letter in lower case and normal form, digits, ASCII marks.
#: Words with anything else ("odd" ones) go to the tokenizer whole.
_ODD = re.compile(r"[^A-Za-zÀ-ÖØ-öø-ÿ!-@\[-`{-~\n]")
_RUNS = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+|[\n\0]")
_LONE = "0123456789abcdefghijklmnopqrstuvwxyz"


def _runs(words: list[str]) -> list[str]:
    """The runs of all words, a line end after those of each word; an odd word is a run."""
    text = "\n".join([*words, ""])
    if not _ODD.search(text):
        return _RUNS.findall(text.lower())
    odd = [x for x in words if _ODD.search(x)]
    left, next_odd = set(odd), iter(odd).__next__
    return [next_odd() if x == "\0" else x for x in _RUNS.findall("\n".join(["\0" if x in left else x for x in [*words, ""]]).lower())]


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _dealt(flat: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The ids of the entries at these places; ``flat`` has those of entries of these sizes one after another."""
    starts, out, to = np.cumsum(sizes) - sizes, np.empty(sizes[places].sum(), "<u4"), 0
    for k in range(0, len(places), _PLACES):
        n = sizes[some := places[k : k + _PLACES]]
        at = np.repeat(starts[some] - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        out[to : to + len(at)] = flat[at]
        to += len(at)
    return out


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``spaced``: white space counts, so pieces keep the space before them.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        self.inner: dict[str, bytes] = {} if spaced else {"": b""}
        self.first: dict[str, bytes] = {}
        self.size = 0
        self.in_runs = not spaced and self._cuts_runs()
        self.divider, self.divider_id = self._divider()
        if self.in_runs:
            self._of_runs()

    def _cuts_runs(self) -> bool:
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normal is None or cut is None:
            return False
        normal, cut = json.loads(normal.__getstate__()), json.loads(cut.__getstate__())
        return normal.get("normalizers") == _STEPS and cut.get("pretokenizers") == [_CUT, _BYTES] and bool(getattr(self.tokenizer.model, "end_of_word_suffix", None))

    def _of_runs(self) -> None:
        """The same model behind a cut at spaces alone, and which ids end a word."""
        from tokenizers import Tokenizer, pre_tokenizers

        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[at for token, at in vocab.items() if token.endswith(suffix)]] = True
        self.inner |= {"\n": b"", **dict(zip(_LONE, self._alone(list(_LONE))))}

    def _divider(self) -> tuple[str, int]:
        for token, at in sorted(self.tokenizer.get_vocab().items(), key=lambda x: -x[1]):
            word = token.removeprefix("Ġ").removesuffix("</w>")
            if len(word) > 5 and word.isascii() and word.isalpha() and self._ids(" " + word) == [at]:
                return " " + word, at
        raise ValueError("no word of the vocabulary is one token")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """Ids of runs, by their last tokens, and of odd words or pieces, by dividers."""
        if not self.in_runs:
            return self._divided(pieces)
        odd = [p for p in pieces if _ODD.search(p)]
        if not odd:
            return self._ended(pieces)
        by_odd = dict(zip(odd, self._divided(odd)))
        plain = iter(self._ended([p for p in pieces if p not in by_odd]))
        return [by_odd[p] if p in by_odd else next(plain) for p in pieces]

    def _ended(self, plain: list[str]) -> list[bytes]:
        out = []
        groups = list(chunked(plain, _TOGETHER))
        for group, found in zip(groups, self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) * 4 + 4).tolist()
            if len(ends) != len(group) or ends[-1] != 4 * len(ids):
                out += self._divided(group)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _divided(self, pieces: list[str]) -> list[bytes]:
        out = []
        groups = list(chunked(pieces, _TOGETHER))
        joined = [self.divider.join(" " + p for p in g) for g in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            at = np.flatnonzero(ids == self.divider_id)
            if len(at) != len(group) - 1:
                out += self._alone([" " + p for p in group])
                continue
            raw, ends = ids.tobytes(), [*(at * 4).tolist(), 4 * len(ids)]
            out += [raw[a:b] for a, b in zip([0, *(at * 4 + 4).tolist()], ends)]
        return out

    def _regular(self, piece: str) -> bool:
        return not self.spaced or bool(piece) and piece.strip() == piece

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of each text: of its distinct words by their runs, dealt out to the places of the words."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded, known = words.flatten().dictionary_encode(), self.inner
        cut = pa.array(_runs(_strings(coded.dictionary)), pa.large_string()).dictionary_encode()
        runs, places = _strings(cut.dictionary), cut.indices.to_numpy()
        new = sorted(x for x in runs if x not in known)
        now = dict(zip(new, self._together(new)))
        known.update(now)
        ids = list(map(known.__getitem__, runs))
        if self.size < CACHE_BYTES:
            self.size += weight(now)
        else:
            drop(known, now)
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        last = np.fromiter(map("\n".__eq__, runs), bool, len(runs))[places]
        sizes, flat = np.diff(np.cumsum(sizes[places])[last], prepend=0), _dealt(flat, sizes, places)
        places = coded.indices.to_numpy()
        raw, cuts = _dealt(flat, sizes, places).tobytes(), (4 * np.cumsum(np.r_[0, sizes[places]])[words.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, in order."""
        if self.in_runs:
            return self._by_words(texts)
        parts, odd, known = [x.split(" ") for x in texts], {}, self.inner
        heads = [own[0] for own in parts]
        for own in parts:
            del own[0]
        new = set().union(*parts).difference(known)
        if self.spaced:
            bad = {p for p in new if not self._regular(p)}
            for n, own in enumerate(parts):
                if self._regular(heads[n]) and (not bad or bad.isdisjoint(own)):
                    continue
                own = _SAFE.split(texts[n])
                heads[n] = own.pop(0)
                if own and not self._regular(own[-1]):
                    odd[n] = " " + own.pop()
                parts[n] = own
                new.update(own)
            new = new.difference(bad, known)
        new, firsts = sorted(new), sorted(set(heads).difference(self.first))
        now = dict(zip(new, self._together(new)))
        first = dict(zip(firsts, self._alone(firsts)))
        ends = dict(zip(odd, self._alone(list(odd.values()))))
        known.update(now)
        self.first.update(first)
        get, heads = known.__getitem__, [self.first[h] for h in heads]
        out = [h + b"".join(map(get, own)) + ends.get(n, b"") for n, (h, own) in enumerate(zip(heads, parts))]
        if self.size < CACHE_BYTES:
            self.size += weight(now) + weight(first)
        else:
            drop(known, now)
            drop(self.first, first)
        return out


def weight(entries: dict[str, bytes]) -> int:
    """About the bytes that these cache entries take."""
    return ENTRY * len(entries) + sum(map(len, entries)) + sum(map(len, entries.values()))


def drop(entries: dict[str, bytes], late: dict[str, bytes]) -> None:
    """Take out again what a full cache has no room for."""
    for name in late:
        del entries[name]


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """The worker's encoder of this file."""
    return held(("encoder", path, spaced), lambda: PieceEncoder(path, spaced))
