"""Token ids of whole texts by a word-level BPE of the tokenizers library, with a cache of pieces.

White space always separates tokens of such a vocabulary, so a text's ids are those of its pieces
between spaces and line ends, and a piece's ids don't depend on its neighbours. A batch of
texts is cut into pieces in Arrow; only its different pieces are looked up, and the library
encodes those that the cache doesn't hold in one call, with a special token between them. When the
cache is full, pieces met in one batch only are forgotten, or all if that frees less than half: its size is bounded.
"""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer, normalizers  # noqa: E402

#: Composed letters whose lower case is one letter each, and marks that are tokens apart from letters.
LATIN, MARKS = "[A-Za-zÀ-ÖØ-öø-į]+", ".,!?;:#$%&*"
MOST = 500_000
#: Words for one call of the library; bytes of text that are gathered at once.
WORDS, TEXT_BYTES = 10_000, 8 << 20


class WordBpe:
    def __init__(self, path: str, most: int = MOST):
        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark = max(self.special)
        self.plain = Tokenizer.from_file(path)  # for lower-case composed words, which the normalizer leaves as they are
        self.plain.normalizer = normalizers.Sequence([])
        if hasattr(self.plain.model, "_resize_cache"):
            self.plain.model._resize_cache(0)  # each word is asked for once
        self.last = np.zeros(self.size, dtype=bool)
        for token, i in self.plain.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {"": 0}  # place of a piece in starts and lengths
        self.starts, self.lengths, self.tokens = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.hits = np.zeros(1, np.int32)  # batches that a piece was met in

    def _forget(self) -> None:
        """Keeps the pieces met in several batches if they are at most half of those allowed, else none."""
        keep = np.flatnonzero(self.hits > 1)
        keep = keep[keep > 0]
        if len(keep) > self.most // 2:
            self._empty()
            return
        names = list(self.known)  # in the order of their places
        tokens, lengths = self._gather(keep)
        pieces, hits = [names[i] for i in keep.tolist()], self.hits[keep]
        self._empty()
        self._add(pieces, lengths, tokens)
        self.hits[1:] = hits

    def _add(self, pieces: list[str], lengths: np.ndarray, tokens: np.ndarray) -> None:
        """Takes pieces into the cache whose tokens stand one after another."""
        first = len(self.starts)
        self.known.update(zip(pieces, range(first, first + len(pieces))))
        self.starts = np.concatenate([self.starts, len(self.tokens) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.tokens = np.concatenate([self.tokens, tokens])
        self.hits = np.concatenate([self.hits, np.zeros(len(pieces), np.int32)])

    def _library(self, pieces: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        between = ids == self.special[self.mark]
        ends = np.append(np.flatnonzero(between), len(ids))
        assert len(ends) == len(pieces)
        self._add(pieces, np.diff(ends, prepend=-1) - 1, ids[~between])

    def _words(self, words: list[str]) -> None:
        """Lower-case composed words: the library gets them with spaces between, and each ends with a token that ends words."""
        for at in range(0, len(words), WORDS):
            part = words[at : at + WORDS]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(part):
                self._add(part, np.diff(ends, prepend=-1), ids)
            else:
                self._library(part)

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pieces one after another, and their number for each piece."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((self.starts[places] - ends + lengths).astype(np.int32), lengths)
        at += np.arange(total, dtype=np.int32)
        return self.tokens[at], lengths

    def _learn(self, missing: list[str]) -> None:
        """Encodes new pieces; words that differ in case or in the marks after them are encoded once."""
        known, texts = self.known, pa.array(missing, pa.string())
        trimmed = pc.utf8_rtrim(texts, MARKS)
        lower = pc.utf8_lower(trimmed)
        fit = np.asarray(pc.match_substring_regex(trimmed, f"^{LATIN}$").cast(pa.int8()), bool)
        same = np.asarray(pc.equal(lower, texts).cast(pa.int8()), bool)
        words = dict.fromkeys(itertools.compress(missing, (fit & same).tolist()))
        other = dict.fromkeys(itertools.compress(missing, (~fit).tolist()))
        joined, parts = list(itertools.compress(missing, (fit & ~same).tolist())), []
        for p, core in zip(joined, lower.filter(pa.array(fit & ~same)).to_numpy(zero_copy_only=False).tolist()):
            if core not in known:
                words[core] = None
            parts.append(core)
            parts.append(mark := p[len(core) :])
            if mark not in known:
                other[mark] = None
        self._words(list(words))
        if other:
            self._library(list(other))
        if joined:
            tokens, lengths = self._gather(np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)))
            self._add(joined, lengths[::2] + lengths[1::2], tokens)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of ``texts`` of bounded size: where one begins, its ids and their bounds (see encode)."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        groups = (np.cumsum(sizes) - sizes) // TEXT_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield a, *self.encode(texts.slice(a, b - a))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) one after another, and where each text's begin and the last's end."""
        texts = pc.fill_null(texts, "")
        odd = pc.indices_nonzero(pc.match_substring(texts, "<|")).to_pylist()  # special tokens may stand in a text
        if odd:
            plain = texts.to_pylist()
            whole = {i: self._whole(plain[i]) for i in odd}
            for i in odd:
                plain[i] = ""
            ids, bounds = self.encode(pa.array(plain, pa.string()))
            parts = [whole.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(plain))]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        flat, offsets = lists.flatten(), np.asarray(lists.offsets, np.int64)
        coded = flat.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each
        if len(self.known) > self.most:
            self._forget()
        get = self.known.get
        places = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        if len(new := np.flatnonzero(places < 0)):
            missing = [pieces[i] for i in new.tolist()]
            self._learn(missing)
            places[new] = list(map(self.known.__getitem__, missing))
        self.hits[places] += 1
        ids, lengths = self._gather(places[np.asarray(coded.indices)])
        return ids, np.append(0, np.cumsum(lengths))[offsets - offsets[0]]


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One tokenizer a worker process."""
    return WordBpe(path)
