"""Merge-type segmentation of a SentencePiece model with seeded merge-dropout, and its exact inverse.

The model's pieces and scores are read through the library; texts are segmented here. Each unit
(a run of spaces with the word after it) starts as characters; the agenda takes the best-scored
neighbouring pair that forms a piece, leftmost on ties, unless a keyed hash of the candidate says that it
is skipped. The hash covers the seed, the unit's variant and the span, and an occurrence's
variant is a keyed hash of its document and place, so a word is cut in up to ``variants`` ways, the
same text in the same document always alike. Characters without a piece become bytes. Decoding
needs no key and gives the text back byte for byte.

Defined cases: a null text gives null ids and a null text back, an empty one no ids. Repeated rows
are cut alike. A literal U+2581, which the model uses for spaces, becomes bytes, so it survives.
Texts are read whole, of any length. An empty table gives an empty result. Only the named columns
are read, so further columns never clash.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SPACE = "▁"
#: Of the keyed hash of a candidate's span.
M1, M2, M3, M4, LOW = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, (1 << 32) - 1
#: Characters of a unit up to which a list serves as agenda; a rank that no piece has.
SHORT, NONE, NO_RANK = 40, float("inf"), np.iinfo(np.int32).max
#: Units as the agenda sees them: spaces with what follows, or what follows a line end.
UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
MOST, TEXT_BYTES = 400_000, 8 << 20
#: Units whose agendas advance together, at most, and bounds of their numbers of characters.
TOGETHER, WIDTHS = 1 << 14, (1, 6, 9, 12, 16, SHORT)


@dataclass(frozen=True)
class Dropout:
    """rate: share of candidate merges that are skipped; seed: the key."""

    rate: float = 0.1
    seed: int = 1


class Pieces:
    """A model's pieces by their text, and the bytes that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = [b""] * size
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not special[i]:
                self.ids[piece], self.rank[piece] = i, -model.get_score(i)
                self.raw[i] = piece.replace(SPACE, " ").encode()
        self._pairs()
        lengths = np.array([len(r) for r in self.raw], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def _pairs(self) -> None:
        """All pairs of symbols that form a piece, sorted by key, with the piece and its rank."""
        size = len(self.raw)
        symbol = lambda s: self.ids.get(s, size + ord(s) if len(s) == 1 else None)
        self.chars = np.arange(size, size + 0x10000, dtype=np.int64)  # characters without a piece lie beyond all pieces
        for s, i in self.ids.items():
            if len(s) == 1 and ord(s) < 0x10000:
                self.chars[ord(s)] = i
        found = {}
        for s, i in self.ids.items():
            for k in range(1, len(s)):
                a, b = symbol(s[:k]), symbol(s[k:])
                if a is not None and b is not None:
                    found[a << 21 | b] = (i, int(self.rank[s]))
        self.pair_piece = np.array([*(i for i, _ in found.values()), -1], np.int32)
        self.pair_rank = np.array([*(r for _, r in found.values()), NO_RANK], np.int32)
        # places by hashed key, the next slot if one is taken; an empty slot has the place of no pair
        self.shift = np.uint64(64 - (8 * len(found) + 1).bit_length())
        slots = 1 << 64 - int(self.shift)
        self.slot_keys, self.slots = np.full(slots, -1, np.int64), np.full(slots, len(found), np.int32)
        keys = np.array(list(found), np.int64)
        for place, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.slot_keys[at] >= 0:
                at = (at + 1) % slots
            self.slot_keys[at], self.slots[at] = key, place

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(M1) >> self.shift).view(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the tables, the last place where it forms no piece; symbols under 0 form none."""
        keys = np.bitwise_or(left.astype(np.int64) << 21, right)
        at = self._slot(keys)
        met = self.slot_keys[at]
        out = self.slots[at]
        more = np.flatnonzero((met != keys) & (met >= 0))
        while len(more):
            at[more] = (at[more] + 1) % len(self.slots)
            met = self.slot_keys[at[more]]
            out[more] = self.slots[at[more]]
            more = more[(met != keys[more]) & (met >= 0)]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, with the space that begins every text."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.bytes[at]


class Segmenter:
    """Cuts texts; every occurrence of a unit has draws of its own.

    A node is a unit with the spans skipped so far; it keeps the spans merged if nothing else is skipped, and the ids that
    this leaves. An occurrence goes from node to node by its draws. All nodes are forgotten when there are too many."""

    def __init__(self, path: str, p: Dropout, most: int = MOST):
        self.pieces, self.p, self.most = Pieces(path), p, most
        self.limit = int(p.rate * (1 << 32))
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.children: dict[int, int] = {}
        self.names: dict[int, str] = {}
        self.tokens, self.chain = np.zeros(0, np.uint32), np.zeros(0, np.uint64)
        # of a node: its ids, its merges (size -1: too long to keep), the unit's node, the node it comes from and the span skipped there
        self.starts, self.first, self.root, self.parent = (np.zeros(0, np.int64) for _ in range(4))
        self.lengths, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.span, self.hash = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def _hash(self, unit: str) -> int:
        return xxhash.xxh3_64_intdigest(unit.encode("utf-8", "surrogatepass"), self.p.seed)

    def _grow(self, names: list[str], parents: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """New nodes of pieces of text, each with the span that is skipped beyond those of its parent (-1: none)."""
        new = len(self.starts) + np.arange(len(names))
        line = np.array([n.startswith("\n") for n in names], bool)
        units = [n[1:] if e else SPACE + n for n, e in zip(names, line.tolist())]
        skipped, up = [spans], parents
        while (up >= 0).any():
            skipped.append(np.where(up >= 0, self.span[up], 0).astype(np.uint64))
            up = np.where(up >= 0, self.parent[up], -1)
        skips, sizes = np.stack(skipped, 1), np.fromiter(map(len, units), np.int64, len(units))
        order, tokens, lengths, rows, chain = self._agendas(units, sizes, skips=skips)
        lined = line[order]
        tokens = np.insert(tokens, (np.cumsum(lengths) - lengths)[lined], self.pieces.byte_ids[10])
        lengths = lengths + lined
        begins, per_unit = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        begins[order], per_unit[order] = np.cumsum(lengths) - lengths, lengths
        chain = chain[np.argsort(rows, kind="stable")]
        size = np.bincount(rows, minlength=len(units))
        hashes = np.zeros(len(units), np.uint64)
        fresh = np.flatnonzero(parents < 0)
        hashes[fresh] = np.fromiter((self._hash(units[i]) for i in fresh.tolist()), np.uint64, len(fresh))
        if len(fresh) < len(units):
            hashes[parents >= 0] = self.hash[parents[parents >= 0]]
        join = lambda a, b: np.concatenate([a, b.astype(a.dtype)])
        self.starts = join(self.starts, len(self.tokens) + begins)
        self.first = join(self.first, len(self.chain) + np.cumsum(size) - size)
        self.root = join(self.root, np.where(parents >= 0, self.root[parents] if len(self.root) else 0, new))
        self.parent, self.span = join(self.parent, parents), join(self.span, spans)
        self.lengths, self.size = join(self.lengths, per_unit), join(self.size, np.where(sizes > SHORT, -1, size))
        self.hash = join(self.hash, hashes)
        self.tokens, self.chain = join(self.tokens, tokens), join(self.chain, chain)
        return new

    def _walk(self, nodes: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """The nodes at which occurrences that begin at ``nodes`` end."""
        base, at = self.hash[nodes] + draws, np.zeros(len(nodes), np.int64)
        m4, shift, low, limit = np.uint64(M4), np.uint64(27), np.uint64(LOW), np.uint64(self.limit)
        live = np.arange(len(nodes))
        while len(live) and self.limit:
            hits = []
            while len(live := live[at[live] < self.size[nodes[live]]]):
                span = self.chain[self.first[nodes[live]] + at[live]]
                skip = ((base[live] ^ span) * m4 >> shift & low) < limit
                hits.append(live[skip])
                live = live[~skip]
                at[live] += 1
            live = np.concatenate([np.zeros(0, np.int64), *hits])
            keys, where = np.unique(nodes[live] << 6 | at[live], return_inverse=True)
            next_ = np.fromiter((self.children.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
            missing = np.flatnonzero(next_ < 0)
            if len(missing):
                parents, place = keys[missing] >> 6, keys[missing] & 63
                next_[missing] = self._grow([self.names[r] for r in self.root[parents].tolist()], parents, self.chain[self.first[parents] + place])
                self.children.update(zip(keys[missing].tolist(), next_[missing].tolist()))
            nodes[live] = next_[where]
        return nodes

    def unit(self, unit: str, variant: int) -> list[int]:
        """Ids of one unit, drawn by the number of its occurrence; the marks for spaces are in it."""
        n = len(unit)
        if n == 1:
            return self._ids(unit)
        base = self._hash(unit) + variant & (1 << 64) - 1
        return self._short(unit, n, base) if n <= SHORT else self._long(unit, n, base)

    def _short(self, unit: str, n: int, base: int) -> list[int]:
        """The agenda as a list of the ranks of neighbouring pairs."""
        rank, limit, none = self.pieces.rank.get, self.limit, NONE
        symbols, starts = list(unit), list(range(n + 1))
        ranks = [rank(a + b, none) for a, b in zip(unit, unit[1:])]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            if (base ^ (starts[i] * M1 + starts[i + 1] * M2 + starts[i + 2] * M3)) * M4 >> 27 & LOW < limit:
                ranks[i] = none
                continue
            symbols[i] = whole = symbols[i] + symbols.pop(i + 1)
            del starts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(whole + symbols[i + 1], none)
            if i:
                ranks[i - 1] = rank(symbols[i - 1] + whole, none)
        try:
            return list(map(self.pieces.ids.__getitem__, symbols))
        except KeyError:
            return [x for s in symbols for x in self._ids(s)]

    def _long(self, unit: str, n: int, base: int) -> list[int]:
        """The agenda as a heap."""
        rank, limit = self.pieces.rank, self.limit
        after, before = list(range(1, n + 1)), list(range(-1, n))  # of the symbol that begins at a place
        agenda = [(rank[s], i, i + 1, i + 2) for i in range(n - 1) if (s := unit[i : i + 2]) in rank]
        heapq.heapify(agenda)
        alive = [True] * (n + 1)
        while agenda:
            _, left, right, end = heapq.heappop(agenda)
            if not alive[left] or not alive[right] or after[left] != right or after[right] != end:
                continue
            if (base ^ (left * M1 + right * M2 + end * M3)) * M4 >> 27 & LOW < limit:
                continue
            alive[right] = False
            after[left] = end
            before[end] = left
            if left and (s := unit[before[left] : end]) in rank:
                heapq.heappush(agenda, (rank[s], before[left], left, end))
            if end < n and (s := unit[left : after[end]]) in rank:
                heapq.heappush(agenda, (rank[s], left, end, after[end]))
        out, at, ids = [], 0, self.pieces.ids
        while at < n:
            end = after[at]
            i = ids.get(unit[at:end])
            if i is None:
                out.extend(self._ids(unit[at:end]))
            else:
                out.append(i)
            at = end
        return out

    def units(self, units: list[str], variants: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units one after another, and their number for each: the agendas of all advance together."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        base = np.fromiter(map(self._hash, units), np.uint64, len(units)) + variants.astype(np.uint64)
        order, tokens, counts, _, _ = self._agendas(units, sizes, base)
        lengths, starts = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        lengths[order], starts[order] = counts, np.cumsum(counts) - counts
        long = {i: self.unit(units[i], int(variants[i])) for i in np.flatnonzero(sizes > SHORT).tolist()}
        parts = [long[i] if i in long else tokens[a : a + n] for i, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist()))]
        lengths[list(long)] = list(map(len, long.values()))
        return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.uint32), lengths

    def _agendas(self, units: list[str], sizes: np.ndarray, base: np.ndarray | None = None, skips: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Ids of all units, none for those beyond SHORT: the units' order, their ids one after another in it, the number of each; and
        rows and spans of all merges, those of a row in their order. See ``_together``."""
        single = np.flatnonzero(sizes == 1)
        ids = [self._ids(units[i]) for i in single.tolist()]
        rest = np.flatnonzero((sizes < 1) | (sizes > SHORT))
        found = [(single, np.array([x for i in ids for x in i], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))), (rest, np.zeros(0, np.uint32), np.zeros(len(rest), np.int64))]
        merged = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for low, high in zip(WIDTHS, WIDTHS[1:]):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(rows), TOGETHER):
                some = rows[at : at + TOGETHER]
                found.append((some, *self._together([units[i] for i in some.tolist()], sizes[some], high, base if base is None else base[some], skips if skips is None else skips[some], some, merged)))
        return *(np.concatenate(x) for x in zip(*found)), *(np.concatenate(x) for x in zip(*merged))

    def _together(self, units: list[str], sizes: np.ndarray, width: int, base: np.ndarray | None, skips: np.ndarray | None, rows: np.ndarray, merged: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of 2 to ``width`` characters, one after another, and their number for each. Without ``base`` the spans in ``skips``
        are skipped. Numbers in ``rows`` and spans of all merges are added to ``merged`` in their order.

        A symbol stays at the place of its first character, and knows the places of its neighbours; a place before and one behind hold none."""
        t, n, wide = self.pieces, len(units), width + 2
        points = np.array(units, f"<U{width}").view(np.uint32).reshape(n, width)
        found = t.chars[points & 0xFFFF]
        beyond = points >= 0x10000
        if beyond.any():
            found[beyond] = len(t.raw) + points[beyond].astype(np.int64)
        places = np.arange(wide, dtype=np.int32)
        symbols = np.full((n, wide), -1, np.int32)
        symbols[:, 1:-1] = np.where(places[:-2] < sizes[:, None], found, -1)
        pairs = np.full((n, wide), len(t.pair_rank) - 1, np.int32)
        pairs[:, 1:-1] = t.pair(symbols[:, 1:-1].ravel(), symbols[:, 2:].ravel()).reshape(n, width)
        ranks = t.pair_rank[pairs]
        after, before = np.tile(places + 1, n), np.tile(places - 1, n)
        symbols, pairs, flat = symbols.ravel(), pairs.ravel(), ranks.ravel()
        m4, low, limit = np.uint64(M4), np.uint64(LOW), np.uint64(self.limit)
        m1, m2, m3 = ((np.maximum(places, 1) - 1).astype(np.uint64) * np.uint64(m) for m in (M1, M2, M3))
        row = np.arange(n)  # of each row of ``ranks``
        first = row * wide
        while len(row):
            best = ranks.argmin(axis=1)
            at = np.arange(len(row)) * wide + best
            busy = np.flatnonzero(flat[at] != NO_RANK)
            if len(busy) < len(row):
                if 4 * len(busy) < 3 * len(row):
                    ranks = ranks[busy]
                    flat, row, first, best = ranks.ravel(), row[busy], first[busy], best[busy]
                    at, busy = np.arange(len(row)) * wide + best, np.arange(len(row))
                if not len(busy):
                    break
            here, at, left, which = first[busy], at[busy], best[busy], row[busy]
            right = after[here + left]
            end = after[here + right]
            place = m1[left] + m2[right] + m3[end]
            skip = (place[:, None] == skips[which]).any(axis=1) if base is None else ((base[which] ^ place) * m4 >> np.uint64(27) & low) < limit
            flat[at[skip]] = NO_RANK
            go = ~skip
            here, at, left, right, end = here[go], at[go], left[go], right[go], end[go]
            merged.append((rows[which[go]], place[go]))
            me, gone = here + left, here + right
            piece = t.pair_piece[pairs[me]]
            symbols[me], symbols[gone] = piece, -1
            after[me], before[here + end] = end, left
            flat[at - left + right] = NO_RANK
            pairs[me] = found = t.pair(piece, symbols[here + end])
            flat[at] = t.pair_rank[found]
            lead = before[me]
            pairs[here + lead] = found = t.pair(symbols[here + lead], piece)
            flat[at - left + lead] = t.pair_rank[found]
        kept = symbols >= 0
        ids, counts = symbols[kept], kept.reshape(n, wide).sum(axis=1)
        if len(strange := np.flatnonzero(ids >= len(t.raw))):
            raw = [self._ids(chr(s - len(t.raw))) for s in ids[strange].tolist()]
            times = np.ones(len(ids), np.int64)
            times[strange] = list(map(len, raw))
            stops = np.append(0, np.cumsum(times))
            counts = np.diff(stops[np.append(0, np.cumsum(counts))])
            inside = np.zeros(len(ids), bool)
            inside[strange] = True
            ids = np.repeat(ids, times)
            ids[np.repeat(inside, times)] = [x for r in raw for x in r]
        return ids.astype(np.uint32), counts

    def _ids(self, symbol: str) -> list[int]:
        i = self.pieces.ids.get(symbol)
        return [self.pieces.byte_ids[b] for b in symbol.replace("\0", SPACE).encode("utf-8", "surrogatepass")] if i is None else [i]

    def text(self, text: str, variants: np.ndarray | None = None, key: int = 0) -> list[int]:
        """Ids of one text of any kind. Literal marks and NULs take the way over bytes."""
        out: list[int] = []
        for part in re.split(f"([\0{SPACE}])", " " + text) if SPACE in text or "\0" in text else [" " + text]:
            if part in ("\0", SPACE):
                out.extend(self.pieces.byte_ids[b] for b in part.encode())
                continue
            units = UNITS.findall(part.replace(" ", SPACE))
            for unit, v in zip(units, occurrence_draws(key, len(out), len(units), self.p).tolist()):
                out.extend(self.unit(unit, v))
        return out

    def batch(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) one after another, and where each text's begin and the last's end."""
        plain = pc.fill_null(texts, "")
        spaced = pc.replace_substring(plain, "\n", " \n")
        lists = pc.split_pattern(spaced, " ")
        flat, offsets = lists.flatten(), np.asarray(lists.offsets, np.int64)
        offsets = offsets - offsets[0]
        # runs of spaces, spaces at an end, literal marks and NULs go the general way
        gaps = np.append(0, np.cumsum(np.asarray(pc.equal(pc.binary_length(flat), 0).cast(pa.int8()), np.int64)))
        odd = (gaps[offsets[1:]] > gaps[offsets[:-1]]) | np.asarray(pc.match_substring_regex(plain, f"[\\x00{SPACE}]").cast(pa.int8()), bool)
        counts = np.diff(offsets)
        keep = np.repeat(~odd, counts)
        coded = flat.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64)
        if len(self.starts) > self.most:
            self._empty()
        used = np.zeros(len(names), bool)
        used[codes[keep]] = True
        met = [names[i] for i in np.flatnonzero(used).tolist()]
        if new := [n for n in met if n not in self.known]:
            made = self._grow(new, np.full(len(new), -1), np.zeros(len(new), np.uint64)).tolist()
            self.known.update(zip(new, made))
            self.names.update(zip(made, new))
        words = np.zeros(len(names), np.int64)
        words[used] = np.fromiter(map(self.known.__getitem__, met), np.int64, len(met))
        at = np.arange(len(codes)) - np.repeat(offsets[:-1], counts)
        draws = _draws(np.repeat(keys, counts), at, self.p)[keep]
        places = self._walk(words[codes[keep]], draws)
        cuts, longer = [], 0
        starts, lengths, tokens = self.starts[places], self.lengths[places].astype(np.int64), self.tokens
        for i in np.flatnonzero(self.size[places] < 0).tolist():
            name = self.names[int(places[i])]
            cuts.append(([self.pieces.byte_ids[10]] + self.unit(name[1:], int(draws[i]))) if name.startswith("\n") else self.unit(SPACE + name, int(draws[i])))
            starts[i], lengths[i] = len(tokens) + longer, len(cuts[-1])
            longer += len(cuts[-1])
        if cuts:
            tokens = np.concatenate([tokens, np.array([x for c in cuts for x in c], np.uint32)])
        ends = np.cumsum(lengths)
        take = np.repeat(starts - ends + lengths, lengths)
        take += np.arange(len(take))
        ids = tokens[take]
        per_text = np.zeros(len(texts) + 1, np.int64)
        spread = np.zeros(len(codes) + 1, np.int64)
        spread[1:][keep] = lengths
        per_text[1:] = np.diff(np.cumsum(spread)[offsets])
        empty = np.asarray(pc.equal(pc.binary_length(plain), 0).cast(pa.int8()), bool)
        if not odd.any():
            return ids, np.cumsum(per_text)
        bounds, parts = np.cumsum(per_text), []
        rows = plain.to_pylist()
        for i, strange in enumerate(odd.tolist()):
            if empty[i]:
                parts.append(np.zeros(0, np.uint32))
            elif strange:
                parts.append(np.array(self.text(rows[i], key=int(keys[i])), np.uint32))
            else:
                parts.append(ids[bounds[i] : bounds[i + 1]])
        return np.concatenate(parts) if parts else ids, np.cumsum([0, *map(len, parts)])


def _draws(keys: np.ndarray, at: np.ndarray, p: Dropout) -> np.ndarray:
    """Keyed hash of document and place: the number of an occurrence."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(p.seed)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def occurrence_draws(key: int, first: int, count: int, p: Dropout) -> np.ndarray:
    return _draws(np.full(count, key, np.int64), np.arange(first, first + count), p)


@functools.lru_cache(maxsize=2)
def segmenter(path: str, p: Dropout) -> Segmenter:
    """One a worker process."""
    return Segmenter(path, p)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about TEXT_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    groups = (np.cumsum(sizes) - sizes) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, model: str, p: Dropout = Dropout(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, ids), ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = segmenter(model, p)
        for batch in batches:
            for part in _runs(batch):
                ids, bounds = cutter.batch(part.column(1), np.asarray(pc.fill_null(part.column(0), -1), np.int64))
                raw = ids.astype("<u4")
                rows = [raw[a:b].tobytes() if valid else None for a, b, valid in zip(bounds.tolist(), bounds[1:].tolist(), pc.is_valid(part.column(1)).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return _keyed(docs, key, text).mapInArrow(run, "doc_id long, ids binary")


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the texts that the ids stand for."""

    @F.pandas_udf("string")
    def whole(column):  # noqa: ANN001, ANN202
        table = pieces(model)
        return column.map(lambda r: None if r is None else table.decode(np.frombuffer(r, "<u4")).tobytes()[1:].decode("utf-8"))

    return rows.withColumn(text, whole(ids))


def round_trip(docs: DataFrame, model: str, p: Dropout = Dropout(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_crc32, lossless): every text is encoded, decoded and held against itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = segmenter(model, p)
        for batch in batches:
            for part in _runs(batch):
                ids, bounds = cutter.batch(part.column(1), np.asarray(pc.fill_null(part.column(0), -1), np.int64))
                raw = ids.astype("<u4")
                back = cutter.pieces.decode(ids)
                ends = np.append(0, np.cumsum(cutter.pieces.lengths[ids]))[bounds].tolist()
                same, crcs, steps = [], [], bounds.tolist()
                view = memoryview(back)
                for i, t in enumerate(part.column(1)):
                    want = (t.as_py() or "").encode("utf-8")
                    same.append(bytes(view[ends[i] : ends[i + 1]]) == (b" " + want if want else b""))
                    crcs.append(zlib.crc32(raw[steps[i] : steps[i + 1]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "lossless"])

    return _keyed(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, lossless boolean")


#: The registered query's model file.
MODEL = "piece_bpe_32k.model"


def op4_sp_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import tokenizer_path

    return round_trip(documents(spark, sf_dir), tokenizer_path(MODEL))
