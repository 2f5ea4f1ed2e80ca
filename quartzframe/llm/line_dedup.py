"""Near-duplicate lines by a segment-partition edit join.

Each different line is cut into threshold-plus-one segments; two lines within the threshold share a
segment, at places that the difference of their lengths bounds. Segments are indexed by length,
ordinal and hash, and probed with the substrings that may match them for each length a partner may have.
First each line is compared with one hub of each of its keys; then lines of one key that are in different components by
then, behind a screen of parities of characters and their pairs (an edit flips few bits). Lines that pass it are fetched
once for each key, and verified where they meet: near misses cost time in a task, but no rows. Where more than ``group`` rows of several components share
a key, they are indexed again by that key and the segments of what the match leaves of their lines, up to ``levels``
times; rows that still share a key meet in dealt blocks. So no links are listed inside a dense class, and none between
classes is lost. Pairs are verified by a banded bit-parallel edit distance. Links make classes of lines; the first
occurrence of a class, in order of document and line, is kept and the others are dropped.

Defined cases: a null or empty text has no lines. Lines of fewer than ``least`` characters are
kept always. Rows with a null id keep all lines and hold no first occurrence; rows of one id and place count as
one occurrence. A text is cut at line feeds only, and kept lines stay as they are. An empty table gives an
empty result. ``clean`` keeps all columns; its helper columns take names that no column has.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, SHUFFLES_GO, components, documents, fresh, hot_keys, keyed_join, let, materialize, settings, within_bits


@dataclass(frozen=True)
class LineDedup:
    """edits: threshold of the edit distance; least: characters of the shortest line that may be dropped; group: rows that meet under
    one key without a further segment; levels: how often a line is indexed."""

    edits: int = 3
    least: int = 20
    group: int = 512
    levels: int = 3


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of segment ``i`` of lines; the last ones are longer by one where a length doesn't divide."""
    size, longer = np.divmod(length, edits + 1)
    first = edits + 1 - longer
    return i * size + np.maximum(0, i - first), size + (i >= first)


def shifts(edits: int) -> list[tuple[int, int, int]]:
    """(difference of the lengths, ordinal, shift) at which a line may hold a segment of a line not longer.

    A match at ordinal i leaves at most i edits before it and at most edits - i after it, which
    bounds its shift from both sides.
    """
    return [(gap, i, s) for gap in range(edits + 1) for i in range(edits + 1) for s in range(max(-i, gap - (edits - i)), min(i, gap + edits - i) + 1)]


def parities(line: str) -> tuple[int, int, int]:
    """64 parities of characters and 128 of pairs of neighbours, as signed integers. An edit flips at most two and four of them."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashed = points * np.uint32(2654435761)
    odd = np.bincount(hashed >> np.uint32(26), minlength=64) & 1
    pairs = (hashed[:-1] ^ (points[1:] * np.uint32(2246822519) << np.uint32(1))) * np.uint32(3266489917)
    both = np.concatenate([odd, np.bincount(pairs >> np.uint32(25), minlength=128) & 1])
    return tuple(np.packbits(both.astype(np.uint8)).view(np.int64).tolist())


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two texts is at most ``most``: bit vectors along the diagonal band."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    start, n = 0, len(a)
    while start < n and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    m, n = len(a), len(b)
    if m == 0 or n <= most:
        return n <= most
    # bit r of a vector stands for row j - most + r of column j: a band of 2 * most + 1 rows that moves down with the columns
    width = 2 * most + 1
    full, bottom = (1 << width) - 1, 1 << most
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    plus, minus = full ^ ((1 << most) - 1), 0  # vertical differences of column 0, from row 1 on
    score = 0  # of the cell on the main diagonal
    for j, c in enumerate(b):
        known = rows.get(c, 0)
        low = j - most  # row of bit 0, counted from 0
        match = (known >> low if low >= 0 else known << -low) & full
        zero = ((((match & plus) + plus) ^ plus) | match | minus) & full
        right_plus = (minus | ~(zero | plus)) & full
        right_minus = zero & plus
        if j < m:
            score += not zero & bottom
            if score > most + (n - m):
                return False
        else:  # below the last row of the text: the score moves along that row
            place = 1 << (m - 1 - low) if m - 1 - low >= 0 else 0
            score += bool(right_plus & place) - bool(right_minus & place)
        down = zero >> 1
        plus, minus = (right_minus | ~(down | right_plus)) & full, down & right_plus
    return score <= most


def occurrences(docs: DataFrame, p: LineDedup, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, pos, line, _a, _b) of lines that may be dropped; _a, _b: hashes of the line."""
    lines = docs.select(F.col(key).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    return lines.where(F.length("line") >= p.least).withColumn("_a", F.xxhash64("line")).withColumn("_b", F.xxhash64(F.lit(1), "line"))


def place(doc: str = "doc_id", pos: str = "pos") -> Column:
    """Document and line as one ordered number."""
    return F.col(doc).cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(pos)


#: Of the hashes of substrings: base of a polynomial over code points modulo 2 ** 64 and its inverse.
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)
#: Roles of a row of an index, characters that are hashed at once, and rows that meet at once.
FULL, OWN, PROBE, CHUNK, MEET = 0, 1, 2, 1 << 18, 1 << 16
#: Columns of a level, and of its lines those that all rows of an index carry; pairs that are screened at once.
LEVEL = ["id", "line", "scope", "role", "partner", "label", "chars", "pairs_a", "pairs_b"]
CARRIED, SCREEN = LEVEL[5:], 1 << 20
#: Numbers of 64 slots in the filters that keep texts out of shuffles: 30 GB have about 7 million lines that share a segment.
SLOT_WORDS = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


class Substrings:
    """Hashes of substrings of many lines; equal substrings of any lines have equal hashes."""

    def __init__(self, lines: list[str]):
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = np.cumsum(self.lengths) - self.lengths
        power = lambda b: np.cumprod(np.append(np.uint64(1), np.full(len(points), b, np.uint64)))
        self.back = power(INVERSE)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(points + np.uint64(1)) * power(BASE)[:-1])])

    def hash(self, rows: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = self.starts[rows] + begin
        return _mix((self.sums[at + size] - self.sums[at]) * self.back[at])

    def keys(self, role: np.ndarray, scope: np.ndarray, partner: np.ndarray, p: LineDedup) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(difference of lengths, whether it probes, rows, keys, begins, sizes) for each way to own or probe a segment.

        A row that owns segments probes those of others of its length at other places only: at the same
        place two owners meet.
        """
        tag = _mix(scope.view(np.uint64) + np.uint64(1))
        for gap, i, shift in shifts(p.edits):
            exact = gap == 0 and shift == 0
            asks = (role == PROBE) & (self.lengths - partner == gap)
            if not exact:
                asks |= (role == FULL) & (self.lengths - gap >= p.least) | (role == OWN) & (gap == 0)
            for probing, fit in ((False, role != PROBE), (True, asks)) if exact else ((True, asks),):
                rows = np.flatnonzero(fit)
                other = self.lengths[rows] - gap
                at, size = segment(other, i, p.edits)
                at = at + shift
                inside = (at >= 0) & (at + size <= self.lengths[rows])
                rows, at, size, other = rows[inside], at[inside], size[inside], other[inside]
                word = tag[rows] ^ self.hash(rows, at, size) ^ _mix((other * 64 + i).astype(np.uint64))
                yield gap, probing, rows, _mix(word).view(np.int64), at, size


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.utf8_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
    groups = (np.cumsum(sizes) - sizes) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)


def index(level: DataFrame, p: LineDedup, carry: bool = True) -> DataFrame:
    """Rows (key, who, CARRIED) of a level, dealt and sorted by key, owners
    first: ``who`` is 4 * id, and 1 more where it probes. Without ``carry`` the last bit of a key tells whether the row probes, so
    that one number is sorted by.

    A key that more than ``group`` rows of one chunk share is known to be hot already: its rows get 2 more and are
    dealt over all tasks, and one row with id -1 tells those of other chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, "line"):
                found = Substrings(part.column("line").to_pylist())
                ids, carried = _longs(part, "id"), [_longs(part, c) for c in CARRIED]
                made = [(k, r, ids[r] * 4 + probing) for _, probing, r, k, _, _ in found.keys(_longs(part, "role"), _longs(part, "scope"), _longs(part, "partner"), p)]
                keys, rows, who = (np.concatenate([m[i] for m in made]) for i in range(3))
                if not carry:
                    keys &= -2  # its last bit is set below
                order = np.argsort(keys, kind="stable")
                keys, rows, who = keys[order], rows[order], who[order]
                starts = _starts(keys)
                sizes = np.diff(np.append(starts, len(keys)))
                large = sizes > p.group
                who[np.repeat(large, sizes)] += 2
                told = np.full(large.sum(), -2)
                columns = [np.append(keys if carry else keys | who & 1, keys[starts[large]]), *(np.append(c, told) for c in (who, *(x[rows] for x in carried)))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "who", *CARRIED])

    rows = level.select(*LEVEL).mapInArrow(run, "key long, who long, " + ", ".join(f"{c} long" for c in CARRIED)).select("key", "who", *(CARRIED if carry else []))
    same = F.col("key") if carry else F.shiftright("key", 1)
    dealt = F.when((F.col("who").bitwiseAND(2) == 2) & (F.col("who") >= 0), F.xxhash64(same, "who")).otherwise(F.xxhash64(same))
    return rows.repartition(dealt).sortWithinPartitions("key", *([F.col("who").bitwiseAND(1)] if carry else []))


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of about MEET rows at a time."""
    waiting: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            waiting.append(batch)
        if waiting and (batch is None or sum(b.num_rows for b in waiting) >= MEET):
            yield tuple(np.concatenate([_longs(b, c) for b in waiting]) for c in columns)
            waiting = []


def hubs(rows: DataFrame) -> DataFrame:
    """Rows (a, b) of an index without carried columns: each row's id with that of the first that owns its key, as few as the index has rows.

    Where a hot key's rows were dealt to a task without an owner, they come with themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = 0, -1
        for keys, who in _gathered(batches, ("key", "who")):
            keys, who = keys[who >= 0] >> 1, who[who >= 0]
            starts = _starts(keys)
            if not len(starts):
                continue
            first = np.where(who[starts] & 1 == 0, who[starts] >> 2, -1)  # -1: no owner
            if hub != -1 and keys[0] == last:
                first[0] = hub
            sizes = np.diff(np.append(starts, len(keys)))
            ids, mine = who >> 2, np.repeat(first, sizes)
            last, hub = int(keys[-1]), int(first[-1])
            alone = (mine < 0) & (who & 2 == 2)
            mine = np.where(alone, ids, mine)
            some = (mine >= 0) & ((mine != ids) | alone)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(mine, ids)[some]), pa.array(np.maximum(mine, ids)[some])], names=["a", "b"])

    return rows.select("key", "who").mapInArrow(run, "a long, b long").distinct()


def screened(a: np.ndarray, b: np.ndarray, labels: np.ndarray, chars: np.ndarray, pairs_a: np.ndarray, pairs_b: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of rows ``a``, ``b`` whose labels differ and whose parities allow ``edits`` edits."""
    flips = lambda c, a, b: np.bitwise_count((c[a] ^ c[b]).view(np.uint64))
    fit = labels[a] != labels[b]
    a, b = a[fit], b[fit]
    fit = flips(chars, a, b) <= 2 * edits
    a, b = a[fit], b[fit]
    fit = flips(pairs_a, a, b) + flips(pairs_b, a, b) <= 4 * edits
    return a[fit], b[fit]


def meet(rows: DataFrame, p: LineDedup) -> DataFrame:
    """Rows (key, who, label, hot, n) of an index: those that form a pair with another row of their key, where labels differ and
    parities allow an edit distance within the threshold (n: pairs with rows after it), and all rows of hot keys."""

    def pairs(keys: np.ndarray, who: np.ndarray, labels: np.ndarray, chars: np.ndarray, pairs_a: np.ndarray, pairs_b: np.ndarray) -> tuple[np.ndarray, ...]:
        starts = _starts(keys)
        sizes = np.diff(np.append(starts, len(keys)))
        hot = np.repeat((sizes > p.group) | np.logical_or.reduceat(who & 2 == 2, starts), sizes)
        ends = np.repeat(starts + sizes, sizes)
        owners = np.flatnonzero(~hot & (who & 1 == 0))
        counts = ends[owners] - owners - 1
        n, met = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        groups = np.cumsum(counts) // SCREEN
        for at, count in zip(np.split(owners, np.flatnonzero(np.diff(groups)) + 1), np.split(counts, np.flatnonzero(np.diff(groups)) + 1)):
            a = np.repeat(at, count)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
            a, b = screened(a, b, labels, chars, pairs_a, pairs_b, p.edits)
            n += np.bincount(a, minlength=len(keys))
            met[a] = met[b] = True
        there = (hot & (who >= 0)) | met
        return keys[there], np.where(hot, who & ~2, who)[there], labels[there], hot[there], n[there]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "who", *CARRIED)
        left = [np.zeros(0, np.int64)] * len(names)
        hot_key: int | None = None  # a key that runs on and is known to be hot: its rows pass through
        for new in itertools.chain(_gathered(batches, names), [None]):
            held = left if new is None else [np.concatenate(x) for x in zip(left, new)]
            keys = held[0]
            if not len(keys):
                continue
            stop = len(keys) if new is None else int(np.searchsorted(keys, keys[-1]))
            if len(keys) - stop > 4 * p.group:  # the last key is hot: no need to wait for its end
                hot_key, stop = int(keys[-1]), len(keys)
            now, left = [x[:stop] for x in held], [x[stop:] for x in held]
            if not stop:
                continue
            if hot_key is not None:
                now[1] = np.where(now[0] == hot_key, now[1] | 2, now[1])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs(*now)], names=["key", "who", "label", "hot", "n"])

    return rows.mapInArrow(run, "key long, who long, label long, hot boolean, n long")


def refine(hot: DataFrame, level: DataFrame, p: LineDedup) -> DataFrame:
    """The next level: for each row (key, who) of ``hot`` what its match leaves of its line, under that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, "line"):
                lines, want = part.column("line").to_pylist(), _longs(part, "key")
                ids, carried = _longs(part, "id"), [_longs(part, c) for c in CARRIED]
                found, probes, out = Substrings(lines), _longs(part, "probe"), []
                for gap, probing, rows, keys, begins, sizes in found.keys(_longs(part, "role"), _longs(part, "scope"), _longs(part, "partner"), p):
                    for at in np.flatnonzero((keys == want[rows]) & (probes[rows] == probing)).tolist():
                        r, begin, end = int(rows[at]), int(begins[at]), int(begins[at] + sizes[at])
                        left = lines[r][:begin] + lines[r][end:]
                        out.append((int(ids[r]), left, int(want[r]), *((PROBE, len(left) - gap) if probing else (OWN, -1)), *(int(c[r]) for c in carried)))
                columns = zip(*out) if out else [[]] * len(LEVEL)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "line" else pa.int64()) for n, c in zip(LEVEL, columns)], names=LEVEL)

    rows = hot.select("key", F.shiftright("who", 2).alias("id"), F.col("who").bitwiseAND(1).alias("probe")).distinct()
    lines = within_bits(level, F.xxhash64("id"), rows, F.xxhash64("id"), SLOT_WORDS)
    return rows.join(lines, "id").mapInArrow(run, ", ".join(f"{c} string" if c == "line" else f"{c} long" for c in LEVEL)).distinct()


def in_blocks(hot: DataFrame, lines: DataFrame, p: LineDedup) -> DataFrame:
    """Pairs (a, b) under keys that stay hot: every owner meets the key's rows of other labels behind the parity screen, dealt over tasks."""
    rows = hot.select("key", F.shiftright("who", 2).alias("id"), F.col("who").bitwiseAND(1).alias("probe")).distinct()
    rows = materialize(rows.join(lines.select("id", *CARRIED), "id"), "line-blocks")
    own = rows.where("probe = 0").select("key", F.col("id").alias("a"), *(F.col(c).alias(f"{c}_own") for c in CARRIED))
    differ = {c: F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_own"))) for c in CARRIED[1:]}
    near = (F.col("label") != F.col("label_own")) & (differ["chars"] <= 2 * p.edits) & (differ["pairs_a"] + differ["pairs_b"] <= 4 * p.edits)
    met = keyed_join(own, rows, ["key"]).where(near & ((F.col("probe") == 1) | (F.col("a") < F.col("id"))))
    return met.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))


def first_level(lines: DataFrame) -> DataFrame:
    """The level of whole lines (id, line, label), with their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([parities(x) for x in batch.column("line").to_pylist()], np.int64).reshape(-1, 3)
            fixed = [pa.array(np.full(batch.num_rows, v)) for v in (0, FULL, -1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("line"), *fixed, batch.column("label"), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=LEVEL)

    return lines.select("id", "line", "label").mapInArrow(run, ", ".join(f"{c} string" if c == "line" else f"{c} long" for c in LEVEL))


def candidates(lines: DataFrame, p: LineDedup) -> DataFrame:
    """Rows (key, id, probe, n, line, label and the parities) of ``lines`` (id, line, label): lines of a key that share a segment at places that
    fit, and pass the screen with ``n`` later rows of the key. There are as many as the index has rows at most, but for keys that
    stay hot, where each pair is a key of its own."""
    whole = level = materialize(first_level(lines), "line-level")
    found: list[DataFrame] = []
    for depth in range(p.levels):
        seen = Observation()
        met = materialize(meet(index(level, p), p).observe(seen, F.count_if("hot").alias("n_hot")), "line-met")
        found.append(met.where("not hot").select("key", F.shiftright("who", 2).alias("id"), F.col("who").bitwiseAND(1).alias("probe"), "n"))
        if not seen.get["n_hot"]:
            break
        mixed = met.where("hot").groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        hot = materialize(keyed_join(met.where("hot").select("key", "who"), mixed, ["key"]), "line-hot")
        if depth + 1 == p.levels:
            pairs = in_blocks(hot, whole, p).distinct()
            ends = F.array(*(F.struct(F.col(c).alias("id"), F.lit(i).cast("long").alias("probe"), F.lit(1 - i).cast("long").alias("n")) for i, c in enumerate("ab")))
            found.append(pairs.select(F.xxhash64("a", "b").alias("key"), F.explode(ends).alias("e")).select("key", "e.*"))
        else:
            level = materialize(refine(hot, level, p), "line-level")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    every = materialize(every, "line-keys")
    texts = within_bits(whole.select("id", "line", *CARRIED), F.xxhash64("id"), every, F.xxhash64("id"), SLOT_WORDS)
    return keyed_join(every, texts, ["id"]).select("key", "id", "probe", "n", "line", *CARRIED)


def stripped(points: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many characters pairs of texts share at their begin, and after that at their end; ``a``, ``b``: where the texts begin in ``points``, ``sizes``: of
    both (two rows)."""
    room = sizes.min(axis=0)
    counts = []
    for step in (1, -1):
        count, live = np.zeros(len(a), np.int64), np.flatnonzero(room > 0)
        while len(live):
            at = count[live]
            x, y = (a[live] + at, b[live] + at) if step == 1 else (a[live] + sizes[0, live] - 1 - at, b[live] + sizes[1, live] - 1 - at)
            live = live[points[x] == points[y]]
            count[live] += 1
            live = live[count[live] < room[live]]
        room = room - count
        counts.append(count)
    return counts[0], counts[1]


def links(met: DataFrame, p: LineDedup) -> DataFrame:
    """Links (a, b) among the rows that ``candidates`` gives: verified key by key (of ``group`` rows at most), a tree for each group of
    labels that links join in a batch of keys.

    What two lines share at both ends is found for all pairs of a batch at once; what differs is often the same for many.
    """
    columns = ["key", "id", "probe", *CARRIED]

    def linked(lines: list[str], keys: np.ndarray, ids: np.ndarray, probe: np.ndarray, label: np.ndarray, *parity: np.ndarray) -> Iterator[tuple[int, int]]:
        first = _starts(keys)
        ends = np.repeat(np.append(first[1:], len(keys)), np.diff(np.append(first, len(keys))))
        owners = np.flatnonzero(probe == 0)
        counts = ends[owners] - owners - 1
        a = np.repeat(owners, counts)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
        a, b = screened(a, b, label, *parity, p.edits)
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        starts = np.cumsum(sizes) - sizes
        front, back = stripped(points, starts[a], starts[b], np.stack([sizes[a], sizes[b]]))
        label, known = label.copy(), {}
        for x, y, begin, last_x, last_y in zip(*(c.tolist() for c in (a, b, front, sizes[a] - back, sizes[b] - back))):
            if label[x] == label[y]:
                continue
            rest = lines[x][begin:last_x], lines[y][begin:last_y]
            if (good := known.get(rest)) is None:
                good = known[rest] = within(*rest, p.edits)
            if good:
                label[label == label[y]] = label[x]
                yield min(ids[x], ids[y]), max(ids[x], ids[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            parts = ([left] if left is not None else []) + ([pa.Table.from_batches([batch])] if batch is not None else [])
            held = pa.concat_tables(parts) if parts else None
            if held is None or not held.num_rows:
                continue
            found = [held.column(c).to_numpy() for c in columns]
            stop = held.num_rows if batch is None else int(_starts(found[0])[-1])
            left = held.slice(stop)
            out = list(linked(held.column("line").slice(0, stop).to_pylist(), *(c[:stop] for c in found)))
            low, high = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    rows = met.select(*columns, "line").repartition("key").sortWithinPartitions("key", "probe")
    return rows.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, lines: DataFrame, p: LineDedup) -> DataFrame:
    """Those of the written ``pairs`` (a, b) whose lines are within the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = within_bits(lines.select("id", "line"), F.xxhash64("id"), ids, F.xxhash64("id"), SLOT_WORDS)
    both = keyed_join(pairs, texts.toDF("a", "line_a"), ["a"])
    both = keyed_join(both, texts.toDF("b", "line_b"), ["b"], hot=hot_keys(pairs, ["b"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within(x, y, p.edits) for x, y in zip(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "line_a", "line_b").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, p: LineDedup, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Different lines (id, _a, _b, line), and (id, component) of those that are linked.

    First every line is compared with the hub of each of its keys, then lines of different components that share a
    key with each other: so the links of a dense group are never listed, and none between components is lost.
    """
    different = occurrences(docs, p, key, text).groupBy("_a", "_b").agg(F.first("line").alias("line"))
    lines = materialize(different.select(F.monotonically_increasing_id().alias("id"), "_a", "_b", "line"), "lines")
    none = F.lit(0).cast("long")
    level = lines.select("id", "line", none.alias("scope"), F.lit(FULL).cast("long").alias("role"), F.lit(-1).cast("long").alias("partner"), *(none.alias(c) for c in CARRIED))
    pairs = materialize(hubs(index(level, p, carry=False)), "line-pairs")
    near = materialize(components(verified(materialize(pairs.where("a <> b"), "line-hubs"), lines, p), "line-classes"), "line-near")
    met = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    again = within_bits(lines.select("id", "line"), F.xxhash64("id"), met, F.xxhash64("id"), SLOT_WORDS).join(met, "id", "left_semi")
    again = again.join(near, "id", "left").select("id", "line", F.coalesce("component", "id").alias("label"))
    seen = Observation()
    more = materialize(links(candidates(again, p), p).observe(seen, F.count(F.lit(1)).alias("n")), "line-links")
    if seen.get["n"]:
        near = components(near.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), "line-classes")
    return lines, near


def dropped(docs: DataFrame, p: LineDedup, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, pos, first, n_near) of lines whose class has several occurrences or lines; ``first`` is the class's
    place, ``n_near`` the number of other lines in it. The shuffles of each written table are deleted before the next one's begin."""
    with settings(docs.sparkSession, SHUFFLES_GO):
        return _dropped(docs, p, key, text)


def _dropped(docs: DataFrame, p: LineDedup, key: str, text: str) -> DataFrame:
    lines, near = classes(docs, p, key, text)
    linked = within_bits(lines.select("id", "_a", "_b"), F.xxhash64("id"), near, F.xxhash64("id"), SLOT_WORDS).join(near, "id")
    marks = keyed_join(linked, near.groupBy("component").agg((F.count(F.lit(1)) - 1).alias("n_near")), ["component"], hot=hot_keys(near, ["component"]))
    seen = occurrences(docs, p, key, text).where("doc_id is not null").select("doc_id", "pos", "_a", "_b")
    at = seen.withColumn("_at", place()).groupBy("_a", "_b").agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count(F.lit(1)).alias("n"))
    total = Observation()
    at = at.observe(total, F.sum("n").alias("n")).join(marks.select("_a", "_b", "component", "n_near"), ["_a", "_b"], "left").where("first <> last or component is not null")
    at = materialize(at, "line-places")
    large = max((total.get["n"] or 0) // HOT_SHARE, HOT_ROWS)
    hot = [r["h"] for r in at.where(F.col("n") > large).select(F.xxhash64("_a", "_b").alias("h")).collect()]  # HOT_SHARE lines at most
    linked = at.where("component is not null")
    least = linked.groupBy("component").agg(F.min("first").alias("_least"))
    one = keyed_join(linked, least, ["component"]).select("_a", "_b", F.col("_least").alias("first"), "n_near")
    alone = at.where("component is null").select("_a", "_b", "first", F.lit(0).cast("long").alias("n_near"))
    return keyed_join(within_bits(seen, F.col("_a"), at, F.col("_a"), SLOT_WORDS), one.union(alone), ["_a", "_b"], hot=hot).select("doc_id", "pos", "first", "n_near")


def dedup(docs: DataFrame, p: LineDedup | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, n_near, class_id): of its lines that may be dropped, how many are, how many other
    lines are in their classes, and the first document that holds a line of their classes."""
    p = p or LineDedup()
    gone = dropped(docs, p, key, text).distinct()
    doc = F.floor(F.col("first") / (1 << 32)).cast("long")
    by = gone.groupBy("doc_id").agg(F.count_if(place() != F.col("first")).alias("_gone"), F.sum("n_near").alias("_links"), F.min(doc).alias("_class"))
    count = F.size(F.filter(F.split(F.col(text), "\n", -1), lambda x: F.length(x) >= p.least))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.when(F.col(text).isNull(), 0).otherwise(count).cast("long").alias("n_lines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.join(by, "doc_id", "left").select("doc_id", "n_lines", zero("_gone").alias("n_dropped"), zero("_links").alias("n_near"), F.coalesce("_class", "doc_id").alias("class_id"))


def clean(docs: DataFrame, p: LineDedup | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the dropped lines, n_chars (if there) renewed; a document that loses all its lines has an empty text."""
    p = p or LineDedup()
    gone, doc, kept = fresh("_gone", docs.columns), fresh("_doc", docs.columns), fresh("_kept", docs.columns)
    by = dropped(docs, p, key, text).where(place() != F.col("first")).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("pos").alias(gone))
    rows = docs.join(by, F.col(key) == F.col(doc), "left")
    whole = lambda lines: F.array_join(F.transform(F.col(kept), lambda i: F.get(lines, i)), "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(F.split(F.col(text), "\n", -1)) - 1), F.col(gone))
    rows = rows.withColumn(kept, F.when(F.col(gone).isNotNull(), places))
    rows = rows.withColumn(text, F.when(F.col(kept).isNull(), F.col(text)).otherwise(let(F.split(F.col(text), "\n", -1), whole))).drop(doc, gone, kept)
    return rows.withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast(rows.schema["n_chars"].dataType)) if "n_chars" in rows.columns else rows


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
