"""Repair of conversations to the role order that training takes, at least cost.

A conversation's roles have to read (s?(ua)+)? by their initials. Turns are kept, given another role, deleted or
inserted; a shortest path through the grammar's states finds the cheapest edits, of equal ones the ASCII-least. A turn is
one letter for its role and fault. Conversations are cut into pieces of ``PIECE`` turns, dealt by hash; a recursive query of DuckDB
goes through a batch of pieces, one turn of all at a time, and keeps the least (cost, audit) for each pair of begin and end
state. Pieces of a long conversation are put together by the same query, its steps being pieces, so no conversation needs to
meet in one task for it. Only the digest, which is sequential by nature, reads a conversation's turns one after another, as a sorted stream.

Equal costs at one turn can't have audits of which one begins the other (it would have more insertions and so cost more), so the
least audit of a part is part of the least whole.

Defined cases: nulls are one space, which is blank as a text and no role; a null conversation id is a conversation. Turns go by
number, nulls first, ties by role, the first 256 characters of the text and a hash. Repeated rows are duplicates. A role counts by
its first character only. Conversations of ``every`` without turns have zeros, an empty audit and the digest of
the empty string. Long texts are read whole. An empty table gives an empty result. Only the named columns are read,
so further columns never clash. Memory of a task grows with the longest audit, a letter or so for each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keyed_join, materialize, text_batches

#: Turns of a piece; pieces that are put together at once; letters that a query takes at once.
PIECE, FAN, BATCH = 64, 8, 16_384
#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: From a state, the initials that may follow and the states they lead to; E: nothing yet.
GRAMMAR = {"E": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
ACCEPTED, ROLES = "EA", {"u": "user", "a": "assistant"}
BLANK = r"^[\x20\x09-\x0D]*$"
MOVES = "array<struct<frm:string,to:string,cost:long,audit:string>>"

Best = dict[str, tuple[int, str]]


def insertions(state: str) -> Best:
    """Least (cost, audit) to each state by inserting turns."""
    found, todo = {state: (0, "")}, [state]
    while todo:
        cost, audit = found[at := todo.pop(0)]
        for initial in ROLES:
            to = GRAMMAR[at].get(initial)
            if to and (new := (cost + INSERT, audit + "I")) < found.get(to, (1 << 60, "")):
                found[to] = new
                todo.append(to)
    return found


def moves(state: str, letter: str) -> Best:
    """Least (cost, audit) to each state over insertions and then one turn. x: a turn that must go; upper case: a truncated one."""
    found: Best = {}
    more = TRUNCATED if letter.isupper() else 0
    for at, (cost, audit) in insertions(state).items():
        edits = [(at, DELETE, "D")]
        if letter != "x":
            edits += [(GRAMMAR[at][i], REROLE + more, "R") for i in ROLES if i in GRAMMAR[at]]
            edits += [(GRAMMAR[at][letter.lower()], more, "K")] if letter.lower() in GRAMMAR[at] else []
        for to, price, mark in edits:
            found[to] = min(found.get(to, (1 << 60, "")), (cost + price, audit + mark))
    return found


def last_insertions() -> Best:
    """Least (cost, audit) from each state to an accepted one."""
    return {s: min(v for to, v in insertions(s).items() if to in ACCEPTED) for s in GRAMMAR}


#: One step of all pieces at a time; steps (piece, place, frm, to, cost, audit), begins (piece, state), lengths (piece, n).
WALK = """
WITH RECURSIVE walk(piece, begin, state, place, best) AS (
    SELECT piece, state, state, 0, {'cost': 0::BIGINT, 'audit': ''} FROM begins
    UNION ALL
    SELECT w.piece, w.begin, s."to", w.place + 1, min({'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.audit})
    FROM walk w JOIN steps s ON s.piece = w.piece AND s.place = w.place AND s.frm = w.state
    GROUP BY w.piece, w.begin, s."to", w.place
)
SELECT piece, begin AS frm, state AS "to", best.cost AS cost, best.audit AS audit
FROM walk JOIN lengths USING (piece) WHERE place = n ORDER BY piece
"""
LETTER_STEPS = "SELECT p.piece, p.place, m.* FROM (SELECT piece, unnest(range(len(letters))) AS place, unnest(string_split(letters, '')) AS letter FROM pieces) p JOIN moves m USING (letter)"
PIECE_STEPS = "SELECT piece, place, unnest(part.moves, recursive := true) FROM (SELECT piece, unnest(range(len(parts))) AS place, unnest(parts) AS part FROM pieces)"


def _walked(pieces: DataFrame, column: str, steps: str, kind: str) -> DataFrame:
    """Rows (conv, block, blocks, moves) of pieces with the column ``letters`` or ``parts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        table = [{"frm": s, "letter": c, "to": to, "cost": cost, "audit": audit} for s in GRAMMAR for c in "suaoSUAOx" for to, (cost, audit) in moves(s, c).items()]
        con.register("moves", pa.Table.from_pylist(table))
        for batch in batches:
            sizes = pc.utf8_length(batch.column(column)) if kind == "letters" else pc.list_value_length(batch.column(column))
            at = 0
            for stop in _stops(sizes.to_pylist(), BATCH if kind == "letters" else FAN):
                part = batch.slice(at, stop - at)
                at = stop
                con.register("pieces", pa.table({"piece": pa.array(range(part.num_rows)), "block": part.column("block"), kind: part.column(column)}))
                con.execute(f"CREATE OR REPLACE TEMP TABLE steps AS {steps}")
                con.execute(f"CREATE OR REPLACE TEMP TABLE lengths AS SELECT piece, len({kind}) AS n FROM pieces")
                con.execute("CREATE OR REPLACE TEMP TABLE begins AS SELECT DISTINCT piece, frm AS state FROM pieces, (SELECT DISTINCT frm FROM moves) WHERE block > 0 OR frm = 'E'")
                found = con.execute(f"SELECT list({{'frm': frm, 'to': \"to\", 'cost': cost, 'audit': audit}}) AS moves FROM ({WALK}) GROUP BY piece ORDER BY piece").to_arrow_table().combine_chunks()
                yield pa.RecordBatch.from_arrays([part.column("conv"), part.column("block"), part.column("blocks"), found.column("moves").combine_chunks()], names=["conv", "block", "blocks", "moves"])

    return pieces.mapInArrow(run, f"conv string, block long, blocks long, moves {MOVES}")


def _stops(sizes: list[int], most: int) -> Iterator[int]:
    """Ends of runs of pieces that hold at most ``most`` together, or one piece."""
    held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield i
            held = 0
        held += n
    if sizes:
        yield len(sizes)


def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``rows`` (conv_id, turn, role, text) with faults that follow from crc32(`conv_id:turn`)."""
    clear = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(clear("conv_id"), F.lit(":"), clear("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(clear("text"), "[.!?]", "")).otherwise(clear("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    whole = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(clear("role")).alias("role"), text.alias("text"), copies.alias("_copy"))
    return whole.drop("_copy")


def placed_turns(rows: DataFrame) -> DataFrame:
    """Rows (conv, pos, turn, role, text) in a written table: pos counts all turns in order of conversation and place.

    Turns are dealt by ranges of that order, repeated rows by a number of their own, so no conversation or group of copies has to lie in one range.
    """
    clear = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), F.col("turn").cast("long").alias("turn"), clear("role"), clear("text"))
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 256), F.xxhash64("text"), F.col("_copy")]
    dealt = turns.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_copy")
    at = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "turns-dealt")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each range
    out = at.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.select("conv", (F.col("_before") + inside).alias("pos"), "turn", "role", "text")


def faults(turns: DataFrame) -> DataFrame:
    """Rows (conv, pos, letter, fault) of placed turns: the letter for the walk; b: blank, d: duplicate, t: truncated or empty."""
    first = turns.groupBy("conv", "role", F.sha2("text", 256).alias("_text")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin(*"sua"), initial).otherwise("o")
    rows = turns.select("conv", "pos", known.alias("_initial"), F.col("text").rlike(BLANK).alias("_blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*$(?!\n)")).alias("_cut"))
    fault = F.when(F.col("_blank"), "b").when(F.col("_first").isNull(), "d").when(F.col("_cut"), "t").otherwise("")
    letter = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper("_initial")).otherwise(F.col("_initial"))
    return rows.join(first, "pos", "left").select("conv", "pos", "_initial", fault.alias("fault")).select("conv", "pos", "fault", letter.alias("letter"))


def cheapest(letters: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows (conv, cost, audit) of rows (conv, pos, letter); heads (conv, base, n): first place and number of turns."""
    sized = heads.select("conv", "base", F.ceil(F.col("n") / PIECE).alias("blocks"))
    near = keyed_join(letters.select("conv", "pos", "letter"), sized, ["conv"])
    block = F.floor((F.col("pos") - F.col("base")) / PIECE).cast("long")
    spelled = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "")
    pieces = near.groupBy("conv", block.alias("block")).agg(F.first("blocks").alias("blocks"), spelled.alias("letters"))
    rest = materialize(_walked(pieces, "letters", LETTER_STEPS, "letters"), "turns-pieces")
    done = [rest.where("blocks = 1")]
    most = rest.agg(F.max("blocks")).first()[0] or 0
    while most > 1:
        of_more = rest.where("blocks > 1").groupBy("conv", F.floor(F.col("block") / FAN).cast("long").alias("block"))
        met = of_more.agg(F.first(F.ceil(F.col("blocks") / FAN)).alias("blocks"), F.sort_array(F.collect_list(F.struct("block", "moves"))).alias("parts"))
        rest = materialize(_walked(met, "parts", PIECE_STEPS, "parts"), "turns-pieces")
        done.append(rest.where("blocks = 1"))
        most = -(-most // FAN)
    ends = last_insertions()
    cost = F.create_map(*(F.lit(x) for s, (c, _) in ends.items() for x in (s, c)))
    audit = F.create_map(*(F.lit(x) for s, (_, a) in ends.items() for x in (s, a)))
    full = F.array_min(F.transform(F.filter("moves", lambda m: m["frm"] == "E"), lambda m: F.struct((m["cost"] + cost[m["to"]]).alias("cost"), F.concat(m["audit"], audit[m["to"]]).alias("audit"))))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select("conv", full.alias("_best")).select("conv", "_best.cost", "_best.audit")


class Mended:
    """A conversation whose turns come in order: gives the repaired ones and counts what needs the order."""

    def __init__(self, audit: str):
        self.edits, self.state = iter(audit), "E"
        self.low = self.high = None
        self.distinct = self.illegal = 0
        self.last: str | None = None

    def _inserted(self) -> tuple[str, str, str]:
        initial = "a" if self.state == "U" else "u"
        self.state = GRAMMAR[self.state][initial]
        return "I", ROLES[initial], ""

    def turn(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The repaired turns (edit, role, text) up to this one."""
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        while (edit := next(self.edits)) == "I":
            yield self._inserted()
        if edit == "R":
            _, role, _ = self._inserted()
            yield edit, role, text
        elif edit == "K":
            self.state = GRAMMAR[self.state][role[:1]]
            yield edit, role, text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for _ in self.edits:
            yield self._inserted()

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def _streamed(turns: DataFrame, heads: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Applies ``run`` to a stream of each conversation's head and then its turns, in order."""
    empty = {"conv_id": "long", "cost": "long", "audit": "string", "blank": "long", "duplicate": "long", "truncated": "long"}
    a = heads.select("conv", F.lit(-1).cast("long").alias("pos"), *empty, F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    b = turns.select("conv", "pos", *(F.lit(None).cast(t).alias(c) for c, t in empty.items()), "turn", "role", "text")
    return a.unionByName(b).repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(run, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    head, mended, digest, some = None, None, None, False
    out: list[tuple] = []

    def put(turns: Iterator[tuple[str, str, str]]) -> None:
        nonlocal some
        for _, role, text in turns:
            digest.update(f"{chr(10) * some}{role}:{text}".encode())
            some = True

    def close() -> None:
        put(mended.rest())
        out.append((head["conv_id"], mended.gaps(), head["blank"], head["duplicate"], head["truncated"], mended.illegal, head["cost"], head["audit"], digest.hexdigest()))

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
        out.clear()
        return rows

    for batch in batches:
        for r in batch.to_pylist():
            if r["pos"] < 0:
                if head:
                    close()
                head, mended, digest, some = r, Mended(r["audit"]), hashlib.sha256(), False
            else:
                put(mended.turn(r["turn"], r["role"], r["text"]))
        yield flush()
    if head:
        close()
        yield flush()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["conv_id", "place", "edit", "role", "text"], [pa.int64()] * 2 + [pa.string()] * 3
    head, mended, place = None, None, 0

    for batch in batches:
        out = []

        def put(turns: Iterator[tuple[str, str, str]], out: list = out) -> None:
            nonlocal place
            for turn in turns:
                out.append((head["conv_id"], place, *turn))
                place += 1

        for r in batch.to_pylist():
            if r["pos"] < 0:
                if head:
                    put(mended.rest())
                head, mended, place = r, Mended(r["audit"]), 0
            else:
                put(mended.turn(r["turn"], r["role"], r["text"]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
    if head and (rest := [(head["conv_id"], place + i, *t) for i, t in enumerate(mended.rest())]):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rest], t) for i, t in enumerate(kinds)], names=names)


def _planned(rows: DataFrame, every: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The placed turns and the conversations' heads with cost and audit."""
    text_batches(rows.sparkSession)
    turns = placed_turns(rows)
    marked = materialize(faults(turns), "turns-marked")
    count = lambda f: F.sum((F.col("fault") == f).cast("long"))
    heads = marked.groupBy("conv").agg(F.min("pos").alias("base"), F.count(F.lit(1)).alias("n"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))
    best = cheapest(marked, heads)
    named = (every if every is not None else rows).select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    counts = ["blank", "duplicate", "truncated", "cost"]
    full = named.join(heads.drop("base", "n"), "conv", "left").join(best, "conv", "left").na.fill(0, counts).na.fill("", ["audit"])
    return turns, full


def repair(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of ``rows`` (conv_id, turn, role, text), or of ``every``: gaps, faults, cost, audit and digest of the repair."""
    turns, heads = _planned(rows, every)
    return _streamed(turns, heads, _digests, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: rows (conv_id, place, edit, role, text), edit K, R or I."""
    turns, heads = _planned(rows, None)
    return _streamed(turns, heads, _texts, "conv_id long, place long, edit string, role string, text string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damage(rows), rows)
