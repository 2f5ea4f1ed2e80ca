import functools
import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

from quartzframe.llm import conversation_repair as cr

DATA = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    clear = lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        role, text = clear(role), clear(text)
        kind = zlib.crc32(f"{clear(conv)}:{clear(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def brute(rows):
    """One conversation by a search over all states, as the text of the contract has it."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marks = set(), []
    for _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        marks.append("blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @functools.cache
    def best(at, roles):
        """Least (cost, edits, turns) from here on; roles: what the last initials allow."""
        found = []
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[roles]
        if at == len(rows):
            found = [(0, "", ())] if roles in ("", "a") else []
        else:
            _, role, text = rows[at]
            more = 3 if marks[at] == "truncated" else 0
            found.append(plus(best(at + 1, roles), 4, "D", ()))
            if marks[at] not in ("blank", "duplicate"):
                if role[:1] in follow and role[:1] in "sua" and role:
                    found.append(plus(best(at + 1, role[:1]), more, "K", ((role, text),)))
                found += [plus(best(at + 1, new[0]), 3 + more, "R", ((new, text),)) for new in ("user", "assistant") if new[0] in follow]
        # as many as three insertions here; a fourth never helps
        return min(x for x in found + inserted(at, roles, 3) if x) if any(found + inserted(at, roles, 3)) else None

    @functools.cache
    def ending(at, roles):
        return best(at, roles)

    def plus(rest, cost, mark, turns):
        return rest and (rest[0] + cost, mark + rest[1], (*turns, *rest[2]))

    def inserted(at, roles, most):
        out = []
        for n in range(1, most + 1):
            for news in itertools.product(("user", "assistant"), repeat=n):
                state, legal = roles, True
                for new in news:
                    legal &= new[0] in {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                    state = new[0]
                if legal:
                    out.append(plus(without_insertion(at, state), 3 * n, "I" * n, tuple((new, "") for new in news)))
        return [x for x in out if x]

    @functools.cache
    def without_insertion(at, roles):
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[roles]
        if at == len(rows):
            return (0, "", ()) if roles in ("", "a") else None
        _, role, text = rows[at]
        more = 3 if marks[at] == "truncated" else 0
        found = [plus(best(at + 1, roles), 4, "D", ())]
        if marks[at] not in ("blank", "duplicate"):
            if role and role[0] in "sua" and role[0] in follow:
                found.append(plus(best(at + 1, role[0]), more, "K", ((role, text),)))
            found += [plus(best(at + 1, new[0]), 3 + more, "R", ((new, text),)) for new in ("user", "assistant") if new[0] in follow]
        return min((x for x in found if x), default=None)

    cost, audit, turns = best(0, "")
    given = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
    return (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


def brute_table(rows, damaged):
    return {(conv, *brute([r[1:] for r in damaged if r[0] == conv])) for conv in {r[0] for r in rows}}


def some(n, seed, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "half a", " ", "", None, "Why?\n", "Yes. ", "naïve ☺", "a.\nb"]
    return [(conv, rng.choice([t, t, t, t + rng.randrange(3), None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)) for conv in range(n) for t in range(rng.randrange(1, longest))]


def test_against_a_full_search(spark):
    rows = some(60, 1) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes.")]
    damaged = list(brute_damage(rows))
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS conv", "1 AS pos", "2 AS block", "3 AS letter", "4 AS _at")
    assert sorted(map(repr, cr.damage(frame).collect())) == sorted(f"Row(conv_id={c!r}, turn={t!r}, role={r!r}, text={x!r})" for c, t, r, x in damaged)
    assert {tuple(r) for r in cr.repair(cr.damage(frame), frame).collect()} == brute_table(rows, damaged)


def test_pieces_join(spark, monkeypatch):
    monkeypatch.setattr(cr, "PIECE", 2)
    monkeypatch.setattr(cr, "FAN", 2)
    monkeypatch.setattr(cr, "BATCH", 5)
    rows = [(c, t, r or " ", x or " ") for c, t, r, x in some(25, 2, 24)]
    assert {tuple(r) for r in cr.repair(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_table(rows, rows)


def test_repeated_rows_ties_and_conversations_without_turns(spark):
    rows = [(1, 5, "user", "Same.")] * 40 + [(1, 5, "assistant", "Same.")] * 3 + [(2, None, "user", "A."), (2, None, "assistant", "B.")]
    every = spark.createDataFrame([(1,), (2,), (3,), (3,)], "conv_id long")
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.repair(spark.createDataFrame(rows, SCHEMA), every).collect()}
    assert got[1] == brute([r[1:] for r in rows[:43]]) and got[2] == brute([r[1:] for r in rows[43:]])
    assert got[3] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert cr.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_conversation(spark):
    """Thousands of turns in order need no edit; every tenth pair swapped costs what two turns cost."""
    rows = [(7, i, ("user", "assistant")[i % 2], f"Turn {i}. " + "x" * 500 + ".") for i in range(3000)]
    got = cr.repair(spark.createDataFrame(rows, SCHEMA)).first()
    assert got["cost"] == 0 and got["audit"] == "K" * 3000 and got["illegal"] == 0
    assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows).encode()).hexdigest()


def test_repaired_turns(spark):
    rows = [(c, t, r or " ", x or " ") for c, t, r, x in some(20, 3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = {r["conv_id"]: r["repaired_sha256"] for r in cr.repair(frame).collect()}
    texts = {}
    for r in sorted(cr.repaired_turns(frame).collect(), key=lambda r: (r["conv_id"], r["place"])):
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() for c in want} == want
    for turns in texts.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in turns))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_the_table(spark):
    frame = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in cr.op11_conversation_repair(spark, DATA).collect()} == brute_table(rows, list(brute_damage(rows)))
