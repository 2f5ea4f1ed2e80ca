import datetime as dt
import random

import pytest
from pyspark.sql import Row

from quartzframe.streaming import sessions as se

COLUMNS = "session string, seq long, action_id string, expected_revision long, kind string, items int, ts timestamp, index long, dx long, dy long, x long, y long, zoom long, reason string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BASE = dt.datetime(2024, 1, 1)


def action(session, seq, action_id, revision, kind, at=None, items=4, **payload):
    return (session, seq, action_id, revision, kind, items, BASE + dt.timedelta(seconds=seq if at is None else at), *[payload.get(f) for f in se.FIELDS])


@pytest.fixture
def run(spark, tmp_path):
    """Outcomes of batches of actions, the stream stopped and started again between any two."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def go(batches, name="a", **kinds):
        folder = f"{tmp_path}/{name}"
        for rows in batches:
            log = spark.createDataFrame(rows, COLUMNS)
            log.write.mode("append").parquet(f"{folder}/log")
            out = se.dispatched(spark.readStream.schema(log.schema).parquet(f"{folder}/log"), **kinds)
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{folder}/out")

    yield go
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_outcomes(run):
    rows = [
        action("s", 1, "a", 0, "next"),
        action("s", 2, "a", 0, "next"),  # sent again
        action("s", 3, "a", 0, "previous"),  # its id for something else
        action("s", 4, "b", 0, "next"),  # made for an old revision
        action("s", 5, "c", 1, "move", dx=1, dy=1),  # no corner is selected
        action("s", 6, "d", 1, "select_corner", index=4),
        action("s", 7, "e", 1, "select_corner", index=3),
        action("s", 8, "f", 2, "move", dx=1, dy=1),
        action("s", 9, "g", 3, "set_zoom", zoom=3),
        action("s", 10, "h", 3, "skip", reason=" \t"),
        action("s", 11, "h", 3, "skip", reason="blurred"),
        action("s", 12, "i", 4, "confirm"),
        action("s", 13, "", 5, "confirm"),
        action("s", 14, "j", 5, "next"),  # behind the last
        action("s", 15, "k", 5, "confirm"),
        action("s", 16, "l", 6, "previous"),
        action("s", 17, "k", 5, "confirm"),
        action("t", 1, "a", 0, "previous"),
        action("t", 2, "a", None, "next"),
        action("t", 3, "b", 0, "next", index=1),
        action("t", 4, "c", 0, "quit"),
    ]
    got = {(r["session"], r["seq"]): (r["outcome"], r["revision"], r["place"], r["status"]) for r in run([rows]).collect()}
    want = ["ok", "replayed", "action_id_conflict", "stale_revision", "action_rejected", "invalid_action", "ok", "ok", "invalid_action", "invalid_action", "ok", "ok", "invalid_action_id", "navigation_boundary", "ok", "session_stopped", "replayed"]
    assert [got["s", i][0] for i in range(1, 18)] == want
    assert got["s", 15] == ("ok", 6, 3, "completed") and got["s", 2] == ("replayed", 1, 1, "active")
    assert [got["t", i][0] for i in range(1, 5)] == ["navigation_boundary", "invalid_revision", "invalid_action", "ok"] and got["t", 4][3] == "quit"


def test_any_batches_give_the_same(run):
    rng = random.Random(3)
    rows = []
    for s in range(5):
        for i in range(40):
            kind = rng.choice(["next", "previous", "confirm", "reset", "pause" if i > 30 else "next"])
            rows.append(action(f"s{s}", i, f"a{rng.randrange(30)}", rng.choice([i // 3, i // 2, i // 3 - 1]), kind, items=6))
    rows.sort(key=lambda r: r[1])
    whole = run([rows], "whole")
    some = run([rows[:37], rows[37:90], rows[90:91], rows[91:]], "some")
    key = lambda t: sorted(map(repr, t.collect()))
    assert key(whole) == key(some) and key(se.final_states(whole)) == key(se.final_states(some))
    assert {"ok", "replayed", "stale_revision", "action_id_conflict"} <= {r["outcome"] for r in whole.collect()}


def test_old_outcomes_are_forgotten(run, monkeypatch):
    rows = [action("s", i, f"a{i}", i, "reset") for i in range(se.REMEMBERED + 2)]
    late = [action("s", 1000, "a1", 1, "reset"), action("s", 1001, "a2", 2, "reset")]
    got = {r["seq"]: r["outcome"] for r in run([rows, late]).collect()}
    assert got[1000] == "stale_revision" and got[1001] == "replayed"


def test_idle_sessions_expire(run):
    first = [action("s", 1, "a", 0, "next", at=0), action("t", 1, "a", 0, "next", at=0)]
    later = [action("s", 2, "b", 1, "next", at=50), action("u", 1, "a", 0, "next", at=100_000)]
    last = [action("u", 2, "b", 1, "next", at=100_001), action("s", 3, "c", 2, "next", at=100_000), action("s", 4, "b", 1, "next", at=100_000)]
    out = run([first, later, last], idle_ms=60_000, late="10 seconds")
    got = {(r["session"], r["seq"]): r["outcome"] for r in out.collect()}
    assert got["s", 2] == "ok" and got["u", 2] == "ok" and got["s", 3] == got["s", 4] == "session_stopped"
    assert got["t", None] == "expired"
    assert {r["session"]: r["status"] for r in se.final_states(out).collect()} == {"s": "expired", "t": "expired", "u": "active"}


def test_a_batch_reads_and_writes_state_once():
    """Before, each action asked the state store up to six times."""
    calls = []

    class Value:
        def __init__(self):
            self.value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return Value()

    names = ("session", "seq", "action_id", "expected_revision", "kind", "items", "index", "zoom", "fault", "mark", "at")
    rows = [Row(**dict(zip(names, ("s", i, f"a{i}", i, "reset", 4, -1, -1, None, f"m{i}", i)))) for i in range(600)]
    sessions = se.Sessions(None)
    sessions.init(Handle())
    made = [*sessions.handleInputRows(("s",), iter(rows[:300]), None), *sessions.handleInputRows(("s",), iter(rows[300:]), None)]
    assert [r["outcome"] for r in made] == ["ok"] * 600 and made[-1]["revision"] == 600
    assert calls == ["get", "update"] * 2
    assert [k for k, *_ in sessions.now.value[-1]] == [f"a{i}" for i in range(600 - se.REMEMBERED, 600)]
