"""Sessions of actions as keyed state: ordered revisions, replayed actions, refusals, and an end after idle time.

Each action names the revision that it was made for. It is taken if the session is active and at that revision; then the revision
grows by one and the outcome is remembered under the action's id. The same action sent again gets the remembered outcome; another action under
that id is a conflict. Refused actions change nothing and aren't remembered. A log gives the same outcomes in whatever batches it arrives,
as long as a session's actions arrive in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Kinds of actions with their payload, zoom levels, remembered outcomes of a session, lengths.
PAYLOADS = {
    "select_corner": ("index",),
    "move": ("dx", "dy"),
    "set_corner": ("index", "x", "y"),
    "set_zoom": ("zoom",),
    "candidate": (),
    "v52": (),
    "reset": (),
    "skip": ("reason",),
    "previous": (),
    "next": (),
    "confirm": (),
    "pause": (),
    "quit": (),
}
ZOOMS = (2, 4, 8, 16)
REMEMBERED, ID_LENGTH, REASON_LENGTH = 256, 128, 256

FIELDS = ("index", "dx", "dy", "x", "y", "zoom", "reason")
NAMES = ("revision", "place", "status", "corner", "zoom", "seen")
STATE = "revision long, place long, status string, corner long, zoom long, seen long, outcomes array<struct<action_id: string, mark: string, revision: long, place: long, status: string>>"
OUTPUT = "session string, seq long, action_id string, outcome string, revision long, place long, status string"
OUTCOME = Row(*[c.split()[0] for c in OUTPUT.split(", ")])


def action_fault() -> Column:
    """Why an action (action_id, expected_revision, kind and a column for each payload field) can't be taken in any state; null if it may."""
    given = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), f) for f in FIELDS]))
    allowed = F.create_map(*[x for k, fields in PAYLOADS.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in FIELDS if f in fields]).cast("array<string>"))])
    shape = F.coalesce(given == allowed[F.col("kind")], F.lit(False))
    in_range = F.coalesce(F.col("index").between(0, 3), F.lit(True)) & F.coalesce(F.col("zoom").isin(*ZOOMS), F.lit(True))
    reason = F.coalesce(F.col("reason").rlike(r"(?U)\S") & (F.length("reason") <= REASON_LENGTH), F.lit(True))
    named = F.coalesce(F.length("action_id").between(1, ID_LENGTH), F.lit(False))
    return F.when(~named, "invalid_action_id").when(F.col("expected_revision").isNull(), "invalid_revision").when(~(shape & in_range & reason), "invalid_action")


def fingerprint() -> Column:
    """What makes an action the same one: expected revision, kind and payload."""
    return F.sha2(F.to_json(F.struct("expected_revision", "kind", *FIELDS)), 256)


def applied(state: dict, kind: str, action: dict, items: int) -> str | None:
    """Changes an active session's state by an action; why it is refused, else none."""
    place, corner = state["place"], state["corner"]
    if kind in ("select_corner", "set_corner"):
        state["corner"] = action["index"]
    elif kind == "move" and corner < 0:
        return "action_rejected"
    elif kind == "set_zoom":
        state["zoom"] = action["zoom"]
    elif kind in ("previous", "next"):
        place += 1 if kind == "next" else -1
        if not 0 <= place < items:
            return "navigation_boundary"
        state.update(place=place, corner=-1)
    elif kind in ("skip", "confirm"):
        state.update(status="completed") if place + 1 == items else state.update(place=place + 1, corner=-1)
    elif kind in ("pause", "quit"):
        state["status"] = kind
    return None


class Sessions(StatefulProcessor):
    """State of a session: one value with its last remembered outcomes, the oldest first, so that a batch reads and writes it once however many actions it has."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("session", STATE)

    def _dispatched(self, state: dict, outcomes: dict, a: dict) -> tuple:
        """(outcome, revision, place, status) of an action; ``outcomes`` by action id, in the order of their revisions."""
        after = lambda outcome: (outcome, state["revision"], state["place"], state["status"])
        if self.idle_ms and state["seen"] is not None and state["status"] == "active" and a["at"] - state["seen"] > self.idle_ms:
            state["status"] = "expired"
        state["seen"] = max(a["at"], state["seen"] or 0) if self.idle_ms else None
        if a["fault"]:
            return after(a["fault"])
        if state["status"] == "expired":
            return after("session_stopped")
        if known := outcomes.get(a["action_id"]):
            mark, *before = known
            return ("replayed", *before) if mark == a["mark"] else after("action_id_conflict")
        if state["status"] != "active":
            return after("session_stopped")
        if a["expected_revision"] != state["revision"]:
            return after("stale_revision")
        if refused := applied(state, a["kind"], a, a["items"]):
            return after(refused)
        state["revision"] += 1
        outcomes[a["action_id"]] = (a["mark"], state["revision"], state["place"], state["status"])
        if len(outcomes) > REMEMBERED:
            del outcomes[next(iter(outcomes))]
        return after("ok")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        actions = sorted((r.asDict() for r in rows), key=lambda a: (a["seq"] is None, a["seq"] or 0))
        *values, kept = self.now.get() or (0, 0, "active", -1, ZOOMS[0], None, [])
        state, outcomes = dict(zip(NAMES, values)), {r[0]: tuple(r[1:]) for r in kept}
        made = [OUTCOME(key[0], a["seq"], a["action_id"], *self._dispatched(state, outcomes, a)) for a in actions]
        self.now.update((*[state[n] for n in NAMES], [(k, *v) for k, v in outcomes.items()]))
        if self.idle_ms and state["status"] == "active":
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(state["seen"] + self.idle_ms + 1))
        return iter(made)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        revision, place, status, corner, zoom, seen, _ = self.now.get()
        if status == "active" and expiredTimerInfo.getExpiryTimeInMs() > seen + self.idle_ms:
            self.now.update((revision, place, "expired", corner, zoom, seen, []))
            yield OUTCOME(key[0], None, None, "expired", revision, place, "expired")

    def close(self) -> None:
        pass


def dispatched(actions: DataFrame, idle_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """The outcome of every action of a stream (session, seq, action_id, expected_revision, kind, items, ts and FIELDS).

    ``idle_ms``: a session without an action for longer has expired; a timer of event time ends it, and an action that comes after that time finds
    it so whether the timer has gone off or not. Needs RocksDB as the state store's provider.
    """
    told = [F.coalesce(F.col(f), F.lit(-1)).cast("long").alias(f) for f in ("index", "zoom")]  # of the payload, only these change a state
    marked = actions.select("session", "seq", "action_id", "expected_revision", "kind", "items", *told, action_fault().alias("fault"), fingerprint().alias("mark"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("ts").cast("timestamp").alias("ts"))
    timed = marked.withWatermark("ts", late) if idle_ms else marked.drop("ts")
    return timed.groupBy("session").transformWithState(statefulProcessor=Sessions(idle_ms), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime" if idle_ms else "None")


def final_states(outcomes: DataFrame) -> DataFrame:
    """Rows (session, revision, place, status, taken, refused) from all outcomes: where each session stands. A remembered outcome is of an earlier state."""
    last = F.max_by(F.struct("revision", "place", "status"), F.struct(F.col("seq").isNull(), "seq")).alias("_last")
    own = outcomes.withColumn("_refused", ~F.col("outcome").isin("ok", "replayed", "expired"))
    counts = own.groupBy("session").agg(F.count_if(F.col("outcome") == "ok").alias("taken"), F.count_if(F.col("outcome") == "replayed").alias("replayed"), F.count_if("_refused").alias("refused"))
    state = own.where("outcome <> 'replayed'").groupBy("session").agg(last).select("session", "_last.*")
    return counts.join(state, "session").select("session", "revision", "place", "status", "taken", "replayed", "refused")
