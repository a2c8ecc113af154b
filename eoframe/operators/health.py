"""Service-health state over a call log: the circuit rule "three failures in a row open a service for ten seconds".

The rule is sequential per service, and one service may hold a third of all calls, so a service is never replayed in one
task. Its log is cut into chunks of so many calls, and each chunk is first summarised as a *transition*: for every state a
chunk can be entered in, the state it is left in. Closed states are few; an open service matters only through the first call
after its pause, so open entries are ranges over the calls of one pause length, with equal outcomes merged. Two transitions
that follow each other compose to one of the same form, so chunks are folded as a tree of ``FAN`` children a node:

1. (service, chunk)           -> transition                          parallel
2. up:   (service, node)      -> transition of its children          parallel, a round per level
3. down: (service, node)      -> entry state of each of its children parallel, a round per level
4. (service, chunk)           -> decision of every call              parallel

No task holds more than one chunk or ``FAN`` transitions, whatever a service's log.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.config import HealthConfig
from eoframe.functions.positions import with_positions
from eoframe.session import materialize

TRANSITION = "service bigint, node bigint, first_ms bigint, entry int, upto_ms bigint, leave int, leave_ms bigint"
ENTRY = "service bigint, node bigint, entry int, opened_ms bigint"
DECISION = "service bigint, event_id bigint, ts_ms bigint, ok int, decision string, state string, transition string"
CHUNK, FAN = 4096, 64
#: Calls without a time come after all others; they stand at times from here on, a pause apart, so none is within another's pause.
FAR = 1 << 61


def _transitions(ts: np.ndarray, ok: np.ndarray, limit: int, pause: int) -> list[tuple[int, int, int, int]]:
    """(entry, upto_ms, leave, leave_ms) rows. States 0..limit-1 are closed with that many failures, ``limit`` is open
    since ``leave_ms``. Open entries apply while the pause ends no later than ``upto_ms``."""
    n = len(ts)
    after = np.searchsorted(ts, ts + pause, side="left")  # first call after a pause that starts at each call
    # leave codes: below limit a closed state, limit + i means open since call i
    nxt = np.arange(limit)
    opened = np.zeros(n, dtype=np.int64)
    probe = np.zeros(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        j = after[i]
        opened[i] = limit + i if j == n else probe[j]
        probe[i] = nxt[0] if ok[i] else opened[i]
        nxt = np.full(limit, nxt[0]) if ok[i] else np.append(nxt[1:], opened[i])

    def row(entry: int, upto: int, code: int) -> tuple[int, int, int, int]:
        return (entry, upto, min(int(code), limit), int(ts[code - limit]) if code >= limit else 0)

    rows = [row(f, 0, nxt[f]) for f in range(limit)]
    last = min(int(after[0]), n - 1)
    firsts = [p for p in range(last + 1) if p == 0 or ts[p] != ts[p - 1]]  # of calls at one time a pause ends at the first
    for p, follower in zip(firsts, [*firsts[1:], None]):
        if follower is None or probe[follower] != probe[p]:
            rows.append(row(limit, int(ts[p]), probe[p]))
    return rows


class Transition:
    """What a stretch of calls makes of every entry state: of 0 .. limit - 1 failures, and of open, by when the pause ends."""

    def __init__(self, first_ms: int, closed: list[tuple[int, int]], opened: list[tuple[int, int, int]]):
        self.first_ms, self.closed, self.opened = first_ms, closed, opened

    @staticmethod
    def read(part: pd.DataFrame, limit: int) -> list[Transition]:
        """The transitions of a table, by node."""
        out = []
        for _, rows in part.sort_values(["node", "entry", "upto_ms"]).groupby("node", sort=True):
            held = list(zip(rows["entry"].tolist(), rows["upto_ms"].tolist(), rows["leave"].tolist(), rows["leave_ms"].tolist()))
            closed, opened = [r[2:] for r in held if r[0] < limit], [r[1:] for r in held if r[0] == limit]
            out.append(Transition(int(rows["first_ms"].iloc[0]), closed, opened))
        return out

    def rows(self) -> list[tuple[int, int, int, int, int]]:
        held = [(entry, 0, *to) for entry, to in enumerate(self.closed)] + [(len(self.closed), *row) for row in self.opened]
        return [(self.first_ms, *row) for row in held]

    def apply(self, state: int, since: int, pause: int) -> tuple[int, int]:
        if state < len(self.closed):
            return self.closed[state]
        i = bisect_left(self.opened, since + pause, key=lambda row: row[0])
        return self.opened[i][1:] if i < len(self.opened) else (state, since)  # the pause outlasts the stretch

    def then(self, after: Transition, pause: int) -> Transition:
        """Both stretches as one. A pause that outlasts the first one ends in the second; none ends later than a pause after the
        first call, so the open entries stay as many as the calls of one pause."""
        closed = [after.apply(*to, pause) for to in self.closed]
        opened = [(upto, *after.apply(*to, pause)) for upto, *to in self.opened]
        last = self.opened[-1][0] if self.opened else self.first_ms - 1
        if last < self.first_ms + pause:
            opened += [row for row in after.opened if row[0] > last]
        merged: list[tuple[int, int, int]] = []
        for row in opened:
            if merged and merged[-1][0] >= self.first_ms + pause:
                break
            if merged and merged[-1][1:] == row[1:]:
                merged.pop()
            merged.append(row)
        return Transition(self.first_ms, closed, merged)


def step(state: int, since: int, ts: int, ok: bool, limit: int, pause: int) -> tuple[int, int, str, str]:
    """One call: (state, opened_ms, decision, transition)."""
    if state == limit:
        if ts - since < pause:
            return state, since, "rejected", ""
        if ok:
            return 0, 0, "executed", "OPEN>HALF_OPEN>CLOSED"
        return limit, ts, "executed", "OPEN>HALF_OPEN>OPEN"
    if ok:
        return 0, 0, "executed", ""
    if state + 1 >= limit:
        return limit, ts, "executed", "CLOSED>OPEN"
    return state + 1, 0, "executed", ""


def replay(calls: pd.DataFrame, state: int, since: int, limit: int, pause: int) -> tuple[pd.DataFrame, int, int]:
    """Decisions for calls in time order from a given state, and the state afterwards."""
    decisions, states, moves = [], [], []
    for ts, ok in zip(calls["ts_ms"].to_numpy(), calls["ok"].to_numpy()):
        state, since, decision, move = step(state, since, int(ts), bool(ok), limit, pause)
        decisions.append(decision)
        states.append("OPEN" if state == limit else "CLOSED")
        moves.append(move)
    out = calls[["service", "event_id", "ts_ms", "ok"]].assign(decision=decisions, state=states, transition=moves)
    return out, state, since


def service_health(calls: DataFrame, cfg: HealthConfig | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Decision, state and transition of every call over (service, event_id, ts_ms, ok), ordered by (ts_ms, event_id), nulls last.

    Places are given once and written, so all rounds replay calls that tie in one order. ``pos`` is the call's place in its service.
    """
    cfg = cfg or HealthConfig()
    limit, pause = cfg.failure_threshold, cfg.recovery_ms
    log = with_positions(typed_calls(calls), ["no_ts", "ts_ms", "no_id", "event_id"], ["service"])
    log = log.withColumns({
        "ts_ms": F.when(F.col("no_ts"), F.lit(FAR) + F.col("pos") * pause).otherwise(F.col("ts_ms")), "node": F.floor(F.col("pos") / chunk)})
    log = materialize(log.drop("no_ts"), "health-chunks")

    def summarise(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        first = int(pdf["ts_ms"].iloc[0])
        rows = _transitions(pdf["ts_ms"].to_numpy(), pdf["ok"].to_numpy(), limit, pause)
        return pd.DataFrame([(*key, first, *r) for r in rows], columns=_names(TRANSITION))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out = replay(pdf, int(pdf["entry"].iloc[0]), int(pdf["opened_ms"].iloc[0]), limit, pause)[0]
        return out.assign(no_id=pdf["no_id"], pos=pdf["pos"])

    table = materialize(log.groupBy("service", "node").applyInPandas(summarise, TRANSITION), "health-transitions")
    entries = entry_states(table, limit, pause, fan)
    decided = log.join(entries, ["service", "node"]).groupBy("service", "node").applyInPandas(decide, f"{DECISION}, no_id boolean, pos bigint")
    return with_nulls(decided)


def typed_calls(calls: DataFrame) -> DataFrame:
    """Calls of a named service; absent times and ids are zero and told by ``no_ts`` and ``no_id``, so that pandas keeps whole numbers."""
    whole = calls.where(F.col("service").isNotNull()).select(
        *[F.col(c).cast("bigint").alias(c) for c in ("service", "event_id", "ts_ms")], F.col("ok").cast("int").alias("ok"))
    told = whole.withColumns({"no_ts": F.col("ts_ms").isNull(), "no_id": F.col("event_id").isNull()})
    return told.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("event_id", "ts_ms")})


def with_nulls(decided: DataFrame) -> DataFrame:
    return decided.withColumns({
        "event_id": F.when(~F.col("no_id"), F.col("event_id")), "ts_ms": F.when(F.col("ts_ms") < FAR, F.col("ts_ms"))}).drop("no_id")


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


def under_parent(table: DataFrame, fan: int) -> DataFrame:
    return table.withColumn("parent", F.floor(F.col("node") / fan))


def entry_states(table: DataFrame, limit: int, pause: int, fan: int = FAN) -> DataFrame:
    """The state in which each chunk is entered, from the chunks' transitions (numbered from 0 within a service)."""

    def fold(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        whole = reduce(lambda a, b: a.then(b, pause), Transition.read(pdf, limit))
        return pd.DataFrame([(*key, *r) for r in whole.rows()], columns=_names(TRANSITION))

    def unfold(key: tuple[Any, ...], children: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        state, out = (int(entry["entry"].iloc[0]), int(entry["opened_ms"].iloc[0])), []
        for node, child in zip(sorted(children["node"].unique()), Transition.read(children, limit)):
            out.append((key[0], int(node), *state))
            state = child.apply(*state, pause)
        return pd.DataFrame(out, columns=_names(ENTRY))

    levels, last = [table], table.agg(F.max("node")).first()[0] or 0
    while last >= fan:
        upper = under_parent(levels[-1], fan).groupBy("service", "parent").applyInPandas(fold, TRANSITION)
        levels.append(materialize(upper, "health-level"))
        last //= fan
    start = [F.lit(0).cast(t).alias(n) for n, t in (("node", "bigint"), ("entry", "int"), ("opened_ms", "bigint"))]
    entries = levels[-1].select("service").distinct().select("service", *start)
    for level in reversed(levels):
        above = entries.withColumnsRenamed({"service": "e_service", "node": "e_node"})  # told apart, as both sides come from one
        children = under_parent(level, fan).groupBy("service", "parent")
        entries = children.cogroup(above.groupBy("e_service", "e_node")).applyInPandas(unfold, ENTRY)
        if level is not levels[0]:
            entries = materialize(entries, "health-entries")
    return entries


def health_summary(decisions: DataFrame) -> DataFrame:
    """Calls, outcomes, rejections and transitions per service (map-side combined)."""
    done, ok = F.col("decision") == "executed", F.col("ok") == 1
    return decisions.groupBy("service").agg(
        F.count_if(done).alias("total_calls"), F.count_if(done & ok).alias("total_successes"),
        F.count_if(done & ~ok).alias("total_failures"), F.count_if(~done).alias("total_rejected"),
        F.sum(F.length("transition") - F.length(F.replace("transition", F.lit(">"), F.lit("")))).alias("n_transitions"),
        F.max_by("state", "pos").alias("last_state"),
    )
