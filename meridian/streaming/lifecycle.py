"""The lifecycle of layouts as a stream: one state a key, operations that end, fail, are cancelled or run out of time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

OUT = "key string, seq long, event string, operation string, state string, committed string, current string, outcome string"
STATE = "state string, committed string, current string, operation string, mode string, input string, until long"
RUNNING = ("initializing", "refreshing", "renewing")


@dataclass(frozen=True)
class Life:
    """committed: signature of the committed graph; current: of the newest; operation, mode, input: what runs, and the graph it works on; until: its last millisecond."""

    state: str = "no-layout"
    committed: str | None = None
    current: str | None = None
    operation: str | None = None
    mode: str | None = None
    input: str | None = None
    until: int | None = None


def settled(x: Life) -> Life:
    """Without an operation: clean if the committed graph is the newest, else dirty; no layout without a commit."""
    state = "no-layout" if x.committed is None else "fixed-clean" if x.committed == x.current else "fixed-dirty"
    return replace(x, state=state, operation=None, mode=None, input=None, until=None)


def step(x: Life, event: str, operation: str | None, signature: str | None, at: int, limit: int) -> tuple[Life, str]:
    """The state after an event, and what became of it.

    graph: the newest graph is `signature`; while an operation runs it goes on with the one it began with. start and renew begin an
    operation, unless one runs or there is no graph; start leaves a clean layout alone. done commits what the operation
    worked on, if it is the running one and names that graph, and leaves what came meanwhile as dirty; anything else is
    stale. fail and cancel go back to what was committed; without a commit, fail is an error, from which start leads on.
    """
    if event == "graph":
        x = replace(x, current=signature)
        return (x, "noted") if x.operation or x.state == "error" else (settled(x), "noted")
    if event in ("start", "renew"):
        if x.operation or x.current is None or operation is None or (event == "start" and x.state == "fixed-clean"):
            return x, "ignored"
        state = "initializing" if x.committed is None else "renewing" if event == "renew" else "refreshing"
        return replace(x, state=state, operation=operation, mode=event, input=x.current, until=at + limit), "started"
    if event in ("done", "fail", "cancel", "timeout"):
        if x.operation is None or (event != "timeout" and operation != x.operation) or (event == "done" and signature != x.input):
            return x, "stale"
        if event == "done":
            return settled(replace(x, committed=x.input)), "committed"
        if event == "fail" and x.committed is None:
            return replace(settled(x), state="error"), "failed"
        return settled(x), "rolled back"
    return x, "unknown"


def _row(key: str, seq: int | None, event: str, operation: str | None, x: Life, outcome: str) -> tuple:
    return (key, seq, event, operation, x.state, x.committed, x.current, outcome)


class Lifecycle(StatefulProcessor):
    """Rows (key, seq, at, event, operation, signature) of a key go through step() by seq; an operation over its time is rolled back by a timer."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("life", STATE)

    def _load(self) -> Life:
        return Life(*self.value.get()) if self.value.exists() else Life()

    def _keep(self, before: Life, after: Life) -> None:
        self.value.update(tuple(asdict(after).values()))
        if before.until != after.until:
            if before.until is not None:
                self.handle.deleteTimer(before.until)
            if after.until is not None:
                self.handle.registerTimer(after.until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = begun = self._load()
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").astype(object).itertuples(index=False):
            operation, signature = (None if pd.isna(v) else v for v in (r.operation, r.signature))
            at = int(pd.Timestamp(r.at).timestamp() * 1000)
            x, outcome = step(x, r.event, operation, signature, at, self.limit)
            out.append(_row(key[0], int(r.seq), r.event, operation, x, outcome))
        self._keep(begun, x)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._load()
        if before.until == expiredTimerInfo.getExpiryTimeInMs():
            x, outcome = step(before, "timeout", None, None, 0, self.limit)
            self.value.update(tuple(asdict(x).values()))
            yield pd.DataFrame([_row(key[0], None, "timeout", before.operation, x, outcome)], columns=[c.split()[0] for c in OUT.split(", ")])


def lifecycles(events: DataFrame, limit: int = 60_000, watermark: str = "10 seconds") -> DataFrame:
    """The stream of transitions (OUT) over a stream of events (key, seq, at, event, operation, signature); limit: most milliseconds of an operation.

    In a micro-batch a key's events go by seq; events later than the watermark are dropped. It needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    e = events.withWatermark("at", watermark)
    return e.groupBy("key").transformWithStateInPandas(Lifecycle(limit), StructType.fromDDL(OUT), "Append", "EventTime")


def replayed(events: list[tuple], limit: int = 60_000) -> list[tuple]:
    """The same transitions, without timers, of a small list of (key, seq, at_ms, event, operation, signature)."""
    lives: dict[str, Life] = {}
    out = []
    for key, seq, at, event, operation, signature in sorted(events, key=lambda e: (e[0], e[1])):
        lives[key], outcome = step(lives.get(key, Life()), event, operation, signature, at, limit)
        out.append(_row(key, seq, event, operation, lives[key], outcome))
    return out
