"""Change events: debounced flushes, in batch and as a stream, and the checks on results that come late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

QUIET_MS = (750, 100, 10_000)  #: default, least, greatest quiet time


def quiet(ms: int | None) -> str:
    """A quiet time as an interval, within its range."""
    default, low, high = QUIET_MS
    return f"{min(high, max(low, default if ms is None else ms))} milliseconds"


def flushes(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """(key, start, flush_at, n, reasons): one row for each burst of a key's events with no longer pause than gap.

    On a stream, give a watermark: events later than that are dropped, and a burst comes out once it has passed.
    """
    e = events.withWatermark("ts", watermark) if watermark else events
    g = e.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return g.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("flush_at"), "n", "reasons")


def start_flushes(events: DataFrame, gap: str, watermark: str, on_flush: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run flushes over a stream of events; on_flush gets each micro-batch of finished bursts, for instance to rebuild and diff."""
    return flushes(events, gap, watermark).writeStream.foreachBatch(on_flush).option("checkpointLocation", checkpoint).outputMode("append").start()


def current_results(results: DataFrame, active: DataFrame) -> DataFrame:
    """Results whose operation, mode and input signature are those of the active operation; others are stale."""
    return results.join(active, ["operation", "mode", "signature"], "left_semi")


def status(state: Column) -> Column:
    """(text, tone, may_refresh) of a lifecycle state."""
    # State, text, tone, whether a refresh may start.
    rows = (("no-layout", "No layout", "idle", False), ("initializing", "Initializing", "busy", False), ("fixed-clean", "Up to date", "ok", False), ("fixed-dirty", "Changes pending", "warn", True), ("refreshing", "Refreshing", "busy", False), ("renewing", "Renewing", "busy", False), ("error", "Error", "error", True))
    out = F.struct(F.lit("Unknown").alias("text"), F.lit("error").alias("tone"), F.lit(False).alias("may_refresh"))
    for name, text, tone, may in rows:
        out = F.when(state == name, F.struct(F.lit(text).alias("text"), F.lit(tone).alias("tone"), F.lit(may).alias("may_refresh"))).otherwise(out)
    return out


def next_state(state: Column, event: Column) -> Column:
    """The lifecycle state after an event; a pair that has no rule keeps the state."""
    # State, event, next state.
    rules = (("no-layout", "start", "initializing"), ("initializing", "done", "fixed-clean"), ("initializing", "fail", "error"), ("fixed-clean", "change", "fixed-dirty"), ("fixed-dirty", "start", "refreshing"), ("fixed-clean", "renew", "renewing"), ("fixed-dirty", "renew", "renewing"), ("refreshing", "done", "fixed-clean"), ("refreshing", "fail", "fixed-dirty"), ("renewing", "done", "fixed-clean"), ("renewing", "fail", "fixed-dirty"), ("error", "start", "initializing"))
    out = state
    for a, e, b in rules:
        out = F.when((state == a) & (event == e), b).otherwise(out)
    return out
