"""The tracker and the lifecycle as streams, equal to what a batch over all events gives."""

import random

from pyspark.sql import functions as F

from meridian.operators import diff as D
from meridian.operators import graph as G
from meridian.sources.state import StateStore
from meridian.streaming import lifecycle
from meridian.streaming.tracker import GraphTracker


def test_flushes_rebuild_what_was_touched(spark, tmp_path):
    world = {"notes": {"a", "b", "c", "d"}, "links": {("a", "b"): 1.0, ("b", "a"): 2.0, ("b", "c"): 1.0, ("c", "gone"): 4.0}}
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    seen = []
    t = GraphTracker(
        StateStore(spark, str(tmp_path / "s")),
        lambda ids: frame([(n,) for n in world["notes"]], "id string"),
        lambda ids: frame([(a, b, w) for (a, b), w in world["links"].items() if a in world["notes"]], "src string, dst string, w double"),
        lambda n, e: seen.append((sorted(map(tuple, n.collect())), sorted((r.kind, r.src_id, r.dst_id) for r in e.collect()))),
        lambda ids: seen.append(sorted(map(tuple, ids.selectExpr("id", "array_join(reasons, ',')").collect()))),
    )
    events = lambda *ids: frame([(i, ["changed"]) for i in ids], "key string, reasons array<string>")
    t.flush(events("a", "b", "c", "d"), 0)
    assert seen[-1] == ([("added", x) for x in "abcd"], [("added", "a", "b"), ("added", "b", "c")])
    t.flush(events("a", "a"), 1)
    assert seen[-1] == [("a", "changed")]
    world["links"][("a", "b")] = 5.0
    world["notes"] = {"a", "b", "c", "gone"}
    t.flush(events("a", "d", "gone"), 2)
    assert seen[-1] == ([("added", "gone"), ("removed", "d")], [("added", "c", "gone"), ("changed", "a", "b")])
    n = len(seen)
    t.flush(events("a"), 2)  # a batch that is sent again
    assert len(seen) == n
    now = G.canonical_edges(G.linked_notes(G.valid_links(t.links_of(None)), t.notes_of(None)))
    assert D.edge_diff(now, t.edges()).count() == 0 and now.count() == 3


def some_events(rng):
    out = []
    for key in ("k1", "k2", "k3"):
        op = 0
        for seq in range(60):
            event = rng.choice(["graph", "graph", "start", "renew", "done", "done", "fail", "cancel", "cancel", "cancel", "odd"])
            op += event in ("start", "renew")
            out.append((key, seq, 5000 + seq * 100, event, None if event in ("graph", "odd") else f"{key}-{max(1, op - rng.randrange(2))}", f"g{rng.randrange(3)}" if event in ("graph", "done") else None))
    return out


def test_lifecycle_stream_equals_its_replay(spark, tmp_path):
    events = some_events(random.Random(3))
    kind = "key string, seq long, ms long, event string, operation string, signature string"
    for i in range(3):
        rows = [e for e in events if e[1] // 20 == i]
        spark.createDataFrame(rows, kind).coalesce(1).withColumn("at", F.timestamp_millis("ms")).drop("ms").write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema("key string, seq long, event string, operation string, signature string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = lifecycle.lifecycles(source, limit=10_000_000).writeStream.format("memory").queryName("lives").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.table("lives").collect()), key=lambda r: (r[0], r[1]))
    want = lifecycle.replayed(events, 10_000_000)
    assert got == want
    assert {"committed", "rolled back", "stale", "started", "ignored"} <= {r[-1] for r in got}


def test_what_came_meanwhile_stays_dirty_and_operations_run_out():
    life, step = lifecycle.Life(), lambda x, *e: lifecycle.step(x, *e, 0, 1000)
    for event in (("graph", None, "g1"), ("start", "o1", None), ("graph", None, "g2"), ("done", "o1", "g1")):
        life, outcome = step(life, *event)
    assert (life.state, life.committed, life.current, outcome) == ("fixed-dirty", "g1", "g2", "committed")
    life, _ = step(life, "start", "o2", None)
    assert life.state == "refreshing" and life.until == 1000
    assert step(life, "done", "o1", "g2")[1] == "stale" and step(life, "done", "o2", "g1")[1] == "stale"
    back, outcome = step(life, "timeout", None, None)
    assert (back.state, back.committed, back.operation, outcome) == ("fixed-dirty", "g1", None, "rolled back")
    lost = step(step(step(lifecycle.Life(), "graph", None, "g")[0], "start", "o", None)[0], "fail", "o", None)[0]
    assert lost.state == "error" and step(lost, "start", "p", None)[0].state == "initializing"
