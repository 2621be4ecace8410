"""Flushes of changes against the last committed graph: only touched notes are read again, and what changed is published and committed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.operators import diff as D
from meridian.operators import graph as G
from meridian.sources.state import StateStore, checkpointed


class GraphTracker:
    """Keeps nodes (id) and directed links (src, dst, w) in a StateStore, with the number of the last flush.

    notes_of and links_of get touched ids (id) and give what the sources hold of them now: (id), and (src, dst, w) of links that
    start there. on_diff gets the node and the edge differences; a flush that changes neither goes to on_metadata, with the
    touched ids and their reasons. Both are called before the commit, so a flush that fails is seen again: they must bear that.
    """

    def __init__(self, store: StateStore, notes_of: Callable[[DataFrame], DataFrame], links_of: Callable[[DataFrame], DataFrame], on_diff: Callable[[DataFrame, DataFrame], None], on_metadata: Callable[[DataFrame], None]) -> None:
        self.store, self.notes_of, self.links_of, self.on_diff, self.on_metadata = store, notes_of, links_of, on_diff, on_metadata

    def _now(self, touched: DataFrame) -> dict[str, DataFrame]:
        spark = touched.sparkSession
        none = {"nodes": spark.createDataFrame([], "id string"), "links": spark.createDataFrame([], "src string, dst string, w double"), "progress": spark.createDataFrame([], "flush long")}
        return none | self.store.tables()

    def flush(self, events: DataFrame, number: int) -> None:
        """Take the changes (key, reasons) of one flush, for foreachBatch. One that is committed already is left out."""
        touched = checkpointed(events.select(F.col("key").alias("id"), "reasons").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons")))
        at, now = self.store.current(), self._now(touched)
        if touched.isEmpty() or (now["progress"].agg(F.max("flush")).first()[0] or -1) >= number:
            return
        ids = touched.select("id")
        notes = self.notes_of(ids).join(ids, "id", "left_semi").distinct()
        nodes = checkpointed(now["nodes"].join(ids, "id", "left_anti").union(notes))
        links = checkpointed(now["links"].join(ids, F.col("src") == ids["id"], "left_anti").unionByName(G.valid_links(self.links_of(ids)).join(ids, F.col("src") == ids["id"], "left_semi")))
        node_diff = checkpointed(D.node_diff(now["nodes"], nodes))
        # an edge can only differ where an end was touched
        starts, comes = ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d"))
        near = lambda links: links.join(starts, "src", "left").join(comes, "dst", "left").where("_s OR _d").select("src", "dst", "w")
        both = lambda links, nodes: G.canonical_edges(G.linked_notes(near(links), nodes))
        edge_diff = checkpointed(D.edge_diff(both(now["links"], now["nodes"]), both(links, nodes)))
        if node_diff.isEmpty() and edge_diff.isEmpty():
            self.on_metadata(touched)
        else:
            self.on_diff(node_diff, edge_diff)
        self.store.commit({"nodes": nodes, "links": links, "progress": touched.sparkSession.createDataFrame([(number,)], "flush long")}, at)

    def edges(self) -> DataFrame:
        """The committed edges: links between notes that exist."""
        t = self.store.tables()
        return G.canonical_edges(G.linked_notes(t["links"], t["nodes"]))
