"""Differences between graph versions, renames, and reconciliation of saved rows with current ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import paths as P


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()


def node_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """(kind, id): added and removed ids."""
    added = cur.join(prev, "id", "left_anti").select(F.lit("added").alias("kind"), "id")
    return added.union(prev.join(cur, "id", "left_anti").select(F.lit("removed").alias("kind"), "id"))


def edge_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """(kind, src_id, dst_id, prev_weight, weight): edges that came, went, or changed in either direction's weight."""
    p, c = prev.alias("p"), cur.alias("c")
    j = p.join(c, (F.col("p.src_id") == F.col("c.src_id")) & (F.col("p.dst_id") == F.col("c.dst_id")), "full_outer")
    kind = F.when(F.col("p.src_id").isNull(), "added").when(F.col("c.src_id").isNull(), "removed").when((F.col("p.fwd") != F.col("c.fwd")) | (F.col("p.bwd") != F.col("c.bwd")), "changed")
    return j.select(kind.alias("kind"), F.coalesce("c.src_id", "p.src_id").alias("src_id"), F.coalesce("c.dst_id", "p.dst_id").alias("dst_id"), F.col("p.weight").alias("prev_weight"), F.col("c.weight").alias("weight")).where("kind IS NOT NULL")


def affected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that a diff touches: added and removed nodes, and the ends of all its edges."""
    return nodes.select("id").union(edges.select(F.explode(F.array("src_id", "dst_id")))).distinct()


def diff_summary(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """One row: changes by class, is_empty, and change_ratio, the greater of the shares of nodes and of edges that changed."""
    n, e = node_diff(ends(prev), ends(cur)), edge_diff(prev, cur)
    c = n.agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_nodes") for k in ("added", "removed"))).join(e.agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_edges") for k in ("added", "removed", "changed"))))
    sizes = ends(prev).agg(F.count("*").alias("pn")).join(ends(cur).agg(F.count("*").alias("cn"))).join(prev.agg(F.count("*").alias("pe"))).join(cur.agg(F.count("*").alias("ce")))
    nodes, edges = F.col("added_nodes") + F.col("removed_nodes"), F.col("added_edges") + F.col("removed_edges") + F.col("changed_edges")
    one = F.lit(1).cast("long")
    ratio = F.greatest(nodes / F.greatest(one, "pn", "cn"), edges / F.greatest(one, "pe", "ce"))
    return c.join(sizes).select("added_nodes", "removed_nodes", "added_edges", "removed_edges", "changed_edges", (nodes + edges == 0).alias("is_empty"), F.round(ratio, 9).alias("change_ratio"))


def rename_edges(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """Edges under new names: made canonical and summed again; those that became self-links go."""
    a, b = renames.select(F.col("old_path").alias("src_id"), F.col("new_path").alias("new_s")), renames.select(F.col("old_path").alias("dst_id"), F.col("new_path").alias("new_d"))
    j = edges.join(a, "src_id", "left").join(b, "dst_id", "left").select(F.coalesce("new_s", "src_id").alias("s"), F.coalesce("new_d", "dst_id").alias("t"), "fwd", "bwd").where("s != t")
    out = j.groupBy(F.least("s", "t").alias("src_id"), F.greatest("s", "t").alias("dst_id")).agg(F.sum(F.when(F.col("s") < F.col("t"), F.col("fwd")).otherwise(F.col("bwd"))).alias("fwd"), F.sum(F.when(F.col("s") < F.col("t"), F.col("bwd")).otherwise(F.col("fwd"))).alias("bwd"))
    return out.select("src_id", "dst_id", (F.col("fwd") + F.col("bwd")).alias("weight"), "fwd", "bwd")


def accepted_renames(hints: DataFrame, prev: DataFrame, cur: DataFrame) -> DataFrame:
    """(old_path, new_path): reliable hints whose old path went and whose new path came; each side is claimed once, first come in sorted order.

    Hints whose sides are both unique are settled by joins. Only hints that share a side go through the sorted pass, one
    connected bunch (by old path or new path) at a time.
    """
    h = hints.where("reliability = 'reliable' AND old_path != new_path").select("old_path", "new_path").distinct()
    p, c = prev.select("id"), cur.select("id")
    for col, frame, how in (("old_path", p, "left_semi"), ("old_path", c, "left_anti"), ("new_path", c, "left_semi"), ("new_path", p, "left_anti")):
        h = h.join(frame.withColumnRenamed("id", col), col, how)
    n = h.withColumns({"_o": F.count("*").over(Window.partitionBy("old_path")), "_n": F.count("*").over(Window.partitionBy("new_path"))})
    easy, hard = n.where("_o = 1 AND _n = 1").select("old_path", "new_path"), n.where("_o > 1 OR _n > 1").select("old_path", "new_path")

    def first_come(group: pd.DataFrame) -> pd.DataFrame:
        old, new, keep = set(), set(), []
        for r in group.sort_values(["old_path", "new_path"]).itertuples(index=False):
            if r.old_path not in old and r.new_path not in new:
                old.add(r.old_path)
                new.add(r.new_path)
                keep.append(r)
        return pd.DataFrame(keep, columns=["old_path", "new_path"])

    from meridian.operators.traversal import components

    links = hard.select(F.concat(F.lit("o:"), "old_path").alias("src"), F.concat(F.lit("n:"), "new_path").alias("dst"))
    if hard.isEmpty():
        return easy
    bunch = components(links).withColumnRenamed("id", "side")
    named = hard.join(bunch, F.concat(F.lit("o:"), "old_path") == F.col("side"))
    return easy.union(named.groupBy("component").applyInPandas(lambda g: first_come(g[["old_path", "new_path"]]), "old_path string, new_path string"))


def reconcile(cur: DataFrame, saved: DataFrame, renames: DataFrame) -> DataFrame:
    """(id, state): current ids are visible if saved under their path or the path they were renamed from, else pending; other saved ids are removed."""
    r = renames.select(F.col("new_path").alias("id"), F.col("old_path").alias("was"))
    known = cur.join(r, "id", "left")
    s = saved.select(F.col("id").alias("sid"))
    by_path = known.join(s, known["id"] == s["sid"], "left").select("id", "was", F.col("sid").alias("by_path"))
    both = by_path.join(s.withColumnRenamed("sid", "by_rename"), F.col("was") == F.col("by_rename"), "left")
    used = both.select(F.coalesce("by_path", "by_rename").alias("sid")).where("sid IS NOT NULL")
    state = F.when(F.coalesce("by_path", "by_rename").isNull(), "pending").otherwise("visible")
    return both.select("id", state.alias("state")).union(s.join(used, "sid", "left_anti").select("sid", F.lit("removed")))


def committed_positions(cur: DataFrame, saved: DataFrame, renames: DataFrame, least: int = 2) -> DataFrame:
    """(id, x, y, z) of current ids from the saved path or an accepted rename; renames across folders count only when `least` notes moved between the same folders."""
    old, new = P.top_folder(F.col("old_path")), P.top_folder(F.col("new_path"))
    r = renames.withColumns({"_a": F.coalesce(old, F.lit("")), "_b": F.coalesce(new, F.lit(""))})
    r = r.withColumn("_m", F.count("*").over(Window.partitionBy("_a", "_b"))).where((F.col("_a") == F.col("_b")) | (F.col("_m") >= least)).select(F.col("new_path").alias("id"), F.col("old_path").alias("was"))
    s = saved.select(F.col("id").alias("sid"), "x", "y", "z")
    k = cur.select("id").join(r, "id", "left").join(s, F.col("id") == F.col("sid"), "left")
    t = s.select(F.col("sid").alias("tid"), *(F.col(c).alias(f"r{c}") for c in "xyz"))
    return k.join(t, F.col("was") == F.col("tid"), "left").select("id", *(F.coalesce(c, f"r{c}").alias(c) for c in "xyz")).where("x IS NOT NULL")


def toggled(have: DataFrame, given: DataFrame) -> DataFrame:
    """Rows of either frame but not of both."""
    return have.exceptAll(given).union(given.exceptAll(have))


def topmost(prefixes: DataFrame) -> DataFrame:
    """Prefixes without one of their ancestors among them. Each prefix looks its ancestors up by equality."""
    s = F.split("prefix", "/")
    above = prefixes.select("prefix", F.explode_outer(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(s, F.lit(1), i), "/"))).alias("up"))
    hit = above.join(prefixes.select(F.col("prefix").alias("up")).distinct(), "up", "left_semi").select("prefix").distinct()
    return prefixes.join(hit, "prefix", "left_anti")
