"""Walks over link tables: distances, shortest-path unions, neighbourhoods, components, membership. Rounds are checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators.ranking import top_two
from meridian.sources.state import checkpointed


def both_ways(edges: DataFrame, a: str = "src_id", b: str = "dst_id") -> DataFrame:
    """(src, dst), each link in both directions, once, without self-links."""
    e = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src != dst")
    return e.union(e.select("dst", "src")).distinct()


def distances(arcs: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(id, distance) of what the seeds (id) reach over arcs (src, dst), up to `most` steps. Each round joins the frontier only."""
    return _walk(checkpointed(arcs), seeds, most)


def _walk(arcs: DataFrame, seeds: DataFrame, most: int | None = None, until=None) -> DataFrame:
    """distances() over arcs that are stored already; ends with the step that reaches the id `until`, if that is given."""
    seen = frontier = checkpointed(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    step = 0
    while most is None or step < most:
        step += 1
        new = frontier.join(arcs, frontier["id"] == arcs["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = checkpointed(new.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if until is not None and not frontier.where(F.col("id") == F.lit(until)).isEmpty():
            break
        if step % 8 == 0:
            seen = checkpointed(seen)
    return seen


def shortest_path_union(edges: DataFrame, s, t, a: str = "src_id", b: str = "dst_id") -> DataFrame:
    """(kind, src, dst, distance): the nodes (dst null) and the links (src < dst) on any shortest path from s to t.

    No rows if t is not reached. s = t gives that node at distance 0. Two distance fields decide, so paths are never listed.
    """
    arcs = checkpointed(both_ways(edges, a, b))
    spark = edges.sparkSession
    kind = arcs.schema["src"].dataType.simpleString()
    one = lambda v: spark.createDataFrame([(v,)], f"id {kind}")
    ds = _walk(arcs, one(s), until=t)
    hit = ds.where(F.col("id") == F.lit(t)).first()
    none = spark.createDataFrame([], f"kind string, src {kind}, dst {kind}, distance int")
    if hit is None:
        return none
    far = hit["distance"]
    dt = _walk(arcs, one(t), far)
    on = checkpointed(ds.join(dt.withColumnRenamed("distance", "back"), "id").where(F.col("distance") + F.col("back") == far).select("id", "distance"))
    nodes = on.select(F.lit("node").alias("kind"), F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(far).alias("distance"))
    x, y = on.select(F.col("id").alias("src"), F.col("distance").alias("dx")), on.select(F.col("id").alias("dst"), F.col("distance").alias("dy"))
    links = arcs.where("src < dst").join(x, "src").join(y, "dst").where("abs(dx - dy) = 1").select(F.lit("edge").alias("kind"), "src", "dst", F.lit(far).alias("distance"))
    return nodes.union(links)


def refresh_plan(nodes: DataFrame, edges: DataFrame, affected: DataFrame, hops: int, strength: float = 0.8, least: float = 0.45) -> DataFrame:
    """(id, hop, warm_up, movable, hard_fixed, anchor) of nodes(id, existing).

    Seeds are the affected and the new nodes; what they reach in `hops` steps may move, the rest stays. New nodes warm up. An
    existing movable node is anchored by strength * (least + (1 - least) * hop / hops).
    """
    new = nodes.where("NOT existing").select("id")
    e = checkpointed(edges.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).where("src != dst"))
    arcs = e.union(e.select("dst", "src"))  # a repeated link costs a row in a round, and to find those would cost a shuffle of all
    d = _walk(arcs, affected.select("id").union(new).join(nodes.select("id"), "id", "left_semi"), hops)
    j = nodes.join(d.withColumnRenamed("distance", "hop"), "id", "left")
    reached = F.col("hop").isNotNull()
    share = F.col("hop") / F.lit(float(hops)) if hops else F.lit(0.0)
    return j.select("id", "hop", (~F.col("existing")).alias("warm_up"), reached.alias("movable"), (F.col("existing") & ~reached).alias("hard_fixed"), F.when(F.col("existing") & reached, strength * (least + (1 - least) * share)).otherwise(0.0).alias("anchor"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the ends of links (src, dst): the least id that is reachable. Large-star and small-star rounds."""
    now, seen = checkpointed(links.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a != b").distinct()), None

    def tied(around: DataFrame, large: bool) -> DataFrame:
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        j = around.join(least, "a")
        out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        large = checkpointed(tied(now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), True))
        now = checkpointed(tied(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False))
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def component_sizes(links: DataFrame) -> DataFrame:
    """(component, n), largest first, then by least id."""
    return components(links).groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component")


def bounded_weight(w):
    """min(4, .75 + ln(1 + w))."""
    return F.least(F.lit(4.0), 0.75 + F.log1p(w))


def complete_membership(edges: DataFrame, members: DataFrame, passes: int = 4) -> DataFrame:
    """(id, owner): members, and nodes that join the owner they are tied to most, in up to `passes` synchronous rounds.

    It takes two or more neighbours of that owner, a bounded weight of 2.4 or more, at least .56 of the weight to any owner, and
    1.35 times the runner-up's. Ties go to the lesser owner.
    """
    e = edges.select("src_id", "dst_id", bounded_weight(F.col("weight")).alias("bw"))
    arcs = checkpointed(e.select(F.col("src_id").alias("id"), F.col("dst_id").alias("other"), "bw").union(e.select("dst_id", "src_id", "bw")))
    now = checkpointed(members.select("id", "owner"))
    for _ in range(passes):
        owned = now.select(F.col("id").alias("other"), "owner")
        tie = arcs.join(owned, "other").join(now.select("id"), "id", "left_anti").groupBy("id", "owner").agg(F.round(F.sum("bw"), 9).alias("weight"), F.count("*").alias("n"))
        best = top_two(tie, "id", "weight", "owner")
        whole = tie.groupBy("id").agg(F.sum("weight").alias("whole"))
        counted = best.join(whole, "id").join(tie.select("id", F.col("owner").alias("best"), "n"), ["id", "best"])
        new = checkpointed(counted.where("n >= 2 AND best_value >= 2.4 AND best_value >= 0.56 * whole AND best_value >= 1.35 * second_value").select("id", F.col("best").alias("owner")))
        if new.isEmpty():
            break
        now = checkpointed(now.union(new))
    return now


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n): neighbours that the ends of each pair share. Hubs meet pair by pair, not all with all."""
    arcs = both_ways(edges)
    x = pairs.select("a", "b").join(arcs.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a")
    y = arcs.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return pairs.join(x.join(y, ["b", "c"]).groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
