"""Checks of saved rows: positions, edges, descriptors, snapshots. A check returns the faults it finds, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import sphere as S
from meridian.operators.diff import ends

TOLERANCE = 1e-4


def position_faults(positions: DataFrame, key: str = "path", tolerance: float = TOLERANCE) -> DataFrame:
    """(key, code): the first fault of each position: not finite, zero, not of unit length, or a repeated key."""
    n = S.length(S.vec())
    bad = F.lit(False)
    for c in "xyz":
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    code = F.when(bad, "not-finite").when(n <= S.EPS, "zero").when(F.abs(n - 1) > tolerance, "not-unit").when(F.count("*").over(Window.partitionBy(key)) > 1, "repeated")
    return positions.select(key, code.alias("code")).where("code IS NOT NULL")


def valid_positions(positions: DataFrame, key: str = "path", tolerance: float = TOLERANCE) -> DataFrame:
    """The positions if none has a fault, else none: all or nothing."""
    faults = position_faults(positions, key, tolerance).limit(1).agg(F.count("*").alias("_f"))
    return positions.crossJoin(F.broadcast(faults)).where("_f = 0").drop("_f")


def parsed_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with known, different ends, made canonical; weight is fwd + bwd within 1e-8."""
    turned = F.col("src_id") > F.col("dst_id")
    c = edges.where("src_id != dst_id AND fwd >= 0 AND bwd >= 0 AND abs(weight - fwd - bwd) <= 1e-8")
    c = c.select(F.least("src_id", "dst_id").alias("src_id"), F.greatest("src_id", "dst_id").alias("dst_id"), "weight", F.when(turned, F.col("bwd")).otherwise(F.col("fwd")).alias("fwd"), F.when(turned, F.col("fwd")).otherwise(F.col("bwd")).alias("bwd"))
    i = ids.select("id")
    return c.join(i.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(i.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")


def descriptor_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, n): repeated node ids, edges that cannot be parsed, repeated edges; only codes that occur."""
    ok = parsed_edges(edges, nodes)
    counts = nodes.groupBy("id").count().where("count > 1").agg(F.lit("repeated-node").alias("code"), F.count("*").alias("n"))
    counts = counts.union(edges.agg(F.count("*").alias("a")).join(ok.agg(F.count("*").alias("b"))).select(F.lit("unparsable-edge"), F.col("a") - F.col("b")))
    counts = counts.union(ok.groupBy("src_id", "dst_id").count().where("count > 1").agg(F.lit("repeated-edge"), F.count("*")))
    return counts.where("n > 0")


def snapshot_faults(nodes: DataFrame, edges: DataFrame, positions: DataFrame) -> DataFrame:
    """(code, n): descriptor faults, position faults, positions without a node, nodes without a position, ends that are not nodes."""
    p, i = positions.select(F.col("path").alias("id")), nodes.select("id")
    out = descriptor_faults(nodes, edges).union(position_faults(positions).groupBy("code").agg(F.count("*").alias("n")))
    out = out.union(p.join(i, "id", "left_anti").agg(F.lit("unknown-path"), F.count("*"))).union(i.join(p, "id", "left_anti").agg(F.lit("missing-position"), F.count("*")))
    return out.union(ends(edges).join(i, "id", "left_anti").agg(F.lit("unknown-end"), F.count("*"))).where("n > 0")


def usable(snapshots: DataFrame, nodes: DataFrame, positions: DataFrame, low: int = 9, high: int = 10) -> DataFrame:
    """snapshots with usable: its algorithm version is in the window, and a current node is positioned (or there is no node)."""
    hit = positions.join(nodes.select(F.col("id").alias("path")), "path", "left_semi").groupBy("snapshot_id").agg(F.lit(True).alias("_hit"))
    none = nodes.limit(1).agg((F.count("*") == 0).alias("_none"))
    j = snapshots.join(hit, "snapshot_id", "left").crossJoin(F.broadcast(none))
    return j.withColumn("usable", F.col("algorithm_version").between(low, high) & (F.coalesce("_hit", F.lit(False)) | F.col("_none"))).drop("_hit", "_none")


def migrated(state: DataFrame) -> DataFrame:
    """Rows (schema_version, settings map, layout) at version 4: old setting names replaced, layouts of newer versions dropped."""
    alias = F.create_map(F.lit("nodeSize"), F.lit("globeSize"), F.lit("tagOrbitHeight"), F.lit("tagOrbitPercent"))
    s = F.map_from_entries(F.transform(F.map_entries("settings"), lambda e: F.struct(F.coalesce(F.try_element_at(alias, e["key"]), e["key"]).alias("key"), e["value"].alias("value"))))
    return state.select(F.lit(4).alias("schema_version"), F.when(F.col("schema_version") <= 3, s).otherwise(F.col("settings")).alias("settings"), F.when(F.col("schema_version") <= 4, F.col("layout")).alias("layout"))


def parsed_settings(settings: DataFrame) -> DataFrame:
    """(key, value) of settings(key, value string): numbers clamped to their ranges, defaults for what is no number."""
    # Name, default, least, greatest.
    ranges = (("debounceMs", 750.0, 100.0, 10_000.0), ("iterations", 1500.0, 1.0, 10_000.0), ("globeSize", 100.0, 60.0, 400.0), ("refreshHops", 1.0, 0.0, 6.0))
    v = F.expr("try_cast(value AS double)")
    out = F.lit(None).cast("double")
    for name, default, low, high in ranges:
        out = F.when(F.col("key") == name, F.least(F.lit(high), F.greatest(F.lit(low), F.when(F.isnan(v), None).otherwise(v), F.when(v.isNull() | F.isnan(v), F.lit(default))))).otherwise(out)
    return settings.select("key", out.alias("value")).where("value IS NOT NULL")


def pruned(nodes: DataFrame, edges: DataFrame, positions: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three frames of a snapshot, restricted to ids that exist."""
    e = existing.select("id").distinct()
    kept = edges.join(e.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(e.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return nodes.join(e, "id", "left_semi"), kept, positions.join(e.withColumnRenamed("id", "path"), "path", "left_semi")


def renamed_positions(positions: DataFrame, renames: DataFrame) -> DataFrame:
    """positions under new paths, or none at all if a rename conflicts: an old path twice, or two rows for one path afterwards."""
    j = positions.join(renames, positions["path"] == renames["old_path"], "left").withColumn("path", F.coalesce("new_path", "path")).drop("old_path", "new_path")
    twice = j.groupBy("path").count().where("count > 1").limit(1).agg(F.count("*").alias("_n"))
    return j.crossJoin(F.broadcast(twice)).where("_n = 0").drop("_n")
