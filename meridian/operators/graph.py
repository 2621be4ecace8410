"""The canonical undirected graph of notes and links, its degrees, tags, auxiliary targets and groupings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import paths as P
from meridian.operators.indexing import dense_index


@dataclass(frozen=True)
class Graph:
    """nodes(id, basename, tags, degree, weighted_degree), edges(src_id, dst_id, weight, fwd, bwd), aux_nodes(id, kind, degree, weighted_degree), aux_edges(src_id, dst_id, weight)."""

    nodes: DataFrame
    edges: DataFrame
    aux_nodes: DataFrame
    aux_edges: DataFrame


def note_files(notes: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    """(id, basename, tags) with normalised paths outside the excluded folders; of equal paths the last by ordinal `ord`, if there is one."""
    n = notes.withColumn("id", P.normal_path(F.col("path"))).where((F.col("id") != "") & ~P.excluded(F.col("id"), prefixes))
    cols = [F.col("id"), P.basename(F.col("id"), F.col("basename")).alias("basename"), P.clean_tags(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags")]
    if "ord" in notes.columns:
        n = n.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ord")))).where("_n = 1")
        return n.select(*cols)
    return n.select(*cols).dropDuplicates(["id"])


def valid_links(links: DataFrame) -> DataFrame:
    """(src, dst, w) with normalised ends, without self-links and without weights that are not finite and positive.

    The ends come out of a generator, so that the planner does not copy their expressions into every later filter on them.
    """
    n = links.where(P.valid_weight(F.col("w"))).select(F.inline(F.array(F.struct(P.normal_path(F.col("src")).alias("src"), P.normal_path(F.col("dst")).alias("dst"), "w"))))
    return n.where("src != dst")


def linked_notes(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links both of whose ends are notes."""
    i = ids.select("id")
    return links.join(i, links["src"] == i["id"], "left_semi").join(i.withColumnRenamed("id", "id2"), F.col("dst") == F.col("id2"), "left_semi")


def canonical_edges(links: DataFrame) -> DataFrame:
    """(src_id, dst_id, weight, fwd, bwd): one undirected edge a pair, src_id the lesser; fwd goes from it, bwd to it."""
    out = links.groupBy(F.least("src", "dst").alias("src_id"), F.greatest("src", "dst").alias("dst_id")).agg(F.sum(F.when(F.col("src") < F.col("dst"), F.col("w")).otherwise(0.0)).alias("fwd"), F.sum(F.when(F.col("src") > F.col("dst"), F.col("w")).otherwise(0.0)).alias("bwd"))
    return out.select("src_id", "dst_id", (F.col("fwd") + F.col("bwd")).alias("weight"), "fwd", "bwd")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, weighted_degree) of the ends of edges."""
    ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id"), "weight")
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def without_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that some edge touches."""
    ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id"))
    return nodes.join(ends, "id", "left_semi")


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids."""
    i = ids.select("id")
    return edges.join(i, edges["src_id"] == i["id"], "left_semi").join(i.withColumnRenamed("id", "id2"), F.col("dst_id") == F.col("id2"), "left_semi")


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "id", "left").withColumns({"degree": F.coalesce("degree", F.lit(0)), "weighted_degree": F.coalesce("weighted_degree", F.lit(0.0))})


def attachment_edges(links: DataFrame, ids: DataFrame, attachments: DataFrame) -> DataFrame:
    """Links from a note to a target that is an attachment and no note: (src_id, dst_id, weight)."""
    i = ids.select(F.col("id"))
    files = attachments.select(P.normal_path(F.col("path")).alias("id2")).distinct()
    out = links.join(i, links["src"] == i["id"], "left_semi").join(i.withColumnRenamed("id", "id1"), F.col("dst") == F.col("id1"), "left_anti").join(files, F.col("dst") == F.col("id2"), "left_semi")
    return out.groupBy(F.col("src").alias("src_id"), F.col("dst").alias("dst_id")).agg(F.sum("w").alias("weight"))


def unresolved_edges(links: DataFrame, ids: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    """Links from a note to a target that does not exist, named unresolved:target."""
    i = ids.select("id")
    out = links.where((F.col("dst") != "") & ~P.excluded(F.col("dst"), prefixes)).join(i, links["src"] == i["id"], "left_semi")
    return out.groupBy(F.col("src").alias("src_id"), F.concat(F.lit("unresolved:"), "dst").alias("dst_id")).agg(F.sum("w").alias("weight"))


def aux_nodes(attachments: DataFrame, unresolved: DataFrame, aux_edges: DataFrame) -> DataFrame:
    """(id, kind, degree, weighted_degree): all attachments and all unresolved targets, unreferenced ones with degree 0."""
    ids = attachments.select(P.normal_path(F.col("path")).alias("id"), F.lit("attachment").alias("kind")).distinct().unionByName(unresolved.select(F.col("dst_id").alias("id"), F.lit("unresolved").alias("kind")).distinct())
    d = aux_edges.groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))
    return ids.join(d, "id", "left").withColumns({"degree": F.coalesce("degree", F.lit(0)), "weighted_degree": F.coalesce("weighted_degree", F.lit(0.0))})


def build_graph(notes: DataFrame, links: DataFrame, attachments: DataFrame, unresolved: DataFrame, excluded: Sequence[str] = (), include_orphans: bool = True) -> Graph:
    """The graph of the notes outside the excluded folders. Links are joined with notes first, then with attachments; other targets go."""
    prefixes = [p for p in excluded if p]
    nodes, ok = note_files(notes, prefixes), valid_links(links)
    edges = canonical_edges(linked_notes(ok, nodes))
    missing = unresolved_edges(valid_links(unresolved), nodes, prefixes)
    if not include_orphans:
        nodes = without_orphans(nodes, edges)
        edges = induced_edges(edges, nodes)
    files = attachments.where(~P.excluded(P.normal_path(F.col("path")), prefixes))
    to_files = attachment_edges(ok, nodes, files)
    kept = missing.join(nodes.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    aux = to_files.unionByName(kept)
    return Graph(with_degrees(nodes, edges), edges, aux_nodes(files, missing, aux), aux)


def indexed(nodes: DataFrame) -> DataFrame:
    """nodes with idx, the ordinal of the id in code-point order."""
    return dense_index(nodes, "id")


def edges_by_index(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, weight, fwd, bwd) with ids replaced by ordinals."""
    i = nodes.select("id", "idx")
    a, b = i.select(F.col("id").alias("src_id"), F.col("idx").alias("src")), i.select(F.col("id").alias("dst_id"), F.col("idx").alias("dst"))
    return edges.join(a, "src_id").join(b, "dst_id").select("src", "dst", "weight", "fwd", "bwd")


def tag_index(nodes: DataFrame) -> DataFrame:
    """(tag, label, n, ids): by lower-cased tag its first label (by node id) and its sorted nodes."""
    t = nodes.select("id", F.explode("tags").alias("label"))
    return t.groupBy(F.lower("label").alias("tag")).agg(F.min_by("label", "id").alias("label"), F.countDistinct("id").alias("n"), F.array_sort(F.collect_set("id")).alias("ids"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbours): sorted neighbour ids of each node."""
    both = edges.select(F.col("src_id").alias("id"), F.col("dst_id").alias("n")).union(edges.select("dst_id", "src_id"))
    return both.groupBy("id").agg(F.array_sort(F.collect_set("n")).alias("neighbours"))


def folder_groups(nodes: DataFrame) -> DataFrame:
    """(folder, n, folder_index): top-level folders of the notes that have links, in code-point order from 0."""
    g = nodes.where(P.continental(F.col("id"), F.col("degree"))).groupBy(P.top_folder(F.col("id")).alias("folder")).agg(F.count("*").alias("n"))
    return dense_index(g, "folder", name="folder_index", parts=1)


def region_groups(nodes: DataFrame) -> DataFrame:
    """(region, n): notes in each directory region."""
    return nodes.groupBy(P.region_key(F.col("id")).alias("region")).agg(F.count("*").alias("n")).where("region IS NOT NULL")


def folders(paths: DataFrame) -> DataFrame:
    """(folder, depth): every proper prefix of every path, once."""
    s = F.split("path", "/")
    e = paths.select(s.alias("s")).where("size(s) > 1").select("s", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("depth"))
    return e.select(F.array_join(F.slice("s", 1, F.col("depth")), "/").alias("folder"), "depth").distinct()


def cross_owner_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, other, weight, owner, other_owner) in both directions, for edges between different owners that are not negative."""
    a, b = owners.select(F.col("id").alias("src_id"), F.col("owner").alias("owner_s")), owners.select(F.col("id").alias("dst_id"), F.col("owner").alias("owner_d"))
    j = edges.join(a, "src_id").join(b, "dst_id").where("owner_s >= 0 AND owner_d >= 0 AND owner_s != owner_d")
    return j.select(F.col("src_id").alias("id"), F.col("dst_id").alias("other"), "weight", F.col("owner_s").alias("owner"), F.col("owner_d").alias("other_owner")).union(j.select("dst_id", "src_id", "weight", "owner_d", "owner_s"))


def conductance(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, internal, external, conductance) with conductance = external / max(1, 2 internal + external), over groups(id, group)."""
    a, b = groups.select(F.col("id").alias("src_id"), F.col("group").alias("ga")), groups.select(F.col("id").alias("dst_id"), F.col("group").alias("gb"))
    j = edges.join(a, "src_id", "left").join(b, "dst_id", "left")
    side = j.select(F.explode(F.array_distinct(F.array("ga", "gb"))).alias("group"), (F.col("ga").eqNullSafe(F.col("gb"))).alias("inside"), "weight").where("group IS NOT NULL")
    s = side.groupBy("group").agg(F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0.0)).alias("internal"), F.sum(F.when(~F.col("inside"), F.col("weight")).otherwise(0.0)).alias("external"))
    return s.withColumn("conductance", F.col("external") / F.greatest(F.lit(1.0), 2 * F.col("internal") + F.col("external")))


def edge_layout_weight(weight: Column, folder_a: Column, folder_b: Column) -> Column:
    """Weights within a folder stay; those that touch a note outside folders count .18, those between folders .035; at least .012."""
    f = F.when(folder_a.isNull() | folder_b.isNull(), 0.18).when(folder_a == folder_b, 1.0).otherwise(0.035)
    return F.greatest(F.lit(0.012), weight * f)
