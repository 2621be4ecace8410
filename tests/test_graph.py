from pyspark.sql import functions as F

from meridian.functions import hashing as H
from meridian.functions import paths as P
from meridian.operators import diff as D
from meridian.operators import graph as G
from meridian.operators import ranking, traversal, validation


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def notes(spark, *ids):
    return spark.createDataFrame([(i, "", [], k) for k, i in enumerate(ids)], "path string, basename string, tags array<string>, ord int")


def links(spark, *rows_):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows_], "src string, dst string, w double")


def test_undirected_rollup_and_degrees(spark):
    n = notes(spark, "z.md", "folder/b.md", "a.md")
    g = G.build_graph(n, links(spark, ("z.md", "a.md", 2), ("z.md", "z.md", 20), ("a.md", "z.md", 3), ("a.md", "folder/b.md", 1), ("folder/b.md", "a.md", 4)), notes(spark).select("path", "basename"), links(spark))
    assert rows(g.edges, "src_id", "dst_id", "weight", "fwd", "bwd") == [("a.md", "folder/b.md", 5.0, 1.0, 4.0), ("a.md", "z.md", 5.0, 3.0, 2.0)]
    assert rows(g.nodes, "id", "basename", "degree", "weighted_degree") == [("a.md", "a", 2, 10.0), ("folder/b.md", "b", 1, 5.0), ("z.md", "z", 1, 5.0)]
    assert rows(G.indexed(g.nodes), "id", "idx") == [("a.md", 0), ("folder/b.md", 1), ("z.md", 2)]


def test_attachments_unresolved_and_orphans(spark):
    n = notes(spark, "a.md", "b.md", "lonely.md")
    files = spark.createDataFrame([("assets/map.png", "map"), ("assets/orphan.pdf", "o")], "path string, basename string")
    g = G.build_graph(n, links(spark, ("a.md", "b.md", 1), ("a.md", "assets/map.png", 2)), files, links(spark, ("b.md", "Missing note.md", 3)), include_orphans=False)
    assert rows(g.nodes, "id") == [("a.md",), ("b.md",)]
    assert rows(g.aux_nodes, "id", "degree", "weighted_degree") == [("assets/map.png", 1, 2.0), ("assets/orphan.pdf", 0, 0.0), ("unresolved:Missing note.md", 1, 3.0)]


def test_bad_weights_and_exclusion_by_segment(spark):
    n = notes(spark, "x/a.md", "xy/b.md", "c.md")
    g = G.build_graph(n, links(spark, ("xy/b.md", "c.md", float("nan")), ("c.md", "xy/b.md", -1), ("x/a.md", "c.md", 1)), notes(spark).select("path", "basename"), links(spark), excluded=["x"])
    assert rows(g.nodes, "id") == [("c.md",), ("xy/b.md",)] and g.edges.count() == 0


def test_tags_paths_and_pins(spark):
    one = spark.createDataFrame([(["project", "#Project", " #nested/design ", ""],)], "t array<string>")
    assert one.select(P.clean_tags(F.col("t")).alias("t")).first().t == ["#nested/design", "#project"]
    p = spark.createDataFrame([(" \\a//b\\c.md\t",), (".",), ("/x/../y",), ("Books/Fiction/Novel.md",), ("Index.md",)], "p string")
    got = [tuple(r) for r in p.select(P.normal_path(F.col("p")), P.top_folder(F.col("p")), P.region_key(F.col("p")), P.valid_pin(F.col("p"))).collect()]
    assert got[0][0] == "a/b/c.md" and got[1][0] == "" and got[2][3] is None and got[3][1:3] == ("Books", "Books/Fiction") and got[4][1:3] == (None, None)


def edges(spark, *rows_):
    return spark.createDataFrame([(a, b, float(w), float(w), 0.0) for a, b, w in rows_], "src_id string, dst_id string, weight double, fwd double, bwd double")


def test_diff(spark):
    prev, cur = edges(spark, ("a", "b", 1), ("a", "removed", 2)), edges(spark, ("a", "b", 3), ("b", "new", 1))
    assert rows(D.edge_diff(prev, cur), "kind", "src_id", "dst_id") == [("added", "b", "new"), ("changed", "a", "b"), ("removed", "a", "removed")]
    s = D.diff_summary(prev, cur).first()
    assert (s.added_nodes, s.removed_nodes, s.added_edges, s.removed_edges, s.changed_edges, s.is_empty) == (1, 1, 1, 1, 1, False)
    assert D.diff_summary(prev, prev).first().is_empty


def test_renames_merge_edges_and_contended_hints(spark):
    e = edges(spark, ("a", "b", 1), ("a", "c", 2), ("b", "c", 4))
    r = spark.createDataFrame([("c", "b")], "old_path string, new_path string")
    assert rows(D.rename_edges(e, r), "src_id", "dst_id", "weight") == [("a", "b", 3.0)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    hints = spark.createDataFrame([("a", "x", "reliable"), ("b", "x", "reliable"), ("b", "y", "reliable"), ("c", "z", "guess"), ("d", "d2", "reliable")], "old_path string, new_path string, reliability string")
    assert rows(D.accepted_renames(hints, ids("a", "b", "c", "d"), ids("x", "y", "z", "d2")), "old_path", "new_path") == [("a", "x"), ("b", "y"), ("d", "d2")]


def graph6(spark):
    return spark.createDataFrame([(0, 1), (1, 3), (0, 2), (2, 3), (0, 4), (4, 5), (5, 3)], "src_id int, dst_id int")


def test_shortest_path_union(spark):
    got = traversal.shortest_path_union(graph6(spark), 0, 3)
    assert rows(got.where("kind = 'node'"), "src", "distance") == [(0, 2), (1, 2), (2, 2), (3, 2)]
    assert rows(got.where("kind = 'edge'"), "src", "dst") == [(0, 1), (0, 2), (1, 3), (2, 3)]
    two = spark.createDataFrame([(0, 1), (2, 3)], "src_id int, dst_id int")
    assert traversal.shortest_path_union(two, 0, 3).count() == 0
    assert rows(traversal.shortest_path_union(two, 0, 0), "kind", "src", "distance") == [("node", 0, 0)]


def test_refresh_plan(spark):
    n = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", True), ("new", False)], "id string, existing boolean")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("new", "b")], "src_id string, dst_id string")
    got = {r.id: r for r in traversal.refresh_plan(n, e, n.where("id = 'a'").select("id"), 1).collect()}
    assert [got[i].warm_up for i in ("a", "b", "c", "d", "new")] == [False] * 4 + [True]
    assert [got[i].movable for i in ("a", "b", "c", "d", "new")] == [True, True, False, False, True]
    assert [got[i].hard_fixed for i in ("a", "b", "c", "d", "new")] == [False, False, True, True, False]


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "src long, dst long")
    assert {(r.component) for r in traversal.components(path).collect()} == {0, 100} and traversal.components(path).count() == 63
    assert traversal.components(path.limit(0)).count() == 0


def test_mid_rank_search_and_signature(spark):
    v = spark.createDataFrame([("a", 1.0), ("a", 10.0), ("a", 100.0), ("b", 5.0), ("c", 0.0), ("c", 0.0)], "g string, v double")
    assert rows(v.select("g", "v", ranking.mid_rank("v", "g", F.lit(True)).alias("p")), "g", "p") == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 1.0), ("c", 0.0), ("c", 0.0)]
    n = spark.createDataFrame([("daily", "Daily note", 2), ("design", "Spherical graph design", 7), ("sphere", "Sphere", 1)], "id string, basename string, degree int")
    found = [r.id for r in ranking.search(n, "sphere").collect()]
    assert found[0] == "sphere" and ranking.search(n, "  ").count() == 0 and ranking.search(n, "sgd").first().id == "design"
    assert spark.range(1).select(F.hex(H.text_hash(F.lit("abc"), H.OFFSET)).alias("h")).first().h == "1A47E90B"


def test_all_or_nothing_positions(spark):
    p = spark.createDataFrame([("a", 1.0, 0.0, 0.0), ("b", 0.0, 2.0, 0.0)], "path string, x double, y double, z double")
    assert rows(validation.position_faults(p), "path", "code") == [("b", "not-unit")]
    assert validation.valid_positions(p).count() == 0 and validation.valid_positions(p.limit(1)).count() == 1
