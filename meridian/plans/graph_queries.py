"""Queries of the graph operators: scans, filters, joins, groupings, diffs and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions import paths as P
from meridian.operators import diff as D
from meridian.operators import graph as G
from meridian.operators import indexing, ranking
from meridian.plans.base_sql import with_
from meridian.sources import tables as T

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def whole_graph(spark, d: str, **options) -> G.Graph:
    return G.build_graph(T.notes(spark, d), T.links(spark, d), T.attachments(spark, d), T.unresolved_links(spark, d), **options)


def full_edges(spark, d: str):
    return G.canonical_edges(G.valid_links(T.links(spark, d)))


def early_edges(spark, d: str):
    return G.canonical_edges(G.valid_links(T.links(spark, d, early=True)))


def full_nodes(spark, d: str):
    return G.with_degrees(G.note_files(T.notes(spark, d)), full_edges(spark, d))


# A: scans
@query("a1_note_scan", with_("notes") + "SELECT id AS path, basename, tag FROM notes")
def _(spark, d):
    return T.notes(spark, d).select("path", "basename", F.try_element_at("tags", F.lit(1)).alias("tag"))


@query("a2_attachment_scan", with_("files") + "SELECT id AS path, basename FROM files")
def _(spark, d):
    return T.attachments(spark, d).where(~F.lower("path").endswith(".md"))


@query("a3_link_scan", with_("links") + "SELECT src, dst, w FROM links")
def _(spark, d):
    return T.links(spark, d)


@query("a4_unresolved_scan", with_("hrefs") + "SELECT src, dst, w FROM hrefs")
def _(spark, d):
    return T.unresolved_links(spark, d)


@query("a16_folder_scan", with_("notes") + "SELECT DISTINCT array_to_string(s[1:k], '/') AS folder, k::INT AS depth FROM (SELECT s, unnest(range(1, len(s))) AS k FROM (SELECT string_split(id, '/') AS s FROM notes))")
def _(spark, d):
    return G.folders(T.notes(spark, d))


@query("m16_folder_filter", with_("notes") + "SELECT DISTINCT array_to_string(s[1:k], '/') AS folder FROM (SELECT s, unnest(range(1, len(s))) AS k FROM (SELECT string_split(id, '/') AS s FROM notes)) WHERE contains(lower(array_to_string(s[1:k], '/')), 'asia')")
def _(spark, d):
    return G.folders(T.notes(spark, d)).where(F.contains(F.lower("folder"), F.lit("asia"))).select("folder").orderBy("folder")


# B: paths and predicates, over the raw url paths
@query("b1_normal_path", r"SELECT page_id, CASE WHEN p = '.' THEN '' ELSE p END AS path FROM (SELECT page_id, regexp_replace(regexp_replace(replace(trim(' ' || replace(replace(url, '://', '\'), 'e', '//e'), E' \t\n'), '\', '/'), '^/+', ''), '/{2,}', '/', 'g') AS p FROM pages)")
def _(spark, d):
    raw = F.concat(F.lit(" "), F.replace(F.replace("url", F.lit("://"), F.lit("\\")), F.lit("e"), F.lit("//e")))
    return T.table(spark, d, "pages").select("page_id", P.normal_path(raw).alias("path"))


@query("b2_normal_prefix", "SELECT page_id, regexp_replace(regexp_replace(url || '//', '/{2,}', '/', 'g'), '/+$', '') AS prefix FROM pages")
def _(spark, d):
    return T.table(spark, d, "pages").select("page_id", P.normal_prefix(F.concat("url", F.lit("//"))).alias("prefix"))


@query("b3_filter_options", with_("notes") + "SELECT array_to_string(list_sort(list_distinct(list(regexp_extract(id, '^[^/]*', 0)))), '|') AS prefixes, len(list_distinct(list(regexp_extract(id, '^[^/]*', 0))))::INT AS n FROM notes")
def _(spark, d):
    tops = T.notes(spark, d).select(P.top_folder(F.col("path")).alias("f")).distinct().agg(F.collect_list(F.concat("f", F.lit("/"))).alias("p"))
    return tops.select(P.normal_prefixes(F.concat("p", "p", F.array(F.lit("")))).alias("p")).select(F.array_join("p", "|").alias("prefixes"), F.size("p").alias("n"))


@query("b4_excluded_folders", with_("notes") + "SELECT id AS path FROM notes WHERE NOT (id = 'ASIA' OR starts_with(id, 'ASIA/') OR id = 'EUROPE/NATION_1' OR starts_with(id, 'EUROPE/NATION_1/'))")
def _(spark, d):
    return T.notes(spark, d).where(~P.excluded(F.col("path"), ["ASIA", "EUROPE/NATION_1"])).select("path")


@query("b5_valid_weights", "SELECT event_id, value FROM events WHERE value > 0 AND NOT isnan(value) AND value < 'infinity'::DOUBLE")
def _(spark, d):
    return T.table(spark, d, "events").where(P.valid_weight(F.col("value"))).select("event_id", "value")


@query("b6_self_links", "SELECT conv_id, a, b FROM (SELECT conv_id, role AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE a <> b")
def _(spark, d):
    from pyspark.sql import Window

    turns = T.table(spark, d, "conversations").select("conv_id", F.col("role").alias("a"), F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b"))
    return turns.where("a != b")


@query("b7_no_orphans", with_("nodes") + "SELECT id FROM nodes WHERE degree > 0")
def _(spark, d):
    return G.without_orphans(G.note_files(T.notes(spark, d)), full_edges(spark, d)).select("id")


@query("b8_induced_edges", with_("edges") + "SELECT src_id, dst_id, weight FROM edges WHERE starts_with(src_id, 'ASIA/') AND starts_with(dst_id, 'ASIA/')")
def _(spark, d):
    ids = G.note_files(T.notes(spark, d)).where(F.col("id").startswith("ASIA/"))
    return G.induced_edges(full_edges(spark, d), ids).select("src_id", "dst_id", "weight")


@query("b9_basenames", with_("notes") + "SELECT id, regexp_replace(regexp_extract(id, '[^/]*$', 0), '(?i)\\.md$', '') AS name FROM notes")
def _(spark, d):
    return T.notes(spark, d).select(F.col("path").alias("id"), P.basename(F.col("path"), F.lit("  ")).alias("name"))


@query("b10_b11_folders", with_("notes") + "SELECT id, regexp_extract(id, '^[^/]*', 0) AS folder, regexp_extract(id, '^[^/]*/[^/]*', 0) AS region FROM notes")
def _(spark, d):
    return T.notes(spark, d).select(F.col("path").alias("id"), P.top_folder(F.col("path")).alias("folder"), P.region_key(F.col("path")).alias("region"))


@query("b12_b13_islands", with_("nodes") + "SELECT id, degree > 0 AS continental, false AS root_island, degree > 0 AND substr(id, 1, 1) = 'A' AS a_root FROM nodes")
def _(spark, d):
    n = full_nodes(spark, d)
    flat = F.when(F.col("id").startswith("A"), P.basename(F.col("id"))).otherwise(F.col("id"))
    return n.select("id", P.continental(F.col("id"), F.col("degree")).alias("continental"), P.root_island(F.col("id"), F.col("degree")).alias("root_island"), P.root_island(flat, F.col("degree")).alias("a_root"))


@query("b14_b15_visible", with_("nodes", "files", "file_edges", all_="SELECT id, 'note' AS kind, degree FROM nodes UNION ALL SELECT f.id, 'attachment', count(e.dst_id) FROM files f LEFT JOIN file_edges e ON f.id = e.dst_id GROUP BY f.id") + "SELECT id, kind, degree = 0 AS orphan FROM all_ WHERE degree > 0")
def _(spark, d):
    g = graph_with_files(spark, d)
    return ranking.visible(g, orphans=False).select("id", "kind", ranking.orphan().alias("orphan"))


def graph_with_files(spark, d):
    edges = G.attachment_edges(G.valid_links(T.attachment_links(spark, d)), G.note_files(T.notes(spark, d)), T.attachments(spark, d))
    files = G.aux_nodes(T.attachments(spark, d), edges.limit(0), edges)
    return full_nodes(spark, d).select("id", F.lit("note").alias("kind"), "degree", F.lit(None).cast("boolean").alias("is_orphan")).unionByName(files.select("id", "kind", "degree", F.lit(None).cast("boolean").alias("is_orphan")))


# C: joins
@query("c1_linked_notes", with_("links") + "SELECT src, dst, w FROM links")
def _(spark, d):
    return G.linked_notes(G.valid_links(T.links(spark, d)), G.note_files(T.notes(spark, d)))


@query("c2_d2_attachment_edges", with_("file_edges") + "SELECT src_id, dst_id, weight FROM file_edges")
def _(spark, d):
    mixed = T.attachment_links(spark, d).unionByName(T.links(spark, d))
    return G.attachment_edges(G.valid_links(mixed), G.note_files(T.notes(spark, d)), T.attachments(spark, d))


@query("c3_unresolved_edges", with_("hrefs") + "SELECT src AS src_id, 'unresolved:' || ltrim(dst, '/') AS dst_id, sum(w)::DOUBLE AS weight FROM hrefs WHERE dst <> '' AND src LIKE 'en/%' AND ltrim(dst, '/') <> src GROUP BY 1, 2")
def _(spark, d):
    pages = T.table(spark, d, "pages").select(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("id")).where("id LIKE 'en/%'").distinct()
    raw = T.unresolved_links(spark, d).where("src != dst").select("src", F.regexp_replace("dst", "^/+", "").alias("dst"), "w").where("src != dst")
    return G.unresolved_edges(raw, pages)


@query("c4_e4_dense_index", with_("edges", "notes", n="SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM notes") + "SELECT a.idx::INT AS src, b.idx::INT AS dst, weight, fwd, bwd FROM edges JOIN n a ON src_id = a.id JOIN n b ON dst_id = b.id")
def _(spark, d):
    return G.edges_by_index(full_edges(spark, d), G.indexed(G.note_files(T.notes(spark, d)).select("id")))


@query("c5_d4_aux_degrees", with_("files", "file_edges") + "SELECT f.id, count(e.dst_id) AS degree, coalesce(sum(e.weight), 0)::DOUBLE AS weighted_degree FROM files f LEFT JOIN file_edges e ON f.id = e.dst_id GROUP BY f.id")
def _(spark, d):
    edges = G.attachment_edges(G.valid_links(T.attachment_links(spark, d)), G.note_files(T.notes(spark, d)), T.attachments(spark, d))
    return G.aux_nodes(T.attachments(spark, d), edges.limit(0), edges).select("id", "degree", "weighted_degree")


LINKED = "linked AS (SELECT src_id AS id FROM edges UNION SELECT dst_id FROM edges), early_linked AS (SELECT src_id AS id FROM early UNION SELECT dst_id FROM early) "


@query("c6_node_diff", with_("edges", "early") + ", " + LINKED + "SELECT 'added' AS kind, id FROM linked WHERE id NOT IN (SELECT id FROM early_linked) UNION ALL SELECT 'removed', id FROM early_linked WHERE id NOT IN (SELECT id FROM linked)")
def _(spark, d):
    return D.node_diff(D.ends(early_edges(spark, d)), D.ends(full_edges(spark, d)))


DIFF = "f AS (SELECT coalesce(e.src_id, p.src_id) AS src_id, coalesce(e.dst_id, p.dst_id) AS dst_id, p.weight AS prev_weight, e.weight AS weight, CASE WHEN p.src_id IS NULL THEN 'added' WHEN e.src_id IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM edges e FULL JOIN early p ON e.src_id = p.src_id AND e.dst_id = p.dst_id WHERE p.src_id IS NULL OR e.src_id IS NULL OR e.fwd <> p.fwd OR e.bwd <> p.bwd)"


@query("c7_edge_diff", with_("edges", "early") + ", " + DIFF + " SELECT kind, src_id, dst_id, prev_weight, weight FROM f")
def _(spark, d):
    return D.edge_diff(early_edges(spark, d), full_edges(spark, d)).select("kind", "src_id", "dst_id", "prev_weight", "weight")


@query("d28_d29_diff_summary", with_("edges", "early") + ", " + LINKED.strip() + ", " + DIFF + """, n AS (SELECT 'added' AS kind, id FROM linked WHERE id NOT IN (SELECT id FROM early_linked) UNION ALL SELECT 'removed', id FROM early_linked WHERE id NOT IN (SELECT id FROM linked)),
    c AS (SELECT (SELECT count(*) FROM n WHERE kind = 'added') AS added_nodes, (SELECT count(*) FROM n WHERE kind = 'removed') AS removed_nodes, (SELECT count(*) FROM f WHERE kind = 'added') AS added_edges, (SELECT count(*) FROM f WHERE kind = 'removed') AS removed_edges, (SELECT count(*) FROM f WHERE kind = 'changed') AS changed_edges, (SELECT count(*) FROM early_linked) AS pn, (SELECT count(*) FROM linked) AS cn, (SELECT count(*) FROM early) AS pe, (SELECT count(*) FROM edges) AS ce)
    SELECT added_nodes, removed_nodes, added_edges, removed_edges, changed_edges, added_nodes + removed_nodes + added_edges + removed_edges + changed_edges = 0 AS is_empty, round(greatest((added_nodes + removed_nodes)::DOUBLE / greatest(1, pn, cn), (added_edges + removed_edges + changed_edges)::DOUBLE / greatest(1, pe, ce)), 9) AS change_ratio FROM c""")
def _(spark, d):
    return D.diff_summary(early_edges(spark, d), full_edges(spark, d))


@query("g2_affected_nodes", with_("edges", "early") + ", " + LINKED.strip() + ", " + DIFF + " SELECT src_id AS id FROM f UNION SELECT dst_id FROM f UNION SELECT id FROM linked WHERE id NOT IN (SELECT id FROM early_linked) UNION SELECT id FROM early_linked WHERE id NOT IN (SELECT id FROM linked)")
def _(spark, d):
    prev, cur = early_edges(spark, d), full_edges(spark, d)
    return D.affected(D.node_diff(D.ends(prev), D.ends(cur)), D.edge_diff(prev, cur))


MOVED = "replace(replace({0}, 'ASIA/NATION_1', 'ASIA/X'), 'AMERICA/', 'AMERICAS/')"


@query("c8_rename_edges", with_("edges") + f", r AS (SELECT {MOVED.format('src_id')} AS s, {MOVED.format('dst_id')} AS t, fwd, bwd FROM edges) SELECT least(s, t) AS src_id, greatest(s, t) AS dst_id, sum(fwd + bwd)::DOUBLE AS weight, sum(CASE WHEN s < t THEN fwd ELSE bwd END)::DOUBLE AS fwd, sum(CASE WHEN s < t THEN bwd ELSE fwd END)::DOUBLE AS bwd FROM r WHERE s <> t GROUP BY 1, 2")
def _(spark, d):
    return D.rename_edges(full_edges(spark, d), renames(spark, d))


def renames(spark, d):
    new = F.replace(F.replace("path", F.lit("ASIA/NATION_1"), F.lit("ASIA/X")), F.lit("AMERICA/"), F.lit("AMERICAS/"))
    return T.notes(spark, d).select(F.col("path").alias("old_path"), new.alias("new_path")).where("old_path != new_path")


@query("c9_rename_hints", with_("notes") + f", r AS (SELECT id AS old_path, {MOVED.format('id')} AS new_path FROM notes) SELECT old_path, new_path FROM r WHERE old_path <> new_path AND NOT starts_with(old_path, 'AMERICA/')")
def _(spark, d):
    n = T.notes(spark, d).select(F.col("path").alias("id"))
    r = renames(spark, d)
    moved = n.join(r, n["id"] == r["old_path"], "left").select(F.coalesce("new_path", "id").alias("id"))
    hints = r.withColumn("reliability", F.when(F.col("old_path").startswith("AMERICA/"), "guess").otherwise("reliable"))
    return D.accepted_renames(hints, n, moved)


@query("c10_reconcile", with_("notes") + f", p AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM notes), saved AS (SELECT id FROM p WHERE k % 3 <> 0), cur AS (SELECT {MOVED.format('id')} AS id, id AS was FROM p WHERE k % 5 <> 0) SELECT cur.id, CASE WHEN s.id IS NULL THEN 'pending' ELSE 'visible' END AS state FROM cur LEFT JOIN saved s ON cur.was = s.id UNION ALL SELECT id, 'removed' FROM saved WHERE id NOT IN (SELECT was FROM cur)")
def _(spark, d):
    p = indexing.dense_index(T.notes(spark, d).select(F.col("path").alias("id")), "id", name="k").withColumn("k", F.col("k") + 1)
    r = renames(spark, d)
    saved = p.where("k % 3 != 0").select("id")
    cur = p.where("k % 5 != 0").join(r, p["id"] == r["old_path"], "left").select(F.coalesce("new_path", "id").alias("id"))
    return D.reconcile(cur, saved, r)


@query("c12_cross_owner_edges", with_("edges", o="SELECT r_name, (row_number() OVER (ORDER BY r_name) - 1)::INT AS k FROM region", e="SELECT src_id, dst_id, weight, a.k AS oa, b.k AS ob FROM edges JOIN o a ON starts_with(src_id, a.r_name || '/') JOIN o b ON starts_with(dst_id, b.r_name || '/') WHERE a.k <> b.k") + "SELECT src_id AS id, dst_id AS other, weight, oa AS owner, ob AS other_owner FROM e UNION ALL SELECT dst_id, src_id, weight, ob, oa FROM e")
def _(spark, d):
    return G.cross_owner_edges(full_edges(spark, d), owners(spark, d))


def owners(spark, d):
    n = full_nodes(spark, d)
    f = G.folder_groups(n)
    return n.withColumn("folder", P.top_folder(F.col("id"))).join(F.broadcast(f), "folder", "left").select("id", F.when(F.col("degree") > 0, F.coalesce("folder_index", F.lit(-1))).otherwise(-1).alias("owner"))


# D: groupings
@query("d1_undirected_edges", with_("edges") + "SELECT src_id, dst_id, weight, fwd, bwd FROM edges")
def _(spark, d):
    return full_edges(spark, d)


@query("d3_degrees", with_("nodes") + "SELECT id, degree, weighted_degree FROM nodes")
def _(spark, d):
    return G.with_degrees(G.note_files(T.notes(spark, d)), full_edges(spark, d)).select("id", "degree", "weighted_degree")


@query("d5_tag_index", with_("notes") + "SELECT lower('#' || tag) AS tag, min('#' || tag) AS label, count(*) AS n, array_to_string(list(id ORDER BY id), '|') AS ids FROM notes WHERE tag IS NOT NULL GROUP BY lower('#' || tag)")
def _(spark, d):
    return G.tag_index(G.note_files(T.notes(spark, d))).withColumn("ids", F.array_join("ids", "|"))


@query("d6_neighbours", with_("edges") + "SELECT id, array_to_string(list(n ORDER BY n), '|') AS neighbours FROM (SELECT src_id AS id, dst_id AS n FROM edges UNION SELECT dst_id, src_id FROM edges) GROUP BY id")
def _(spark, d):
    return G.neighbours(full_edges(spark, d)).withColumn("neighbours", F.array_join("neighbours", "|"))


@query("d7_region_groups", with_("notes") + "SELECT regexp_extract(id, '^[^/]*/[^/]*', 0) AS region, count(*) AS n FROM notes GROUP BY 1")
def _(spark, d):
    return G.region_groups(G.note_files(T.notes(spark, d)))


@query("d8_e5_folder_groups", with_("nodes") + "SELECT folder, n, (row_number() OVER (ORDER BY folder) - 1)::INT AS folder_index FROM (SELECT regexp_extract(id, '^[^/]*', 0) AS folder, count(*) AS n FROM nodes WHERE degree > 0 GROUP BY 1)")
def _(spark, d):
    return G.folder_groups(full_nodes(spark, d))


@query("d14_conductance", with_("edges", e="SELECT regexp_extract(src_id, '^[^/]*', 0) AS a, regexp_extract(dst_id, '^[^/]*', 0) AS b, weight FROM edges", s="SELECT a AS g, a = b AS inside, weight FROM e UNION ALL SELECT b, false, weight FROM e WHERE a <> b") + 'SELECT g AS "group", sum(CASE WHEN inside THEN weight ELSE 0 END)::DOUBLE AS internal, sum(CASE WHEN inside THEN 0 ELSE weight END)::DOUBLE AS external, round(sum(CASE WHEN inside THEN 0 ELSE weight END)::DOUBLE / greatest(1.0, sum(CASE WHEN inside THEN 2 * weight ELSE weight END)::DOUBLE), 9) AS conductance FROM s GROUP BY g')
def _(spark, d):
    groups = T.notes(spark, d).select(F.col("path").alias("id"), P.top_folder(F.col("path")).alias("group"))
    return G.conductance(full_edges(spark, d), groups).withColumn("conductance", F.round("conductance", 9))


# the whole build
KEPT = "kept AS (SELECT * FROM edges WHERE NOT starts_with(src_id, 'ASIA/') AND NOT starts_with(dst_id, 'ASIA/')), kept_deg AS (SELECT id, count(*) AS degree, sum(weight) AS weighted_degree FROM (SELECT src_id AS id, weight FROM kept UNION ALL SELECT dst_id, weight FROM kept) GROUP BY id)"


@query("build_graph", with_("edges", "notes") + f", {KEPT} SELECT n.id, basename, degree, weighted_degree FROM notes n JOIN kept_deg d ON n.id = d.id")
def _(spark, d):
    return whole_graph(spark, d, excluded=["ASIA"], include_orphans=False).nodes.select("id", "basename", "degree", "weighted_degree")


# G: sets
@query("g1_aux_union", with_("files", "hrefs") + "SELECT id, 'attachment' AS kind FROM files UNION ALL SELECT DISTINCT 'unresolved:' || dst, 'unresolved' FROM hrefs")
def _(spark, d):
    missing = T.unresolved_links(spark, d).select(F.lit("x").alias("src_id"), F.concat(F.lit("unresolved:"), "dst").alias("dst_id"))
    return G.aux_nodes(T.attachments(spark, d), missing, missing.withColumn("weight", F.lit(1.0)).limit(0)).select("id", "kind")


@query("g4_clean_tags", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(lower(p_name), ' '), lambda x: '#' || x))), ',') AS tags FROM part")
def _(spark, d):
    words = F.split("p_name", " ")
    raw = F.concat(F.transform(words, lambda w: F.concat(F.lit(" ##"), F.lower(w))), F.transform(words, lambda w: F.concat(F.lit("#"), F.upper(w), F.lit("\t"))), F.array(F.lit("")))
    return T.table(spark, d, "part").select("p_partkey", F.array_join(P.clean_tags(raw), ",").alias("tags"))


@query("g5_g8_pins", with_("notes") + "SELECT id AS pin FROM notes WHERE id LIKE '%1.md'")
def _(spark, d):
    ids = T.notes(spark, d).select(F.col("path").alias("pin"))
    raw = ids.where("pin LIKE '%1.md'").select(F.explode(F.array(F.concat(F.lit("/"), "pin", F.lit("/")), F.col("pin"), F.concat(F.lit("../"), "pin"), F.concat("pin", F.lit("x")))).alias("p"))
    pins = raw.select(P.valid_pin(F.col("p")).alias("pin")).where("pin IS NOT NULL").distinct()
    return pins.join(ids, "pin", "left_semi")


@query("g6_g7_pin_renames", with_("notes") + "SELECT id, CASE WHEN starts_with(id, 'ASIA/') THEN 'East/' || id[6:] ELSE id END AS pin FROM notes")
def _(spark, d):
    return T.notes(spark, d).select(F.col("path").alias("id"), P.renamed_pin(F.col("path"), "ASIA", "East", True).alias("pin"))


@query("a10_pin_toggle", with_("notes") + "SELECT id AS pin FROM notes WHERE (id LIKE '%1.md') <> (id LIKE '%11.md')")
def _(spark, d):
    n = T.notes(spark, d).select(F.col("path").alias("pin"))
    return D.toggled(n.where("pin LIKE '%1.md'"), n.where("pin LIKE '%11.md'"))


@query("g15_redundant_descendants", with_("notes", p="SELECT DISTINCT regexp_extract(id, '^[^/]*/[^/]*', 0) AS prefix FROM notes UNION SELECT r_name FROM region WHERE r_name < 'B'") + "SELECT prefix FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE starts_with(p.prefix, q.prefix || '/'))")
def _(spark, d):
    p = T.notes(spark, d).select(P.region_key(F.col("path")).alias("prefix")).union(T.table(spark, d, "region").where("r_name < 'B'").select("r_name")).distinct()
    return D.topmost(p)


@query("h40_h41_names", with_("notes") + "SELECT id, regexp_replace(id, '^[^/]*/', '') AS relative, array_to_string(list_transform(string_split(regexp_replace(basename, '[-_#]+', ' ', 'g'), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS shown FROM notes")
def _(spark, d):
    return T.notes(spark, d).select(F.col("path").alias("id"), P.relative_id(F.col("path")).alias("relative"), P.display_name(F.replace("basename", F.lit("#"), F.lit("-"))).alias("shown"))


@query("h48_edge_layout_weight", with_("edges") + "SELECT src_id, dst_id, round(greatest(0.012, weight * CASE WHEN regexp_extract(src_id, '^[^/]*', 0) = regexp_extract(dst_id, '^[^/]*', 0) THEN 1.0 ELSE 0.035 END), 9)::DOUBLE AS w FROM edges")
def _(spark, d):
    return full_edges(spark, d).select("src_id", "dst_id", F.round(G.edge_layout_weight(F.col("weight"), P.top_folder(F.col("src_id")), P.top_folder(F.col("dst_id"))), 9).alias("w"))
