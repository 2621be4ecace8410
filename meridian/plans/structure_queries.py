"""Queries of trees, communities, signatures and commits: what takes rounds over links or points."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions import hashing as H
from meridian.functions import paths as P
from meridian.operators import communities, indexing, signatures, spatial, trees, validation
from meridian.plans.analysis_queries import r6, raster, raster_links
from meridian.plans.base_sql import with_
from meridian.plans.function_queries import _fold
from meridian.plans.graph_queries import MOVED, full_edges, full_nodes, renames
from meridian.sources import tables as T
from meridian.sources.state import StateStore, shared_folder

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# trees
def link_costs(spark, d):
    """(src, dst, cost): links both ways; heavy links are cheap."""
    e = full_edges(spark, d).select("src_id", "dst_id", (60 / F.col("weight")).alias("cost"))
    return e.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "cost").union(e.select("dst_id", "src_id", "cost"))


def region_seeds(spark, d):
    """(id): the first linked note of each directory."""
    e = full_edges(spark, d).select(F.explode(F.array("src_id", "dst_id")).alias("id"))
    return e.groupBy(P.region_key(F.col("id")).alias("region")).agg(F.min("id").alias("id")).select("id")


@query("i19_spanning_forest")
def _(spark, d):
    e = full_edges(spark, d).select("src_id", "dst_id", (60 / F.col("weight")).alias("cost"))
    return trees.spanning_forest(e, "src_id", "dst_id", "cost").select("src_id", "dst_id", r6(F.col("cost"), "cost"))


@query("i19_region_scaffold")
def _(spark, d):
    return trees.region_scaffold(T.positions(spark, d), "owner").select("a", "b", r6(F.col("distance"), "distance"), "tree", "near")


RELAXED = ", ".join(f"l{k + 1} AS (SELECT id, distance, source, parent FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, source, parent NULLS FIRST) AS r FROM (SELECT * FROM l{k} UNION ALL SELECT dst, distance + cost, source, id FROM l{k} JOIN costs ON id = src)) WHERE r = 1)" for k in range(14))
COSTS = "costs AS (SELECT src_id AS src, dst_id AS dst, 60 / weight AS cost FROM edges UNION ALL SELECT dst_id, src_id, 60 / weight FROM edges), l0 AS (SELECT min(id) AS id, 0::DOUBLE AS distance, min(id) AS source, NULL::VARCHAR AS parent FROM (SELECT src AS id FROM costs) GROUP BY regexp_extract(id, '^[^/]*/[^/]*', 0))"


@query("i21_least_cost_tree", with_("edges") + f", {COSTS}, {RELAXED} SELECT id, round(distance, 6) + 0.0 AS distance, source, parent FROM l14")
def _(spark, d):
    return trees.least_cost_tree(link_costs(spark, d), region_seeds(spark, d)).select("id", r6(F.col("distance"), "distance"), "source", "parent")


@query("i21_joined_sources")
def _(spark, d):
    arcs = link_costs(spark, d)
    return trees.joined_sources(arcs, trees.least_cost_tree(arcs, region_seeds(spark, d)))[0].withColumn("cost", F.round("cost", 6))


@query("j6_watershed")
def _(spark, d):
    p = T.positions(spark, d)
    cells, links = raster(spark, d), raster_links(spark, d)
    value = spatial.density(cells, p, spatial.spacing(p)).select("cell", F.round("density", 9).alias("value"))
    value = cells.select(F.col("idx").alias("cell")).join(value, "cell", "left").fillna(0.0, ["value"])
    members = spatial.nearest(p, cells).groupBy("cell").agg(F.count("*").alias("n"))
    out = trees.watershed(value, spatial.ascent_roots(value, links), links, members, ratio=0.62, small=3, small_ratio=0.52)
    return out.select("id", *(r6(F.col(c), c) for c in ("peak", "saddle", "prominence")), "n", "basin")


# communities; partitions follow from the notes themselves: two by place, three by the digits of the name
def partitions(spark, d):
    n = T.notes(spark, d).select(F.col("path").alias("id"), F.regexp_extract("basename", "([0-9]+)$", 1).cast("long").alias("k"))
    runs = [("place", 1, P.top_folder(F.col("id"))), ("place", 2, P.region_key(F.col("id"))), *(("digits", r, F.concat(F.lit("d"), (F.col("k") % r).cast("string"))) for r in (2, 3, 5))]
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(r).alias("run"), label.alias("label")) for f, r, label in runs))).alias("x")
    return n.select("id", each).select("x.family", "x.run", "id", "x.label")


def places(spark, d):
    """(set, id): notes by top-level folder and by directory."""
    n = T.notes(spark, d).select(F.col("path").alias("id"))
    return n.select(P.top_folder(F.col("id")).alias("set"), "id").union(n.select(P.region_key(F.col("id")), "id"))


PARTS = "kn AS (SELECT id, regexp_extract(basename, '([0-9]+)$', 1)::BIGINT AS k FROM notes), parts AS (SELECT 'place' AS family, 1 AS run, id, regexp_extract(id, '^[^/]*', 0) AS label FROM kn UNION ALL SELECT 'place', 2, id, regexp_extract(id, '^[^/]*/[^/]*', 0) FROM kn UNION ALL SELECT 'digits', 2, id, 'd' || k % 2 FROM kn UNION ALL SELECT 'digits', 3, id, 'd' || k % 3 FROM kn UNION ALL SELECT 'digits', 5, id, 'd' || k % 5 FROM kn)"
SETS = "sets AS (SELECT regexp_extract(id, '^[^/]*', 0) AS s, id FROM notes UNION ALL SELECT regexp_extract(id, '^[^/]*/[^/]*', 0), id FROM notes)"


@query("i13_consensus_edges", with_("edges", "notes") + f", {PARTS}, sa AS (SELECT p.family, src_id, dst_id, count(*) AS n FROM edges JOIN parts p ON p.id = src_id JOIN parts q ON q.id = dst_id AND p.family = q.family AND p.run = q.run AND p.label = q.label GROUP BY 1, 2, 3), sh AS (SELECT family, src_id, dst_id, n / CASE family WHEN 'place' THEN 2 ELSE 3 END AS share FROM sa UNION ALL SELECT '*', src_id, dst_id, sum(n) / 5 FROM sa GROUP BY src_id, dst_id) SELECT family, src_id, dst_id, round(share, 6) + 0.0 AS share FROM sh WHERE share >= 0.56")
def _(spark, d):
    return communities.consensus_edges(full_edges(spark, d), partitions(spark, d)).select("family", "src_id", "dst_id", r6(F.col("share"), "share"))


@query("g16_consensus_sets")
def _(spark, d):
    return communities.consensus_sets(T.notes(spark, d).select(F.col("path").alias("id")), full_edges(spark, d), partitions(spark, d), least=2)


METRICS = """ea AS (SELECT src_id, dst_id, least(4.0, 0.75 + ln(1 + weight)) AS w FROM edges), tc AS (SELECT s, src_id, dst_id, min(w) AS w, count(*) AS k FROM ea JOIN sets ON id IN (src_id, dst_id) GROUP BY 1, 2, 3),
sm AS (SELECT s, sum(w) FILTER (k = 2) AS inn, sum(w) FILTER (k = 1) AS bou, count(*) FILTER (k = 2) AS links FROM tc GROUP BY s),
st AS (SELECT s, max(n / CASE family WHEN 'place' THEN 2 ELSE 3 END) AS same FROM (SELECT s, p.family, count(*) AS n FROM tc JOIN parts p ON p.id = src_id JOIN parts q ON q.id = dst_id AND p.family = q.family AND p.run = q.run AND p.label = q.label WHERE k = 2 GROUP BY 1, 2) GROUP BY s),
ar AS (SELECT s, src_id AS a, dst_id AS b FROM tc WHERE k = 2 UNION SELECT s, dst_id, src_id FROM tc WHERE k = 2), tw AS (SELECT s, count(*) AS r FROM (SELECT s, a, b FROM ar UNION SELECT x.s, x.a, y.b FROM ar x JOIN ar y ON x.s = y.s AND x.b = y.a WHERE x.a <> y.b) GROUP BY s),
me AS (SELECT n.s, n.n, CASE WHEN coalesce(inn, 0) + coalesce(bou, 0) <= 1e-12 THEN 1.0::DOUBLE ELSE coalesce(bou, 0) / (2 * coalesce(inn, 0) + coalesce(bou, 0)) END AS conductance, coalesce(same / links, 0) AS stability, greatest(CASE WHEN n.n > 1 THEN coalesce(r, 0) / (n.n - 1)::DOUBLE / n.n ELSE 0 END, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CASE WHEN n.n > 1 THEN coalesce(links, 0) / (n.n - 1)::DOUBLE ELSE 0 END - 1) / 0.7))) AS cohesion FROM (SELECT s, count(*) AS n FROM sets GROUP BY s) n LEFT JOIN sm USING (s) LEFT JOIN st USING (s) LEFT JOIN tw USING (s))"""


@query("d15_set_metrics", with_("edges", "notes") + f', {PARTS}, {SETS}, {METRICS} SELECT s AS "set", n, round(conductance, 6) + 0.0 AS conductance, round(stability, 6) + 0.0 AS stability, round(cohesion, 6) + 0.0 AS cohesion, round(0.4 * stability + 0.3 * (1 - conductance) + 0.15 * least(1.0::DOUBLE, n / greatest(8.0::DOUBLE, 0.18 * (SELECT count(*) FROM notes))) + 0.15 * cohesion, 6) + 0.0 AS score FROM me')
def _(spark, d):
    out = communities.set_metrics(full_edges(spark, d), places(spark, d), partitions(spark, d), T.notes(spark, d).count())
    return out.select("set", "n", *(r6(F.col(c), c) for c in ("conductance", "stability", "cohesion", "score")))


def order_sets(spark, d):
    """(set, id): the suppliers of each order."""
    return T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("set"), F.col("l_suppkey").alias("id")).where("set IS NOT NULL AND id IS NOT NULL").distinct()


ORDERS = "WITH m AS MATERIALIZED (SELECT DISTINCT l_orderkey AS s, l_suppkey AS id FROM lineitem), n AS MATERIALIZED (SELECT s, count(*) AS n FROM m GROUP BY s), co AS MATERIALIZED (SELECT a.s, b.s AS w FROM m a JOIN m b ON a.id = b.id AND a.s <> b.s JOIN n ON a.s = n.s JOIN n v ON b.s = v.s WHERE n.n < v.n GROUP BY a.s, b.s, n.n HAVING count(*) = n.n)"


@query("g11_contained", ORDERS + ' SELECT s AS "set", w AS "within" FROM co')
def _(spark, d):
    return communities.contained(order_sets(spark, d))


def order_scores(spark, d):
    """(set, score, n): each order with its value."""
    n = order_sets(spark, d).groupBy("set").agg(F.count("*").alias("n"))
    return T.table(spark, d, "orders").select(F.col("o_orderkey").alias("set"), (F.round("o_totalprice", 2) / 1_000_000).alias("score")).join(n, "set")


@query("g13_complete_variants", ORDERS + ', sc AS (SELECT o_orderkey AS s, round(o_totalprice, 2) / 1000000 AS score, n FROM orders JOIN n ON o_orderkey = n.s) SELECT s AS "set", n FROM sc WHERE s NOT IN (SELECT co.s FROM co JOIN sc x ON co.s = x.s JOIN sc y ON co.w = y.s WHERE y.score + 0.06 >= x.score)')
def _(spark, d):
    return communities.without_incomplete(order_scores(spark, d), order_sets(spark, d)).select("set", "n")


@query("g12_unsplittable")
def _(spark, d):
    return communities.without_splittable(order_scores(spark, d), order_sets(spark, d)).select("set", "n")


@query("g14_disjoint_orders")
def _(spark, d):
    return communities.disjoint(order_scores(spark, d), order_sets(spark, d), F.col("score") * -1)


@query("i12_moved_labels")
def _(spark, d):
    nodes = T.notes(spark, d).select(F.col("path").alias("id"))
    return communities.move_labels(nodes, communities.arcs_of(full_edges(spark, d)), 0.6, rounds=8)[0]


# signatures, seeded numbers, orders
@query("h3_graph_signature", with_("edges", "notes") + f""", rows_ AS (SELECT 0 AS kind, '' AS a, NULL AS b, 'filter:all' AS t UNION ALL SELECT 1, id, NULL, 'node:' || id FROM notes UNION ALL SELECT 2, src_id, dst_id, 'edge:' || to_json([src_id, dst_id, fwd::VARCHAR, bwd::VARCHAR]) FROM edges),
    b AS (SELECT i // {signatures.FAN} AS blk, sha256(string_agg(sha256('=' || t), '' ORDER BY i)) AS h FROM (SELECT t, row_number() OVER (ORDER BY kind, a, b) - 1 AS i FROM rows_) GROUP BY 1)
    SELECT CASE WHEN count(*) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY blk)) END AS digest FROM b""")
def _(spark, d):
    return signatures.graph_signature(T.notes(spark, d).select(F.col("path").alias("id")), full_edges(spark, d), F.lit("all"))


M32 = "4294967296::HUGEINT"
DRAWN = f"""WITH s0 AS (SELECT c_custkey, c_nationkey + 1 AS n, c_custkey::HUGEINT AS v FROM customer),
    s1 AS (SELECT *, (xor(v, v >> 16) * {H.MIX_A}) % {M32} AS a FROM s0), s2 AS (SELECT *, (xor(a, a >> 15) * {H.MIX_B}) % {M32} AS b FROM s1), s3 AS (SELECT c_custkey, n, (xor(b, b >> 15) + n::HUGEINT * {H.DRAW_STEP}) % {M32} AS x FROM s2),
    s4 AS (SELECT *, (xor(x, x >> 15) * (x | 1::HUGEINT)) % {M32} AS y FROM s3), s5 AS (SELECT *, xor(y, (y + (xor(y, y >> 7) * (y | 61::HUGEINT)) % {M32}) % {M32}) AS z FROM s4)"""


@query("h11_draws", f"{DRAWN} SELECT c_custkey, xor(z, z >> 14)::BIGINT AS draw, floor(xor(z, z >> 14)::DOUBLE / 4294967296 * 6)::BIGINT AS die FROM s5")
def _(spark, d):
    n = F.col("c_nationkey").cast("long") + 1
    return T.table(spark, d, "customer").select("c_custkey", H.draw(F.col("c_custkey").cast("long"), n).alias("draw"), H.draw_below(F.col("c_custkey").cast("long"), n, 6).alias("die"))


@query("h12_seeded_order", DRAWN.replace("SELECT c_custkey, c_nationkey + 1 AS n, c_custkey::HUGEINT AS v FROM customer", "SELECT id AS c_custkey, row_number() OVER (ORDER BY id) AS n, 42::HUGEINT AS v FROM notes").replace("WITH s0", with_("notes").rstrip() + ", s0") + " SELECT c_custkey AS id, row_number() OVER (ORDER BY xor(z, z >> 14), n) - 1 AS place FROM s5")
def _(spark, d):
    return signatures.seeded_order(T.notes(spark, d).select(F.col("path").alias("id")), 42, "id")


@query("f1_code_unit_order", with_("notes") + "SELECT id, (row_number() OVER (ORDER BY id) - 1)::INT AS place FROM notes")
def _(spark, d):
    n = T.notes(spark, d).select(F.col("path").alias("id"))
    return indexing.dense_index(n.withColumn("_u", signatures.code_units(F.col("id"))), "_u", name="place").drop("_u")


@query("f2_locale_labels")
def _(spark, d):
    n = full_nodes(spark, d).select("id", "basename", "degree")
    return n.orderBy(F.desc("degree"), signatures.locale_key(F.col("basename")), signatures.code_units(F.col("id"))).limit(50)


# commits
@query("l7_m19_committed_layout", with_("notes") + f", k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM notes) SELECT {MOVED.format('id')} AS id, idx::INT AS idx FROM k WHERE idx % 7 <> 0")
def _(spark, d):
    """A layout is committed; a writer that did not see it fails; then renames and a prune come in one commit."""
    store = StateStore(spark, shared_folder(spark))
    layout = indexing.dense_index(T.notes(spark, d).select(F.col("path").alias("id")), "id")
    store.commit({"layout": layout}, None)
    try:
        store.commit({"layout": layout.limit(0)}, None)
    except ValueError:
        pass
    r = renames(spark, d)

    def change(tables):
        old = tables["layout"].where("idx % 7 != 0")
        return {"layout": old.join(r, old["id"] == r["old_path"], "left").select(F.coalesce("new_path", "id").alias("id"), "idx")}

    store.amend(change)
    return store.load("layout")


# saved state
@query("l10_effective_seeds", f"WITH a AS (SELECT c_custkey, 'x' || c_mktsegment AS s FROM customer), t AS (SELECT c_custkey, length(c_custkey::VARCHAR) || ':' || c_custkey || ';1:3;' || length(s) || ':' || s || ';2:10;' AS p FROM a) SELECT c_custkey, {_fold('p', str(H.OFFSET))} AS seed FROM t")
def _(spark, d):
    return T.table(spark, d, "customer").select("c_custkey", H.effective_seed(F.col("c_custkey"), F.lit(3), F.concat(F.lit("x"), "c_mktsegment")).alias("seed"))


@query("m8_usable_snapshots", with_("notes", "cust") + ", s AS (SELECT n_nationkey AS snapshot_id, 7 + n_nationkey % 5 AS v FROM nation), p AS (SELECT c_nationkey AS snapshot_id, path FROM customer JOIN cust ON c_custkey = key WHERE c_custkey % 2 = 1) SELECT snapshot_id::INT AS snapshot_id, v BETWEEN 9 AND 10 AND EXISTS (SELECT 1 FROM p JOIN notes ON path = id WHERE p.snapshot_id = s.snapshot_id AND NOT starts_with(id, 'ASIA/')) AS usable FROM s")
def _(spark, d):
    snapshots = T.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("snapshot_id"), (7 + F.col("n_nationkey") % 5).alias("algorithm_version"))
    c = T.table(spark, d, "customer").where("c_custkey % 2 = 1").select("c_custkey", F.col("c_nationkey").cast("int").alias("snapshot_id"))
    positions = c.join(T.customers(spark, d).select(F.col("key").alias("c_custkey"), "path"), "c_custkey").select("snapshot_id", "path")
    nodes = T.notes(spark, d).select(F.col("path").alias("id")).where("NOT startswith(id, 'ASIA/')")
    return validation.usable(snapshots, nodes, positions).select("snapshot_id", "usable")


@query("m9_migrated_state", "SELECT c_custkey, 4 AS schema_version, CASE WHEN v <= 3 THEN CASE k WHEN 0 THEN 'globeSize' WHEN 1 THEN 'tagOrbitPercent' ELSE 'iterations' END ELSE CASE k WHEN 0 THEN 'nodeSize' WHEN 1 THEN 'tagOrbitHeight' ELSE 'iterations' END END || '=' || c_nationkey AS setting, CASE WHEN v <= 4 THEN c_name END AS layout FROM (SELECT *, c_custkey % 7 AS v, c_custkey % 3 AS k FROM customer)")
def _(spark, d):
    name = F.when(F.col("c_custkey") % 3 == 0, "nodeSize").when(F.col("c_custkey") % 3 == 1, "tagOrbitHeight").otherwise("iterations")
    # the layout carries the key through
    state = T.table(spark, d, "customer").select((F.col("c_custkey") % 7).alias("schema_version"), F.create_map(name, F.col("c_nationkey").cast("string"), F.lit("key"), F.col("c_custkey").cast("string")).alias("settings"), F.col("c_name").alias("layout"))
    out = validation.migrated(state)
    first = F.element_at(F.filter(F.map_entries("settings"), lambda e: e["key"] != "key"), 1)
    return out.select(F.try_element_at("settings", F.lit("key")).cast("long").alias("c_custkey"), "schema_version", F.concat(first["key"], F.lit("="), first["value"]).alias("setting"), "layout")


@query("g10_renamed_positions", with_("notes") + f" SELECT {MOVED.format('id')} AS path, length(id)::INT AS x FROM notes")
def _(spark, d):
    positions = T.notes(spark, d).select("path", F.length("path").alias("x"))
    return validation.renamed_positions(positions, renames(spark, d)).select("path", "x")
