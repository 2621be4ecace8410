"""Queries of traversal, ranking, spatial, layout, validation and change operators."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridian.functions import paths as P
from meridian.functions import sphere as S
from meridian.operators import aggregates as A
from meridian.operators import diff as D
from meridian.operators import graph as G
from meridian.operators import indexing, layout, ranking, spatial, traversal, validation
from meridian.plans.base_sql import with_
from meridian.plans.graph_queries import full_edges, full_nodes, owners
from meridian.sources import tables as T
from meridian.sources.state import checkpointed
from meridian.streaming import changes

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c, name):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def rs(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


ANG = "atan2(sqrt(({a}y*{b}z-{a}z*{b}y)^2 + ({a}z*{b}x-{a}x*{b}z)^2 + ({a}x*{b}y-{a}y*{b}x)^2), least(1.0, greatest(-1.0, {a}x*{b}x+{a}y*{b}y+{a}z*{b}z)))"


def ang(a: str, b: str) -> str:
    return ANG.format(a=a, b=b)


# I: traversal
ARCS = "arcs AS (SELECT src_id AS src, dst_id AS dst FROM edges UNION SELECT dst_id, src_id FROM edges)"
ENDS = "st AS (SELECT min(src_id) AS s, max(dst_id) AS t FROM edges)"


def bfs_sql(name: str, seed: str, depth: int) -> str:
    """Distances from the seed in rounds: r0, r1, ... each the new ids, then all."""
    out = [f"{name}0 AS (SELECT id, 0 AS distance FROM ({seed}))"]
    for i in range(1, depth + 1):
        out.append(f"{name}{i} AS (SELECT * FROM {name}{i - 1} UNION ALL SELECT DISTINCT dst, {i} FROM {name}{i - 1} JOIN arcs ON id = src WHERE distance = {i - 1} AND dst NOT IN (SELECT id FROM {name}{i - 1}))")
    return ", ".join(out)


def ends_of(edges):
    return edges.agg(F.min("src_id").alias("s"), F.max("dst_id").alias("t")).first()


@query("i2_bfs_distances", with_("edges") + f", {ARCS}, {ENDS}, {bfs_sql('r', 'SELECT s AS id FROM st', 10)} SELECT id, distance FROM r10")
def _(spark, d):
    edges = checkpointed(full_edges(spark, d).select("src_id", "dst_id"))
    return traversal.distances(traversal.both_ways(edges), spark.createDataFrame([(ends_of(edges)["s"],)], "id string"))


@query("i1_m15_shortest_path_union", with_("edges") + f""", {ARCS}, {ENDS}, {bfs_sql('p', 'SELECT s AS id FROM st', 10)}, {bfs_sql('q', 'SELECT t AS id FROM st', 10)},
    far AS (SELECT distance AS n FROM p10, st WHERE id = t), onp AS (SELECT a.id, a.distance AS da FROM p10 a JOIN q10 b ON a.id = b.id, far WHERE a.distance + b.distance = far.n)
    SELECT 'node' AS kind, id AS src, NULL::VARCHAR AS dst, n AS distance FROM onp, far UNION ALL SELECT 'edge', e.src_id, e.dst_id, n FROM edges e JOIN onp a ON e.src_id = a.id JOIN onp b ON e.dst_id = b.id, far WHERE abs(a.da - b.da) = 1""")
def _(spark, d):
    edges = checkpointed(full_edges(spark, d).select("src_id", "dst_id"))
    e = ends_of(edges)
    return traversal.shortest_path_union(edges, e["s"], e["t"])


@query("i3_refresh_plan", with_("edges", "notes") + f""", {ARCS}, n AS (SELECT id, NOT id LIKE '%7.md' AS existing FROM notes), {bfs_sql('r', "SELECT id FROM n WHERE NOT existing OR id LIKE '%11.md'", 2)}
    SELECT n.id, coalesce(distance, -1) AS hop, NOT existing AS warm_up, distance IS NOT NULL AS movable, existing AND distance IS NULL AS hard_fixed, round(CASE WHEN existing AND distance IS NOT NULL THEN 0.8 * (0.45 + 0.55 * distance / 2.0) ELSE 0 END, 9)::DOUBLE AS anchor FROM n LEFT JOIN r2 ON n.id = r2.id""")
def _(spark, d):
    n = T.notes(spark, d).select(F.col("path").alias("id"), (~F.col("path").endswith("7.md")).alias("existing"))
    return traversal.refresh_plan(n, full_edges(spark, d), n.where(F.col("id").endswith("11.md")).select("id"), 2).withColumns({"anchor": F.round("anchor", 9), "hop": F.coalesce("hop", F.lit(-1))})


def linked(spark, d):
    return full_edges(spark, d).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


@query("i4_i7_components", with_("edges", recursive=True) + ", w AS (SELECT src_id AS x, dst_id AS y FROM edges UNION SELECT dst_id, src_id FROM edges), reach AS (SELECT x AS id, x AS m FROM w UNION SELECT w.y, r.m FROM reach r JOIN w ON r.id = w.x WHERE r.m < w.y) SELECT id, min(m) AS component FROM reach GROUP BY id")
def _(spark, d):
    return traversal.components(linked(spark, d))


@query("i5_component_sizes", with_("edges", recursive=True) + ", k AS (SELECT src_id AS a, dst_id AS b FROM edges WHERE regexp_extract(src_id, '^[^/]*', 0) = regexp_extract(dst_id, '^[^/]*', 0)), w AS (SELECT a AS x, b AS y FROM k UNION SELECT b, a FROM k), reach AS (SELECT x AS id, x AS m FROM w UNION SELECT w.y, r.m FROM reach r JOIN w ON r.id = w.x WHERE r.m < w.y) SELECT component, count(*) AS n FROM (SELECT id, min(m) AS component FROM reach GROUP BY id) GROUP BY component")
def _(spark, d):
    return traversal.component_sizes(linked(spark, d).where(P.top_folder(F.col("src")) == P.top_folder(F.col("dst"))))


@query("i8_bounded_weights", with_("edges") + f"SELECT src_id AS a, dst_id AS b, {rs('least(4.0, 0.75 + ln(1 + weight))', 'w')} FROM edges UNION ALL SELECT dst_id, src_id, {rs('least(4.0, 0.75 + ln(1 + weight))', 'w')} FROM edges")
def _(spark, d):
    e = full_edges(spark, d).select("src_id", "dst_id", r6(traversal.bounded_weight(F.col("weight")), "w"))
    return e.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "w").union(e.select("dst_id", "src_id", "w"))


def membership_sql(passes: int) -> str:
    out = ["arcs AS (SELECT src_id AS id, dst_id AS other, least(4.0, 0.75 + ln(1 + weight)) AS bw FROM edges UNION ALL SELECT dst_id, src_id, least(4.0, 0.75 + ln(1 + weight)) FROM edges)", "m0 AS (SELECT id, regexp_extract(id, '^[^/]*', 0) AS owner FROM notes WHERE id LIKE '%Supplier%' OR id LIKE '%1.md')"]
    for i in range(passes):
        out += [f"t{i} AS (SELECT a.id, m.owner, round(sum(bw), 9) AS w, count(*) AS n FROM arcs a JOIN m{i} m ON a.other = m.id WHERE a.id NOT IN (SELECT id FROM m{i}) GROUP BY 1, 2)", f"k{i} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, owner) AS r, sum(w) OVER (PARTITION BY id) AS whole, lead(w) OVER (PARTITION BY id ORDER BY w DESC, owner) AS nxt FROM t{i})", f"m{i + 1} AS (SELECT * FROM m{i} UNION ALL SELECT id, owner FROM k{i} WHERE r = 1 AND n >= 2 AND w >= 2.4 AND w >= 0.56 * whole AND w >= 1.35 * coalesce(nxt, 0))"]
    return ", ".join(out)


@query("i15_membership", with_("edges", "notes") + f", {membership_sql(4)} SELECT id, owner FROM m4")
def _(spark, d):
    m = T.notes(spark, d).where("path LIKE '%Supplier%' OR path LIKE '%1.md'").select(F.col("path").alias("id"), P.top_folder(F.col("path")).alias("owner"))
    return traversal.complete_membership(full_edges(spark, d), m)


@query("i22_common_neighbours", "WITH b AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), pairs AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)) SELECT pairs.a, pairs.b, count(y.s) AS n FROM pairs LEFT JOIN b x ON pairs.a = x.p LEFT JOIN b y ON pairs.b = y.p AND x.s = y.s GROUP BY 1, 2")
def _(spark, d):
    e = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("src_id"), (-F.col("l_suppkey") - 1).alias("dst_id")).distinct()
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("a"))
    pairs = p.join(p.select((F.col("a") - 1).alias("a")), "a", "left_semi").select("a", (F.col("a") + 1).alias("b"))
    return traversal.common_neighbours(e, pairs)


# E, F: windows and ranking
@query("e1_mid_rank", "WITH c AS (SELECT c_custkey, c_mktsegment AS g, greatest(0, floor(c_acctbal / 500)) AS v FROM customer), e AS (SELECT *, v >= 1 AS ok FROM c), r AS (SELECT *, rank() OVER (PARTITION BY g, ok ORDER BY v) AS rk, count(*) OVER (PARTITION BY g, ok) AS n, count(*) OVER (PARTITION BY g, ok, v) AS same FROM e) SELECT c_custkey, round(CASE WHEN NOT ok THEN 0 WHEN n = 1 THEN (v > 0)::INT WHEN same = n THEN CASE WHEN v > 0 THEN 0.5 ELSE 0 END ELSE (2 * (rk - 1) + same - 1)::DOUBLE / (2 * (n - 1)) END, 9)::DOUBLE AS p FROM r")
def _(spark, d):
    c = T.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("g"), F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 500)).alias("v"))
    return c.select("c_custkey", F.round(ranking.mid_rank("v", "g", F.col("v") >= 1), 9).alias("p"))


@query("e3_gate", f"SELECT event_id, {rs('least(1.0, greatest(0.0, (value / 200 - 0.2) / 0.45)) ** 2 * (3 - 2 * least(1.0, greatest(0.0, (value / 200 - 0.2) / 0.45)))', 'g')} FROM events")
def _(spark, d):
    return T.table(spark, d, "events").select("event_id", r6(ranking.gate(F.col("value") / 200, 0.2, 0.65), "g"))


@query("e7_apportion", "WITH n AS (SELECT c_nationkey AS owner, count(*) AS n FROM customer GROUP BY 1), w AS (SELECT sum(greatest(1.0, n) ** 0.88) AS w, count(*) AS k FROM n), s AS (SELECT owner, n, (1000 - 5 * k) * greatest(1.0, n) ** 0.88 / w AS share, k FROM n, w), f AS (SELECT *, floor(share) AS low, round(share - floor(share), 9) AS frac FROM s), p AS (SELECT *, row_number() OVER (ORDER BY frac DESC, owner) AS place, 1000 - 5 * k - sum(low) OVER () AS rest FROM f) SELECT owner, n, (5 + low + (place <= rest)::INT)::BIGINT AS target FROM p")
def _(spark, d):
    return ranking.apportion(T.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("owner")).agg(F.count("*").alias("n")), 1000, 5)


@query("f3_top_labels", with_("nodes", offers="SELECT id, CASE WHEN id LIKE '%11.md' THEN 1 ELSE 3 END AS priority FROM nodes WHERE id LIKE '%1.md'") + "SELECT n.id, coalesce(priority, 7) AS priority, degree FROM nodes n LEFT JOIN offers o ON n.id = o.id ORDER BY 2, degree DESC, n.id LIMIT 40")
def _(spark, d):
    n = full_nodes(spark, d)
    two = n.where("id LIKE '%1.md'").select("id", F.lit(3).alias("priority")).union(n.where("id LIKE '%11.md'").select("id", F.lit(1)))
    return ranking.top_labels(n, two, 40)


@query("f4_top_tags", "WITH w AS (SELECT p_partkey AS id, unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM part), t AS (SELECT tag, count(*) AS n, bool_or(id % 97 = 0) AS linked FROM w GROUP BY tag) SELECT tag, n, linked FROM t ORDER BY linked DESC, n DESC, tag LIMIT 96")
def _(spark, d):
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("tags"))
    tags = G.tag_index(p).withColumn("tag", F.col("label"))
    return ranking.top_tags(tags, p.where("id % 97 = 0"))


@query("f5_search", with_("nodes", s="SELECT id, degree, lower(basename) AS n, lower(id) AS p FROM nodes", t="SELECT *, CASE WHEN starts_with(n, 'customer#000') THEN 800 - (length(n) - 12) WHEN contains(n, 'customer#000') THEN 0 END + 30 AS a, CASE WHEN contains(p, 'customer#000') THEN 600 - 2 * (strpos(p, 'customer#000') - 1) - 0.1 * (length(p) - 12) END AS b FROM s") + "SELECT id, round(greatest(coalesce(a, -1), coalesce(b, -1)), 6)::DOUBLE AS score FROM t WHERE coalesce(a, b) IS NOT NULL ORDER BY 2 DESC, degree DESC, id LIMIT 20")
def _(spark, d):
    return ranking.search(full_nodes(spark, d), " Customer#000 ").withColumn("score", F.round("score", 6))


@query("f8_nearest_insertion", with_("pos", j=f"SELECT p.idx, q.idx AS other, {ang('p.', 'q.')} AS d FROM pos p JOIN pos q ON p.idx <> q.idx AND p.idx % 20 = 0", r="SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d, other) AS rank FROM j") + f"SELECT idx, other, rank::INT AS rank, {rs('d', 'distance')} FROM r WHERE rank <= 5")
def _(spark, d):
    p = T.positions(spark, d)
    return spatial.k_nearest(p.where("idx % 20 = 0"), p, 5).select("idx", "other", "rank", r6(F.col("distance"), "distance"))


@query("f9_view_budget", "SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN greatest(8, floor(o_totalprice * 10 / 15000))::INT ELSE 0 END AS labels FROM orders")
def _(spark, d):
    return T.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 0, F.greatest(F.lit(8), F.floor(F.col("o_totalprice") * 10 / 15000).cast("int"))).otherwise(0).alias("labels"))


# D: aggregates on the sphere
@query("d9_weighted_mean", with_("pos", g="SELECT owner, sum(w*x) AS x, sum(w*y) AS y, sum(w*z) AS z FROM pos GROUP BY owner") + f"SELECT owner, {rs('x / sqrt(x*x+y*y+z*z)', 'x')}, {rs('y / sqrt(x*x+y*y+z*z)', 'y')}, {rs('z / sqrt(x*x+y*y+z*z)', 'z')} FROM g")
def _(spark, d):
    return A.weighted_mean(T.positions(spark, d), "owner").select("owner", *(r6(F.col(c), c) for c in "xyz"))


@query("d10_d11_medoid", with_("pos", j=f"SELECT p.owner, p.idx, round(sum({ang('p.', 'q.')}), 9) AS d FROM pos p JOIN pos q ON p.owner = q.owner GROUP BY 1, 2", r="SELECT *, row_number() OVER (PARTITION BY owner ORDER BY d, idx) AS k FROM j") + "SELECT owner, idx FROM r WHERE k = 1")
def _(spark, d):
    return A.medoid(T.positions(spark, d), "owner")


MOMENT = "m AS (SELECT owner, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(x*x) AS xx, avg(x*y) AS xy, avg(x*z) AS xz, avg(y*y) AS yy, avg(y*z) AS yz, avg(z*z) AS zz FROM pos GROUP BY owner)"


@query("d12_coverage", with_("pos") + f", {MOMENT} SELECT owner, {rs('sqrt(mx*mx+my*my+mz*mz)', 'norm')}, {rs('xx', 'xx')}, {rs('xy', 'xy')}, {rs('zz', 'zz')}, {rs('(xx-1/3.0::DOUBLE)^2 + (yy-1/3.0::DOUBLE)^2 + (zz-1/3.0::DOUBLE)^2 + 2*(xy*xy+xz*xz+yz*yz)', 'isotropy')} FROM m")
def _(spark, d):
    return A.coverage(T.positions(spark, d), "owner").select("owner", *(r6(F.col(c), c) for c in ("norm", "xx", "xy", "zz", "isotropy")))


@query("d13_moment_eigenvalues", with_("pos") + f", {MOMENT} SELECT owner, {rs('xx + yy + zz', 'trace')}, {rs('xx*yy*zz + 2*xy*xz*yz - xx*yz*yz - yy*xz*xz - zz*xy*xy', 'det')}, true AS sorted FROM m")
def _(spark, d):
    e = A.moment_eigenvalues(A.coverage(T.positions(spark, d), "owner"))
    return e.select("owner", r6(F.col("e1") + F.col("e2") + F.col("e3"), "trace"), r6(F.col("e1") * F.col("e2") * F.col("e3"), "det"), ((F.col("e1") >= F.col("e2")) & (F.col("e2") >= F.col("e3"))).alias("sorted"))


@query("d16_cap_radius", with_("pos", g="SELECT owner, sum(w*x) AS x, sum(w*y) AS y, sum(w*z) AS z FROM pos GROUP BY owner", c="SELECT owner, x / sqrt(x*x+y*y+z*z) AS x, y / sqrt(x*x+y*y+z*z) AS y, z / sqrt(x*x+y*y+z*z) AS z FROM g") + f"SELECT c.owner, {rs('least(1.55, greatest(0.12, max(' + ang('c.', 'p.') + ') + least(0.14, 0.6 * 0.1)))', 'radius')} FROM c JOIN pos p ON c.owner = p.owner GROUP BY c.owner")
def _(spark, d):
    p = T.positions(spark, d)
    return A.cap_radius(p, A.weighted_mean(p, "owner"), "owner", F.lit(0.1)).select("owner", r6(F.col("radius"), "radius"))


TARGETS = "nodes AS (SELECT idx AS node, owner AS g, x AS ox, y AS oy, z AS oz, 40.0::DOUBLE AS incident FROM pos), tg AS (SELECT a.idx AS node, b.owner AS dest, b.w, b.x, b.y, b.z FROM (SELECT *, count(*) OVER () AS n FROM pos) a JOIN pos b ON b.idx IN ((a.idx * 7 + 3) % a.n, (a.idx * 11 + 5) % a.n, (a.idx * 13 + 8) % a.n) AND a.owner <> b.owner), ds AS (SELECT node, dest, sum(w) AS w, sum(w*x) AS x, sum(w*y) AS y, sum(w*z) AS z FROM tg GROUP BY 1, 2), dn AS (SELECT node, dest, w, x / sqrt(x*x+y*y+z*z) AS x, y / sqrt(x*x+y*y+z*z) AS y, z / sqrt(x*x+y*y+z*z) AS z FROM ds)"
FACTS = TARGETS + ", dt AS (SELECT d.*, n.ox, n.oy, n.oz, d.x - (d.x*ox+d.y*oy+d.z*oz)*ox AS tx, d.y - (d.x*ox+d.y*oy+d.z*oz)*oy AS ty, d.z - (d.x*ox+d.y*oy+d.z*oz)*oz AS tz FROM dn d JOIN nodes n ON d.node = n.node), dl AS (SELECT *, sqrt(tx*tx+ty*ty+tz*tz) AS tl FROM dt), df AS (SELECT node, sum(w) AS mass, count(*) AS k, sum(w*w) AS w2, sqrt(sum(w*tx/tl)^2 + sum(w*ty/tl)^2 + sum(w*tz/tl)^2) AS s FROM dl GROUP BY node), facts AS (SELECT n.node, n.g, coalesce(mass, 0)::DOUBLE AS mass, round(least(1.0, coalesce(mass, 0) / incident), 9)::DOUBLE AS share, round(coalesce(CASE WHEN k <= 1 THEN 0 ELSE 1 - w2 / (mass*mass) END, 0), 9)::DOUBLE AS diversity, least(1.0, coalesce(s / mass, 0))::DOUBLE AS coherence FROM nodes n LEFT JOIN df ON n.node = df.node)"


def port_facts(spark, d):
    p = T.positions(spark, d)
    n = p.count()
    nodes = p.select(F.col("idx").alias("node"), F.col("owner").alias("group"), F.lit(40.0).alias("incident"), *(F.col(c).alias(f"o{c}") for c in "xyz"))
    at = p.select(F.col("idx").alias("node"), F.col("owner").alias("mine"), F.explode(F.array_distinct(F.array(*((F.col("idx").cast("long") * a + b) % n for a, b in ((7, 3), (11, 5), (13, 8)))))).alias("to"))
    targets = at.join(p.select(F.col("idx").alias("to"), F.col("owner").alias("dest"), "w", "x", "y", "z"), "to").where("mine != dest").select("node", "dest", "w", "x", "y", "z")
    return A.port_facts(nodes, A.destinations(targets))


@query("d17_d18_d19_port_facts", with_("pos") + f", {FACTS} SELECT node, g, mass, share, diversity, {rs('coherence', 'coherence')} FROM facts")
def _(spark, d):
    return port_facts(spark, d).select("node", F.col("group").alias("g"), "mass", "share", "diversity", r6(F.col("coherence"), "coherence"))


def _mid(v: str) -> str:
    w = "PARTITION BY g, mass > 0"
    return f"CASE WHEN NOT mass > 0 THEN 0 WHEN count(*) OVER ({w}) = 1 THEN ({v} > 0)::INT WHEN count(*) OVER ({w}, {v}) = count(*) OVER ({w}) THEN CASE WHEN {v} > 0 THEN 0.5 ELSE 0 END ELSE (2 * (rank() OVER ({w} ORDER BY {v}) - 1) + count(*) OVER ({w}, {v}) - 1)::DOUBLE / (2 * (count(*) OVER ({w}) - 1)) END"


@query("e2_port_scores", with_("pos") + f", {FACTS}, t AS (SELECT *, least(1.0, greatest(0.0, (coherence - 0.2) / 0.45)) AS t, {_mid('mass')} AS pm, {_mid('share')} AS ps, {_mid('diversity')} AS pd FROM facts) SELECT node, {rs('CASE WHEN mass > 0 THEN (0.55 * pm + 0.3 * ps + 0.15 * pd) * t * t * (3 - 2 * t) ELSE 0 END', 'score')} FROM t")
def _(spark, d):
    return A.port_scores(port_facts(spark, d)).select("node", r6(F.col("score"), "score"))


@query("f6_separated_ports")
def _(spark, d):
    s = A.port_scores(port_facts(spark, d)).where("score > 0").select("node", "group", "score", "coherence", "mass")
    at = T.positions(spark, d).select(F.col("idx").alias("node"), "x", "y", "z")
    return A.separated_top(s.join(at, "node"), "group", 0.42, 8).select("node", "group", r6(F.col("score"), "score"))


@query("d20_d21_quantiles", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.88), 6) + 0.0 AS q, round(median(c_acctbal), 6) + 0.0 AS m FROM customer GROUP BY 1")
def _(spark, d):
    return T.table(spark, d, "customer").groupBy("c_mktsegment").agg(r6(F.percentile("c_acctbal", 0.88), "q"), r6(F.median("c_acctbal"), "m"))


@query("d23_c13_group_matching", with_("notes", p="SELECT regexp_extract(id, '^[^/]*/[^/]*', 0) AS g, id FROM notes", c="SELECT CASE WHEN id LIKE '%3.md' THEN 'MOVED' ELSE regexp_extract(id, '^[^/]*/[^/]*', 0) || 'x' END AS g, id FROM notes", s="SELECT p.g AS prev, c.g AS cur, count(*)::DOUBLE AS n FROM p JOIN c ON p.id = c.id GROUP BY 1, 2", u="SELECT prev, cur, round(n / ((SELECT count(*) FROM p WHERE g = prev) + (SELECT count(*) FROM c WHERE g = cur) - n), 9)::DOUBLE AS similarity FROM s") + "SELECT prev, cur, similarity FROM u WHERE similarity >= 0.42")
def _(spark, d):
    n = T.notes(spark, d).select(F.col("path").alias("id"))
    region = P.region_key(F.col("id"))
    cur = n.select(F.when(F.col("id").endswith("3.md"), "MOVED").otherwise(F.concat(region, F.lit("x"))).alias("group"), "id")
    return A.match_groups(n.select(region.alias("group"), "id"), cur)


@query("h33_h34_rotation", with_("pos", q="SELECT idx, x, y, z, y AS tx, z AS ty, x AS tz FROM pos") + "SELECT idx, round(tx, 5) + 0.0 AS x, round(ty, 5) + 0.0 AS y, round(tz, 5) + 0.0 AS z FROM q")
def _(spark, d):
    p = T.positions(spark, d)
    pairs = p.select("idx", *(F.col(c).alias(f"a{c}") for c in "xyz"), F.col("y").alias("bx"), F.col("z").alias("by"), F.col("x").alias("bz"))
    out = A.rotated(p, A.best_rotation(pairs))
    return out.select("idx", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in "xyz"))


# C, J: spatial joins and rasters; the raster is a Fibonacci sphere of as many cells as there are parts
CELLS = "cells AS (SELECT i AS cell, cos(i * 2.399963229728653::DOUBLE) * sqrt(1 - y*y) AS x, y, sin(i * 2.399963229728653::DOUBLE) * sqrt(1 - y*y) AS z FROM (SELECT p_partkey::INT AS i, 1 - 2 * (p_partkey + 0.5::DOUBLE) / count(*) OVER () AS y FROM part))"


def raster(spark, d):
    p = T.table(spark, d, "part")
    n = p.agg(F.count("*").alias("n"))
    q = p.crossJoin(F.broadcast(n)).select(F.col("p_partkey").cast("int").alias("idx"), "n")
    return q.select("idx", *(c.alias(n) for n, c in zip("xyz", S.fibonacci(F.col("idx").cast("double"), F.col("n")))))


def raster_links(spark, d):
    """Links both ways between cells within an angle that shrinks as cells get more, so that each has about as many links at every size."""
    cells = raster(spark, d)
    p = spatial.near_pairs(cells, 0.09 * math.sqrt(2000 / max(1, cells.count())))
    return p.select("a", "b").union(p.select("b", "a"))


LINKS = CELLS + f", links AS (SELECT p.cell AS a, q.cell AS b FROM cells p JOIN cells q ON p.cell <> q.cell AND {ang('p.', 'q.')} <= (SELECT 0.09 * sqrt(2000 / greatest(1, count(*))) FROM part))"


@query("c14_near_pairs", with_("pos") + f"SELECT p.idx AS a, q.idx AS b, {rs(ang('p.', 'q.'), 'distance')} FROM pos p JOIN pos q ON p.idx < q.idx AND {ang('p.', 'q.')} <= 0.12 AND (p.idx % 3 = 0 OR q.idx % 3 = 0)")
def _(spark, d):
    p = T.positions(spark, d).withColumn("movable", F.col("idx") % 3 == 0)
    return spatial.near_pairs(p, 0.12).select("a", "b", r6(F.col("distance"), "distance"))


@query("c16_c17_nearest_cell", with_("pos") + f", {CELLS}, j AS (SELECT idx, cell, {ang('p.', 'q.')} AS d FROM pos p, cells q), r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d, cell) AS k FROM j) SELECT idx, cell, {rs('d', 'distance')} FROM r WHERE k = 1")
def _(spark, d):
    return spatial.nearest(T.positions(spark, d), raster(spark, d)).select("idx", "cell", r6(F.col("distance"), "distance"))


SPACED = f"kd AS (SELECT p.idx, {ang('p.', 'q.')} AS d, q.idx AS o FROM pos p JOIN pos q ON p.idx <> q.idx), kr AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d, o) AS r FROM kd), kt AS (SELECT idx, d AS kth FROM kr WHERE r = 4), kc AS (SELECT least(0.7, greatest(0.035, median(kth))) AS c FROM kt), sp AS (SELECT idx, kth, c, least(2.2 * c, greatest(0.5 * c, kth)) AS loc FROM kt, kc)"


@query("j3_spacing", with_("pos") + f", {SPACED} SELECT idx, {rs('kth', 'kth')}, {rs('c', 'characteristic')}, {rs('loc', 'local')} FROM sp")
def _(spark, d):
    return spatial.spacing(T.positions(spark, d)).select("idx", *(r6(F.col(c), c) for c in ("kth", "characteristic", "local")))


FIELD = SPACED + ", " + CELLS + f", bd AS (SELECT p.*, least(1.45 * c, greatest(0.55 * c, 0.82 * loc)) AS band FROM pos p JOIN sp ON p.idx = sp.idx), fj AS (SELECT cell, owner, w, band, {ang('b.', 'q.')} AS d FROM bd b, cells q), fk AS (SELECT cell, owner, w * (0.82 * CASE WHEN d < band THEN (1 - d*d/(band*band)) ** 3 ELSE 0 END + 0.18 * CASE WHEN d < 2 * band THEN (1 - d*d/(4*band*band)) ** 3 ELSE 0 END) AS v FROM fj), fo AS (SELECT cell, owner, sum(v) AS density FROM fk GROUP BY 1, 2 HAVING sum(v) > 0)"


@query("j4_density", with_("pos") + f", {FIELD} SELECT cell, {rs('sum(density)', 'density')} FROM fo GROUP BY cell")
def _(spark, d):
    p = T.positions(spark, d)
    return spatial.density(raster(spark, d), p, spatial.spacing(p)).select("cell", r6(F.col("density"), "density"))


@query("j21_e6_owner_fields", with_("pos") + f", {FIELD}, rr AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(density, 9) DESC, owner) AS r FROM fo) SELECT cell, max(CASE WHEN r = 1 THEN owner END) AS best, {rs('max(CASE WHEN r = 1 THEN round(density, 9) END)', 'best_value')}, {rs('coalesce(max(CASE WHEN r = 2 THEN round(density, 9) END), 0)', 'second_value')} FROM rr GROUP BY cell")
def _(spark, d):
    return owner_fields(spark, d).select("cell", "best", r6(F.col("best_value"), "best_value"), r6(F.col("second_value"), "second_value"))


def owner_fields(spark, d):
    p = T.positions(spark, d)
    f = spatial.density(raster(spark, d), p, spatial.spacing(p), "owner").withColumn("density", F.round("density", 9))
    return ranking.top_two(f, "cell", "density", "owner")


OWNED = "co AS (SELECT cell, CASE WHEN z > 0.3 AND x > 0.1 THEN 0 WHEN z > 0.3 AND x <= 0.1 THEN 1 WHEN z < -0.5 AND cell % 17 <> 0 THEN 2 ELSE -1 END AS owner FROM cells)"


def owned(spark, d):
    c = F.when((F.col("z") > 0.3) & (F.col("x") > 0.1), 0).when((F.col("z") > 0.3) & (F.col("x") <= 0.1), 1).when((F.col("z") < -0.5) & (F.col("idx") % 17 != 0), 2).otherwise(-1)
    return raster(spark, d).select(F.col("idx").alias("cell"), c.alias("owner"))


@query("d24_d26_thin_cells", f"WITH {LINKS}, {OWNED}, s AS (SELECT a.cell, count(*) AS n FROM links l JOIN co a ON l.a = a.cell JOIN co b ON l.b = b.cell WHERE a.owner = b.owner AND a.owner >= 0 GROUP BY 1) SELECT owner, count(*) AS cells, count(*) FILTER (coalesce(n, 0) <= 2) AS thin FROM co LEFT JOIN s ON co.cell = s.cell WHERE owner >= 0 GROUP BY owner")
def _(spark, d):
    return spatial.thin_cells(owned(spark, d), raster_links(spark, d))


@query("j9_sea_between", f"WITH {LINKS}, {OWNED}, t AS (SELECT DISTINCT a.cell FROM links l JOIN co a ON l.a = a.cell JOIN co b ON l.b = b.cell WHERE a.owner >= 0 AND b.owner >= 0 AND a.owner <> b.owner) SELECT co.cell, CASE WHEN t.cell IS NOT NULL THEN -1 ELSE owner END AS owner FROM co LEFT JOIN t ON co.cell = t.cell")
def _(spark, d):
    return spatial.sea_between(owned(spark, d), raster_links(spark, d))


@query("j10_j25_ocean_repair", f"WITH RECURSIVE {LINKS}, {OWNED}, wl AS (SELECT l.a, l.b FROM links l JOIN co x ON l.a = x.cell JOIN co y ON l.b = y.cell WHERE x.owner < 0 AND y.owner < 0), rc AS (SELECT cell AS id, cell AS m FROM co WHERE owner < 0 UNION SELECT wl.b, rc.m FROM rc JOIN wl ON rc.id = wl.a WHERE rc.m < wl.b), pc AS (SELECT id AS cell, min(m) AS comp FROM rc GROUP BY id), oc AS (SELECT comp FROM pc GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1), lk AS (SELECT * FROM pc WHERE comp NOT IN (SELECT comp FROM oc)), bo AS (SELECT comp, owner, count(*) AS n FROM links l JOIN lk ON l.a = lk.cell JOIN co ON l.b = co.cell WHERE owner >= 0 GROUP BY 1, 2), be AS (SELECT comp, owner FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY n DESC, owner) AS r FROM bo) WHERE r = 1) SELECT co.cell, coalesce(be.owner, co.owner)::INT AS owner FROM co LEFT JOIN lk ON co.cell = lk.cell LEFT JOIN be ON lk.comp = be.comp")
def _(spark, d):
    return spatial.fill_enclosed(owned(spark, d), raster_links(spark, d))


@query("j42_dilation_frontier", f"WITH {LINKS}, {OWNED} SELECT l.a AS cell, min(y.owner) AS owner, count(*) AS n FROM links l JOIN co x ON l.a = x.cell JOIN co y ON l.b = y.cell WHERE x.owner < 0 AND y.owner >= 0 GROUP BY l.a HAVING count(DISTINCT y.owner) = 1")
def _(spark, d):
    return spatial.dilation_frontier(owned(spark, d), raster_links(spark, d))


@query("j24_unanchored", f"WITH RECURSIVE {LINKS}, {OWNED}, il AS (SELECT l.a, l.b FROM links l JOIN co x ON l.a = x.cell JOIN co y ON l.b = y.cell WHERE x.owner >= 0 AND x.owner = y.owner), rc AS (SELECT cell AS id, cell AS m FROM co UNION SELECT il.b, rc.m FROM rc JOIN il ON rc.id = il.a WHERE rc.m < il.b), pc AS (SELECT id AS cell, min(m) AS comp FROM rc GROUP BY id), kp AS (SELECT DISTINCT comp FROM pc JOIN co ON pc.cell = co.cell WHERE co.cell % 41 = 0 AND owner >= 0) SELECT co.cell, CASE WHEN owner >= 0 AND kp.comp IS NULL THEN -1 ELSE owner END AS owner FROM co JOIN pc ON co.cell = pc.cell LEFT JOIN kp ON pc.comp = kp.comp")
def _(spark, d):
    o = owned(spark, d)
    return spatial.drop_unanchored(o, raster_links(spark, d), o.where("cell % 41 = 0 AND owner >= 0"))


UPS = "v5 AS (SELECT cell, round(sum(density), 9) AS v FROM fo GROUP BY cell), up AS (SELECT cell, CASE WHEN bv > v THEN nb ELSE cell END AS up FROM (SELECT x.cell, x.v, y.v AS bv, y.cell AS nb, row_number() OVER (PARTITION BY x.cell ORDER BY y.v DESC NULLS LAST, y.cell) AS r FROM v5 x LEFT JOIN links ON links.a = x.cell LEFT JOIN v5 y ON links.b = y.cell) WHERE r = 1), ro AS (SELECT cell, up AS root FROM up UNION SELECT ro.cell, up.up FROM ro JOIN up ON ro.root = up.cell WHERE up.up <> up.cell)"


@query("j5_ascent_roots", with_("pos", recursive=True) + f", {FIELD}, {LINKS.removeprefix(CELLS + ', ')}, {UPS} SELECT ro.cell, ro.root FROM ro JOIN up ON ro.root = up.cell WHERE up.up = up.cell")
def _(spark, d):
    p = T.positions(spark, d)
    f = spatial.density(raster(spark, d), p, spatial.spacing(p)).select("cell", F.round("density", 9).alias("value"))
    return spatial.ascent_roots(f, raster_links(spark, d))


@query("j1_icosphere_owners")
def _(spark, d):
    grid, _ = spatial.icosphere(spark, 4)
    p = T.positions(spark, d)
    near = spatial.nearest(p, grid).join(p.select("idx", "owner"), "idx")
    return near.groupBy("cell").agg(F.count("*").alias("n"), F.min("owner").alias("owner"))


# K: one layout step over positions; links tie each position to two others
def pos_edges(spark, d):
    p = T.positions(spark, d)
    n, i = p.count(), F.col("idx").cast("long")
    e = p.select("idx", F.explode(F.array((i + 1) % n, (i * 7 + 3) % n).cast("array<int>")).alias("to"), "w")
    return e.where("idx != to").groupBy(F.least("idx", "to").alias("a"), F.greatest("idx", "to").alias("b")).agg(F.sum("w").alias("weight"))


@query("k13_anchor_force", with_("pos", j=f"SELECT p.idx, p.x AS px, p.y AS py, p.z AS pz, q.x, q.y, q.z, {ang('p.', 'q.')} AS d FROM pos p JOIN pos q ON q.idx = p.idx + 1", t="SELECT *, x - (x*px+y*py+z*pz)*px AS tx, y - (x*px+y*py+z*pz)*py AS ty, z - (x*px+y*py+z*pz)*pz AS tz FROM j") + f"SELECT idx, {rs('1.6 * d * tx / sqrt(tx*tx+ty*ty+tz*tz)', 'fx')}, {rs('1.6 * d * ty / sqrt(tx*tx+ty*ty+tz*tz)', 'fy')}, {rs('1.6 * d * tz / sqrt(tx*tx+ty*ty+tz*tz)', 'fz')} FROM t")
def _(spark, d):
    p = T.positions(spark, d)
    a = p.select((F.col("idx") - 1).alias("idx"), F.lit(0.8).alias("strength"), *(F.col(c).alias(f"p{c}") for c in "xyz"))
    return layout.anchor_forces(p, a).select("idx", *(r6(F.col(c), c) for c in ("fx", "fy", "fz")))


@query("k10_repulsion", with_("pos", k=f"SELECT p.idx AS a, q.idx AS b, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, p.owner = q.owner AS same, greatest(1e-6, {ang('p.', 'q.')}) AS d, p.x*q.x+p.y*q.y+p.z*q.z AS dt FROM pos p JOIN pos q ON p.idx < q.idx AND {ang('p.', 'q.')} <= 0.3", n="SELECT *, 0.58 * sqrt(4 * pi() / (SELECT count(*) FROM pos)) AS c FROM k", f="SELECT *, least(0.5, 0.01 / tan(d/2) * CASE WHEN same THEN 0.24 ELSE 1 END + 0.36 * greatest(0.0, (c-d)/c)^2) AS f, sqrt(1 - dt*dt) AS s FROM n", e="SELECT a AS idx, -f*(bx-dt*ax)/s AS fx, -f*(by_-dt*ay)/s AS fy, -f*(bz-dt*az)/s AS fz FROM f UNION ALL SELECT b, -f*(ax-dt*bx)/s, -f*(ay-dt*by_)/s, -f*(az-dt*bz)/s FROM f") + f"SELECT idx, {rs('sum(fx)', 'fx')}, {rs('sum(fy)', 'fy')}, {rs('sum(fz)', 'fz')} FROM e GROUP BY idx")
def _(spark, d):
    p = T.positions(spark, d)
    return layout.near_repulsion(p, p.count(), 0.3, "owner").select("idx", *(r6(F.col(c), c) for c in ("fx", "fy", "fz")))


@query("k9_k16_spring_energy")
def _(spark, d):
    p = T.positions(spark, d)
    f = layout.spring_forces(pos_edges(spark, d), p, p.count())
    return f.select("idx", *(r6(F.col(c), c) for c in ("fx", "fy", "fz")))


@query("k11_k18_k19_layout")
def _(spark, d):
    p = indexing.dense_index(T.positions(spark, d).withColumnRenamed("idx", "vec"), "vec")
    return layout.solve(pos_edges(spark, d), p, p.count(), iterations=2).select("idx", *(F.round(c, 4).alias(c) for c in "xyz"))


@query("k24_overlaps", with_("pos") + f"SELECT count(*) AS pairs, {rs('coalesce(max(0.06 - ' + ang('p.', 'q.') + '), 0)', 'deepest')} FROM pos p JOIN pos q ON p.idx < q.idx AND 0.06 - {ang('p.', 'q.')} > 1e-5")
def _(spark, d):
    p = T.positions(spark, d)
    return layout.overlaps(p, p.select("idx", F.lit(0.03).alias("radius"))).select("pairs", r6(F.col("deepest"), "deepest"))


@query("d27_k30_displacement", with_("pos") + f"SELECT {rs('max(' + ang('p.', 'q.') + ')', 'greatest')}, {rs('avg(' + ang('p.', 'q.') + ')', 'mean')} FROM pos p JOIN pos q ON q.idx = p.idx + 1")
def _(spark, d):
    p = T.positions(spark, d)
    return layout.displacement(p, p.withColumn("idx", F.col("idx") - 1)).select(r6(F.col("greatest"), "greatest"), r6(F.col("mean"), "mean"))


@query("d30_norm_error", with_("pos") + f"SELECT {rs('max(abs(sqrt(x*x+y*y+z*z) - 1))', 'error')} FROM pos")
def _(spark, d):
    return layout.norm_error(T.positions(spark, d)).select(r6(F.col("error"), "error"))


# L: changes
@query("l1_l2_flushes", with_("ev", s="SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY key ORDER BY ts, reason) IS NULL OR ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, reason) > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM ev", g="SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts, reason ROWS UNBOUNDED PRECEDING) AS k FROM s") + "SELECT key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS flush_at, count(*) AS n, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM g GROUP BY key, k")
def _(spark, d):
    f = changes.flushes(T.change_events(spark, d), "1 hour")
    return f.select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("flush_at", "yyyy-MM-dd HH:mm:ss").alias("flush_at"), "n", F.array_join("reasons", ",").alias("reasons"))


@query("l6_stale_results", "WITH r AS (SELECT event_id, user_id AS operation, event_type AS mode, event_id % 3 AS signature FROM events), a AS (SELECT user_id AS operation, min(event_type) AS mode FROM events GROUP BY 1) SELECT event_id, r.operation, r.mode FROM r JOIN a ON r.operation = a.operation AND r.mode = a.mode WHERE signature = 1")
def _(spark, d):
    e = T.table(spark, d, "events")
    r = e.select("event_id", F.col("user_id").alias("operation"), F.col("event_type").alias("mode"), (F.col("event_id") % 3).alias("signature"))
    active = e.groupBy(F.col("user_id").alias("operation")).agg(F.min("event_type").alias("mode")).withColumn("signature", F.lit(1).cast("long"))
    return changes.current_results(r, active).select("event_id", "operation", "mode")


@query("h51_l5_status", "SELECT event_id, CASE WHEN value > 50 THEN 'Changes pending' ELSE 'Up to date' END AS text, value > 50 AS may_refresh, CASE WHEN value > 50 THEN 'refreshing' ELSE 'fixed-clean' END AS next FROM events")
def _(spark, d):
    state = F.when(F.col("value") > 50, "fixed-dirty").otherwise("fixed-clean")
    s = changes.status(state)
    return T.table(spark, d, "events").select("event_id", s["text"].alias("text"), s["may_refresh"].alias("may_refresh"), changes.next_state(state, F.lit("start")).alias("next"))


# M: validation
RAW = "raw AS (SELECT CASE WHEN idx % 50 = 1 THEN 0 ELSE idx END AS path, CASE WHEN idx % 40 = 2 THEN 'nan'::DOUBLE WHEN idx % 40 = 3 THEN 0 ELSE x END AS x, CASE WHEN idx % 40 = 3 THEN 0 ELSE y END AS y, CASE WHEN idx % 40 = 3 THEN 0 WHEN idx % 40 = 4 THEN 2 * z ELSE z END AS z FROM pos)"


def raw_positions(spark, d):
    i = F.col("idx")
    p = T.positions(spark, d)
    return p.select(F.when(i % 50 == 1, 0).otherwise(i).alias("path"), F.when(i % 40 == 2, float("nan")).when(i % 40 == 3, 0.0).otherwise(F.col("x")).alias("x"), F.when(i % 40 == 3, 0.0).otherwise(F.col("y")).alias("y"), F.when(i % 40 == 3, 0.0).when(i % 40 == 4, 2 * F.col("z")).otherwise(F.col("z")).alias("z"))


@query("m1_m2_position_faults", with_("pos") + f", {RAW}, c AS (SELECT path, CASE WHEN isnan(x) THEN 'not-finite' WHEN sqrt(x*x+y*y+z*z) <= 1e-12 THEN 'zero' WHEN abs(sqrt(x*x+y*y+z*z) - 1) > 1e-4 THEN 'not-unit' WHEN count(*) OVER (PARTITION BY path) > 1 THEN 'repeated' END AS code FROM raw) SELECT path, code FROM c WHERE code IS NOT NULL")
def _(spark, d):
    return validation.position_faults(raw_positions(spark, d))


@query("m1_valid_positions", with_("pos") + "SELECT idx AS path, owner FROM pos")
def _(spark, d):
    p = T.positions(spark, d).withColumnRenamed("idx", "path")
    return validation.valid_positions(p).unionByName(validation.valid_positions(raw_positions(spark, d).withColumns({"owner": F.lit(0), "w": F.lit(0.0)}))).select("path", "owner")


@query("m3_parsed_edges", with_("edges") + "SELECT src_id, dst_id, weight, fwd, bwd FROM edges WHERE (fwd + bwd) % 5 <> 0")
def _(spark, d):
    e = full_edges(spark, d)
    turned = e.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), F.when(F.col("weight") % 5 == 0, F.col("weight") + 1).otherwise(F.col("weight")).alias("weight"), F.col("bwd").alias("fwd"), F.col("fwd").alias("bwd"))
    return validation.parsed_edges(turned, T.notes(spark, d).select(F.col("path").alias("id")))


@query("m4_m5_snapshot_faults", with_("edges", "notes", n="SELECT id FROM notes WHERE NOT id LIKE '%9.md'", p="SELECT id FROM notes WHERE NOT id LIKE '%8.md'", f="SELECT 'unknown-path' AS code, (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM n)) AS n UNION ALL SELECT 'missing-position', (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM p)) UNION ALL SELECT 'unknown-end', (SELECT count(*) FROM (SELECT src_id AS id FROM edges UNION SELECT dst_id FROM edges) WHERE id NOT IN (SELECT id FROM n)) UNION ALL SELECT 'unparsable-edge', (SELECT count(*) FROM edges WHERE src_id LIKE '%9.md' OR dst_id LIKE '%9.md')") + "SELECT code, n FROM f WHERE n > 0")
def _(spark, d):
    ids = T.notes(spark, d).select(F.col("path").alias("id"))
    placed = ids.where("NOT id LIKE '%8.md'").select(F.col("id").alias("path"), F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return validation.snapshot_faults(ids.where("NOT id LIKE '%9.md'"), full_edges(spark, d), placed)


@query("g9_prune", with_("edges") + "SELECT src_id, dst_id, weight FROM edges WHERE NOT src_id LIKE '%5.md' AND NOT dst_id LIKE '%5.md'")
def _(spark, d):
    n = T.notes(spark, d).select(F.col("path").alias("id"))
    return validation.pruned(n, full_edges(spark, d), n.select(F.col("id").alias("path")), n.where("NOT id LIKE '%5.md'"))[1].select("src_id", "dst_id", "weight")


@query("m13_settings", "WITH s AS (SELECT c_custkey, c_custkey % 4 AS k, CASE WHEN c_custkey % 7 = 0 THEN 'none' ELSE c_acctbal::VARCHAR END AS v FROM customer) SELECT CASE k WHEN 0 THEN 'debounceMs' WHEN 1 THEN 'iterations' WHEN 2 THEN 'globeSize' ELSE 'refreshHops' END AS key, CASE k WHEN 0 THEN CASE WHEN v = 'none' THEN 750 ELSE least(10000, greatest(100, v::DOUBLE)) END WHEN 1 THEN CASE WHEN v = 'none' THEN 1500 ELSE least(10000, greatest(1, v::DOUBLE)) END WHEN 2 THEN CASE WHEN v = 'none' THEN 100 ELSE least(400, greatest(60, v::DOUBLE)) END ELSE CASE WHEN v = 'none' THEN 1 ELSE least(6, greatest(0, v::DOUBLE)) END END::DOUBLE AS value FROM s")
def _(spark, d):
    k = F.col("c_custkey") % 4
    c = T.table(spark, d, "customer").select(F.when(k == 0, "debounceMs").when(k == 1, "iterations").when(k == 2, "globeSize").otherwise("refreshHops").alias("key"), F.when(F.col("c_custkey") % 7 == 0, "none").otherwise(F.col("c_acctbal").cast("string")).alias("value"))
    return validation.parsed_settings(c)


@query("m14_selection", with_("edges") + "SELECT id, count(*) AS n, array_to_string(list(o ORDER BY o), '|') AS others FROM (SELECT src_id AS id, dst_id AS o FROM edges UNION SELECT dst_id, src_id FROM edges) WHERE id LIKE '%1.md' GROUP BY id")
def _(spark, d):
    return G.neighbours(full_edges(spark, d)).where("id LIKE '%1.md'").select("id", F.size("neighbours").cast("long").alias("n"), F.array_join("neighbours", "|").alias("others"))


@query("c11_committed_positions", with_("notes", s="SELECT id, length(id)::DOUBLE AS x FROM notes") + "SELECT CASE WHEN starts_with(id, 'ASIA/') THEN 'EAST/' || id[6:] ELSE id END AS id, x FROM s WHERE NOT starts_with(id, 'EUROPE/')")
def _(spark, d):
    ids = T.notes(spark, d).select(F.col("path").alias("id"))
    new = F.when(F.col("id").startswith("ASIA/"), F.concat(F.lit("EAST/"), F.expr("substring(id, 6)"))).otherwise(F.col("id"))
    saved = ids.where("NOT id LIKE 'EUROPE/%'").select("id", F.length("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    hints = ids.select(F.col("id").alias("old_path"), new.alias("new_path")).where("old_path != new_path")
    return D.committed_positions(ids.select(new.alias("id")), saved, hints).select("id", "x")
