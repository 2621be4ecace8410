"""Queries of the hashing and sphere functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meridian.functions import hashing as H
from meridian.functions import sphere as S
from meridian.operators import ranking
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


def _mix(x: str) -> str:
    a = f"(xor({x}, {x} >> 16) * {H.MIX_A}) % 4294967296"
    b = f"(xor(({a}), ({a}) >> 15) * {H.MIX_B}) % 4294967296"
    return f"xor(({b}), ({b}) >> 15)"


def _fold(s: str, seed: str) -> str:
    return f"list_reduce(list_concat([{seed}::BIGINT], list_transform(string_split({s}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * {H.PRIME}) % 4294967296)"


def _byte_fold(s: str, seed: str) -> str:
    return f"list_reduce(list_concat([{seed}::BIGINT], list_transform(string_split({s}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor((xor(h, c & 255) * {H.PRIME}) % 4294967296, c >> 8) * {H.PRIME}) % 4294967296)"


@query("h4_h6_text_hashes", f"WITH a AS (SELECT p_partkey, {_fold('length(p_name) || chr(58) || p_name || chr(59)', str(H.OFFSET))} AS h4, {_byte_fold('p_name', str(H.OFFSET))} AS f FROM part) SELECT p_partkey, h4, {_mix('f')} AS h6 FROM a")
def _(spark, d):
    return T.table(spark, d, "part").select("p_partkey", H.parts_hash(F.array("p_name")).alias("h4"), H.byte_hash(F.coalesce("p_name", F.lit(""))).alias("h6"))


@query("h5_h7_h10_number_hashes", f"WITH a AS (SELECT p_partkey, p_size, {_mix('p_partkey')} AS m, {_mix('7::BIGINT')} AS s FROM part), b AS (SELECT *, {_mix('xor(s, p_partkey)')} AS t FROM a), c AS (SELECT *, {_mix('xor(t, p_size::BIGINT)')} AS h FROM b) SELECT p_partkey, m AS h5, h AS h7, h::DOUBLE / 4294967296 AS unit, h::DOUBLE / 4294967296 * 2 - 1 AS signed FROM c")
def _(spark, d):
    h = H.number_hash(7, F.col("p_partkey"), F.col("p_size").cast("long"))
    return T.table(spark, d, "part").select("p_partkey", H.mix32(F.col("p_partkey")).alias("h5"), h.alias("h7"), H.unit_float(h).alias("unit"), H.signed_float(h).alias("signed"))


@query("h8_h9_pair_hashes", f"""WITH p AS (SELECT p_partkey, least(p_brand, p_type) AS a, greatest(p_brand, p_type) AS b, {_mix('0::BIGINT')} AS s FROM part), q AS (SELECT *, {_byte_fold('a', 's')} AS f FROM p), q1 AS (SELECT *, {_mix('f')} AS h FROM q),
    r AS (SELECT *, (h * {H.PRIME}) % 4294967296 AS g FROM q1), r0 AS (SELECT *, (g * {H.PRIME}) % 4294967296 AS g2 FROM r), r1 AS (SELECT *, {_mix('g2')} AS k FROM r0), t AS (SELECT *, {_byte_fold('b', 'k')} AS e FROM r1) SELECT p_partkey, {_mix('e')} AS pair FROM t""")
def _(spark, d):
    return T.table(spark, d, "part").select("p_partkey", H.unordered_pair_hash(F.col("p_type"), F.col("p_brand")).alias("pair"))


def _sig(parts: list[str]) -> str:
    """CTEs that chain both hashes over framed parts of table p."""
    out, a, b = [], str(H.OFFSET), str(H.OFFSET_B)
    for i, s in enumerate(parts):
        framed = f"length({s}) || chr(58) || {s} || chr(59)"
        out.append(f"a{i} AS (SELECT *, {_fold(framed, a)} AS a_{i} FROM {f'b{i - 1}' if i else 'p'})")
        out.append(f"b{i} AS (SELECT *, {_fold(framed, f'xor({b}::BIGINT, a_{i})')} AS b_{i} FROM a{i})")
        a, b = f"a_{i}", f"b_{i}"
    return ", ".join(out)


@query("h1_h2_signatures", f"WITH p AS (SELECT p_partkey, 'orphans:1' AS s0, 'exclude:' || p_brand AS s1, 'exclude:' || p_type AS s2 FROM part), {_sig(['s0', 's1', 's2'])} SELECT p_partkey, 'gf1-' || lpad(lower(to_hex(a_2)), 8, '0') || lpad(lower(to_hex(b_2)), 8, '0') AS signature FROM b2")
def _(spark, d):
    return T.table(spark, d, "part").select("p_partkey", H.filter_signature(True, F.array("p_brand", "p_type")).alias("signature"))


PAIRS = with_("pos", q="SELECT a.idx, a.owner, a.w, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM pos a JOIN pos b ON b.idx = a.idx + 1", d="SELECT *, ax*bx + ay*by_ + az*bz AS dot, ay*bz - az*by_ AS cx, az*bx - ax*bz AS cy, ax*by_ - ay*bx AS cz FROM q", g="SELECT *, atan2(sqrt(cx*cx + cy*cy + cz*cz), least(1.0, greatest(-1.0, dot))) AS ang FROM d")


def pairs(spark, d):
    """Each position with the one of the next index: columns ax, ay, az, bx, by_, bz."""
    p = T.positions(spark, d)
    a = p.select("idx", "owner", "w", *(F.col(c).alias(f"a{c}") for c in "xyz"))
    b = p.select((F.col("idx") - 1).alias("idx"), F.col("x").alias("bx"), F.col("y").alias("by_"), F.col("z").alias("bz"))
    return a.join(b, "idx")


def ends() -> tuple[S.Vec, S.Vec]:
    """Both vectors of a pair."""
    return S.Vec(F.col("ax"), F.col("ay"), F.col("az")), S.Vec(F.col("bx"), F.col("by_"), F.col("bz"))


def r6(c, name):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def rs(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def vec3(v, prefix=""):
    return [r6(c, prefix + n) for c, n in zip(v, "xyz")]


@query("h13_h14_vectors", PAIRS + f"SELECT idx, {rs('dot', 'dot')}, {rs('cx', 'x')}, {rs('cy', 'y')}, {rs('cz', 'z')}, {rs('(ax-bx)^2 + (ay-by_)^2 + (az-bz)^2', 'd2')}, {rs('sqrt((2*ax+bx)^2 + (2*ay+by_)^2 + (2*az+bz)^2)', 'len')} FROM g")
def _(spark, d):
    A, B = ends()
    diff = S.sub(A, B)
    return pairs(spark, d).select("idx", r6(S.dot(A, B), "dot"), *vec3(S.cross(A, B)), r6(S.dot(diff, diff), "d2"), r6(S.length(S.add(S.scale(A, 2.0), B)), "len"))


@query("h15_h16_normal_and_tangent", PAIRS + f"SELECT idx, {rs('CASE WHEN idx % 9 = 0 THEN NULL ELSE cx / sqrt(cx*cx + cy*cy + cz*cz) END', 'n')}, {rs('bx - dot*ax', 'x')}, {rs('by_ - dot*ay', 'y')}, {rs('bz - dot*az', 'z')} FROM g")
def _(spark, d):
    A, B = ends()
    n = S.normal(S.scale(S.cross(A, B), F.when(F.col("idx") % 9 == 0, 0.0).otherwise(1.0)))
    return pairs(spark, d).select("idx", r6(n.x, "n"), *vec3(S.tangent_part(A, B)))


_AX = "CASE k WHEN 0 THEN abs(ax) WHEN 1 THEN abs(ay) ELSE abs(az) END"
ORTHO = """o0 AS (SELECT *, abs(idx) % 3 AS s0 FROM g), o1 AS (SELECT *, CASE s0 WHEN 0 THEN abs(ax) WHEN 1 THEN abs(ay) ELSE abs(az) END AS m0, CASE (s0 + 1) % 3 WHEN 0 THEN abs(ax) WHEN 1 THEN abs(ay) ELSE abs(az) END AS m1 FROM o0),
    o2 AS (SELECT *, CASE WHEN m0 <= 0.85 THEN s0 WHEN m1 <= 0.85 THEN (s0 + 1) % 3 ELSE (s0 + 2) % 3 END AS k, CASE WHEN idx & 4 <> 0 THEN -1.0 ELSE 1.0 END AS sg FROM o1),
    o3 AS (SELECT *, sg * CASE k WHEN 0 THEN 0 WHEN 1 THEN -az ELSE ay END AS ox, sg * CASE k WHEN 0 THEN az WHEN 1 THEN 0 ELSE -ax END AS oy, sg * CASE k WHEN 0 THEN -ay WHEN 1 THEN ax ELSE 0 END AS oz FROM o2), o AS (SELECT *, sqrt(ox*ox + oy*oy + oz*oz) AS ol FROM o3) """


@query("h17_orthogonal", PAIRS + ", " + ORTHO + f"SELECT idx, {rs('ox/ol', 'x')}, {rs('oy/ol', 'y')}, {rs('oz/ol', 'z')} FROM o")
def _(spark, d):
    A, B = ends()
    return pairs(spark, d).select("idx", *vec3(S.orthogonal(A, F.col("idx"))))


TANGENT = ", t0 AS (SELECT *, bx - dot*ax AS tx, by_ - dot*ay AS ty, bz - dot*az AS tz FROM g), t AS (SELECT *, sqrt(tx*tx + ty*ty + tz*tz) AS tl FROM t0) "


@query("h18_h19_h20_distance", PAIRS + TANGENT + f"SELECT idx, {rs('ang', 'angle')}, {rs('least(1.2, greatest(0.4, ang))', 'clamped')}, {rs('tx/tl', 'x')}, {rs('ty/tl', 'y')}, {rs('tz/tl', 'z')} FROM t")
def _(spark, d):
    A, B = ends()
    ang = S.angle(A, B)
    return pairs(spark, d).select("idx", r6(ang, "angle"), r6(S.clamp(ang, 0.4, 1.2), "clamped"), *vec3(S.direction(A, B, F.col("idx"))))


@query("h21_exponential_map", PAIRS + TANGENT + ", u AS (SELECT *, 0.3 * tl AS n FROM t) " + f"SELECT idx, {rs('ax*cos(n) + tx/tl*sin(n)', 'x')}, {rs('ay*cos(n) + ty/tl*sin(n)', 'y')}, {rs('az*cos(n) + tz/tl*sin(n)', 'z')} FROM u")
def _(spark, d):
    A, B = ends()
    return pairs(spark, d).select("idx", *vec3(S.exp_map(A, S.scale(B, 0.3))))


@query("h22_k21_cone", PAIRS + TANGENT + f"SELECT idx, {rs('CASE WHEN ang <= 0.5 THEN bx ELSE ax*cos(0.5) + tx/tl*sin(0.5) END', 'x')}, {rs('CASE WHEN ang <= 0.5 THEN by_ ELSE ay*cos(0.5) + ty/tl*sin(0.5) END', 'y')}, {rs('CASE WHEN ang <= 0.5 THEN bz ELSE az*cos(0.5) + tz/tl*sin(0.5) END', 'z')}, ang > 0.5 AS capped FROM t")
def _(spark, d):
    A, B = ends()
    return pairs(spark, d).select("idx", *vec3(S.cone(B, A, 0.5)), (S.angle(A, B) > 0.5).alias("capped"))


@query("h23_lonlat", f"SELECT c_custkey, {rs('cos(radians(c_acctbal / 120)) * cos(radians(c_custkey % 360))', 'x')}, {rs('sin(radians(c_acctbal / 120))', 'y')}, {rs('cos(radians(c_acctbal / 120)) * sin(radians(c_custkey % 360))', 'z')} FROM customer")
def _(spark, d):
    return T.table(spark, d, "customer").select("c_custkey", *vec3(S.from_degrees((F.col("c_custkey") % 360).cast("double"), F.col("c_acctbal") / 120)))


@query("h24_slerp", PAIRS + f"SELECT idx, {rs('(ax*sin(0.75*ang) + bx*sin(0.25*ang)) / sin(ang)', 'x')}, {rs('(ay*sin(0.75*ang) + by_*sin(0.25*ang)) / sin(ang)', 'y')}, {rs('(az*sin(0.75*ang) + bz*sin(0.25*ang)) / sin(ang)', 'z')} FROM g")
def _(spark, d):
    A, B = ends()
    return pairs(spark, d).select("idx", *vec3(S.slerp(A, B, 0.25, F.col("idx"))))


@query("h25_h26_arc_samples", PAIRS + ", s AS (SELECT *, greatest(2, least(32, ceil(ang / (pi() / 24))))::INT AS k FROM g), e AS (SELECT *, unnest(range(0, k + 1))::INT AS step FROM s), f AS (SELECT *, step::DOUBLE / k AS t FROM e) " + f"SELECT idx, step, k AS segments, {rs('2 * (ax*sin((1-t)*ang) + bx*sin(t*ang)) / sin(ang)', 'x')}, {rs('2 * (ay*sin((1-t)*ang) + by_*sin(t*ang)) / sin(ang)', 'y')}, {rs('2 * (az*sin((1-t)*ang) + bz*sin(t*ang)) / sin(ang)', 'z')} FROM f")
def _(spark, d):
    A, B = ends()
    p = pairs(spark, d).withColumn("segments", S.arc_segments(S.angle(A, B))).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("segments"))))
    return p.select("idx", "step", "segments", *vec3(S.scale(S.slerp(A, B, F.col("step") / F.col("segments")), 2.0)))


@query("h28_tag_spiral", PAIRS + ", e AS (SELECT *, unnest(range(0, 9))::INT AS step FROM g), f AS (SELECT *, step / 8.0::DOUBLE AS t, 1 + step / 8.0::DOUBLE * 0.5 AS r FROM e) " + f"SELECT idx, step, {rs('r * (ax*sin((1-t)*ang) + bx*sin(t*ang)) / sin(ang)', 'x')}, {rs('r * (ay*sin((1-t)*ang) + by_*sin(t*ang)) / sin(ang)', 'y')} FROM f")
def _(spark, d):
    A, B = ends()
    p = pairs(spark, d).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("t", F.col("step") / 8)
    v = S.scale(S.slerp(A, B, F.col("t")), 1 + F.col("t") * 0.5)
    return p.select("idx", "step", r6(v.x, "x"), r6(v.y, "y"))


@query("h27_h37_budgets", "SELECT o_custkey, n, greatest(2, least(32, floor(180000 / (n * 1000))))::INT AS segments, least(400, greatest(60, floor(100 * (n * 50 / 100.0::DOUBLE) ** 0.25 / 5 + 0.5) * 5))::INT AS globe FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def _(spark, d):
    n = T.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", "n", S.edge_segments(F.col("n") * 1000).alias("segments"), S.globe_size(F.col("n") * 50).alias("globe"))


@query("h35_h36_markers", with_("deg") + f"SELECT id, {rs('2 * (1 + least(1.25, log2(degree + 1) * 0.22))', 'size')}, {rs('atan2(2 * (1 + least(1.25, log2(degree + 1) * 0.22)) * 1.12, 100.4)', 'radius')} FROM deg")
def _(spark, d):
    from meridian.operators import graph as G

    s = S.degree_scale(F.col("degree"), 50.0)
    return G.degrees(G.canonical_edges(G.valid_links(T.links(spark, d)))).select("id", r6(s, "size"), r6(S.collision_radius(s), "radius"))


@query("h31_matrix", PAIRS + f"SELECT idx, {rs('ax*bx + ay*by_ + az*bz', 'mx')}, {rs('az*bx + ax*by_ + ay*bz', 'my')}, {rs('ax*ax*ax + ay*ay*ay + az*az*az - 3*ax*ay*az', 'det')} FROM g")
def _(spark, d):
    """Circulant matrices of the first vector, applied to the second."""
    A, B = ends()
    rows = (A, S.Vec(A.z, A.x, A.y), S.Vec(A.y, A.z, A.x))
    return pairs(spark, d).select("idx", r6(S.dot(rows[0], B), "mx"), r6(S.dot(rows[1], B), "my"), r6(S.dot(rows[0], S.cross(rows[1], rows[2])), "det"))


@query("h42_h46_view_scalars", f"SELECT event_id, {rs('value / 1000', 'v')}, {rs('CASE WHEN value / 300 >= 1 THEN 45.0 ELSE least(85.0, degrees(2 * atan(tan(radians(26.0)) / (value / 300)))) END', 'fov')}, {rs('least(64.0, value) / 1000 * 0.07', 'step')}, {rs('CASE WHEN value < 100 THEN (1 - value*value/10000) ** 3 ELSE 0 END', 'kernel')}, {rs('least(4.0, 0.75 + ln(1 + value))', 'bounded')}, {rs('least(1.0, greatest(0.0, (value - 40) / 18)) ** 2 * (3 - 2 * least(1.0, greatest(0.0, (value - 40) / 18)))', 'fade')}, value >= 50 AS edges_shown FROM events")
def _(spark, d):
    from meridian.operators.traversal import bounded_weight

    v = F.col("value")
    return T.table(spark, d, "events").select("event_id", r6(v / 1000, "v"), r6(S.vertical_fov(v / 300), "fov"), r6(S.rotation_step(v), "step"), r6(S.compact_kernel(v, F.lit(100.0)), "kernel"), r6(bounded_weight(v), "bounded"), r6(S.smoothstep((v - 40) / 18), "fade"), (v >= 50).alias("edges_shown"))


@query("b19_occluded", PAIRS + ", c AS (SELECT *, 1.05*bx - 3*ax AS dx, 1.05*by_ - 3*ay AS dy, 1.05*bz - 3*az AS dz FROM g), e AS (SELECT *, dx*dx+dy*dy+dz*dz AS qa, 6*(ax*dx+ay*dy+az*dz) AS qb, 9*(ax*ax+ay*ay+az*az) - 1 AS qc FROM c) SELECT idx, qa > 0 AND qb*qb - 4*qa*qc >= 0 AND (-qb - sqrt(greatest(0, qb*qb - 4*qa*qc))) / (2*qa) > 1e-6 AND (-qb - sqrt(greatest(0, qb*qb - 4*qa*qc))) / (2*qa) < 1 - 1e-6 AS hidden FROM e")
def _(spark, d):
    A, B = ends()
    return pairs(spark, d).select("idx", S.occluded(S.scale(A, 3.0), S.scale(B, 1.05), 1.0).alias("hidden"))


GOLDEN = math.pi * (3 - math.sqrt(5))


@query("k1_fibonacci_sphere", f"WITH n AS (SELECT c_custkey AS i, count(*) OVER () AS n FROM customer), y AS (SELECT i, 1 - 2 * (i + 0.5::DOUBLE) / n AS y FROM n) SELECT i, {rs(f'cos(i * {GOLDEN!r}::DOUBLE) * sqrt(1 - y*y)', 'x')}, {rs('y', 'y')}, {rs(f'sin(i * {GOLDEN!r}::DOUBLE) * sqrt(1 - y*y)', 'z')} FROM y")
def _(spark, d):
    c = T.table(spark, d, "customer")
    n = c.agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(n)).select(F.col("c_custkey").alias("i"), "n").select("i", *vec3(S.fibonacci(F.col("i").cast("double"), F.col("n"))))


@query("h38_h39_fuzzy_scores", "WITH p AS (SELECT p_partkey, lower(p_name) AS n, length(p_name) - 2 AS extra, strpos(lower(p_name), 'la') AS a, strpos(lower(p_name), 'l') AS l FROM part), q AS (SELECT *, CASE WHEN l > 0 AND strpos(n[l + 1:], 'a') > 0 THEN l + strpos(n[l + 1:], 'a') ELSE 0 END AS k FROM p) SELECT p_partkey, CASE WHEN n = 'la' THEN 1000 WHEN a = 1 THEN 800 - extra WHEN a > 1 THEN 600 - 2 * (a - 1) - 0.1 * extra WHEN k > 0 THEN 300 + 10 * (k = l + 1)::INT - 3 * (k - l - 1) - (l - 1) ELSE -1 END::DOUBLE AS score FROM q")
def _(spark, d):
    return T.table(spark, d, "part").select("p_partkey", F.round(ranking.fuzzy_score(F.col("p_name"), "la"), 9).alias("score"))
