"""Aggregates over the sphere and over groups: means, moments, medoids, caps, ports, rotations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions import sphere as S
from meridian.operators.ranking import gate, mid_rank
from meridian.sources.state import checkpointed


def weighted_mean(points: DataFrame, *group: str, weight: str = "w") -> DataFrame:
    """(group, x, y, z): the direction of the weighted sum of unit vectors, null where it vanishes. Negative or infinite weights are errors."""
    bad = (F.col(weight) < 0) | F.isnan(weight) | (F.col(weight) == float("inf"))
    w = F.when(bad, F.raise_error(F.lit("weights must be finite and not negative")).cast("double")).otherwise(F.col(weight))
    g = points.groupBy(*group).agg(*(F.sum(w * F.col(c)).alias(c) for c in "xyz"))
    m = S.normal(S.vec(), S.TINY)
    return g.select(*group, *(c.alias(n) for c, n in zip(m, "xyz")))


CELL, SALTS = 0.125, 32  #: side of the cubes that hold points close to each other; parts that the rows of a group are dealt to


def _meet(points: DataFrame, few: DataFrame, group: str) -> DataFrame:
    """points joined with few rows a group: those are repeated SALTS times, so that a large group is spread over tasks."""
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    one = points.withColumn("_salt", F.pmod(F.xxhash64("idx"), F.lit(SALTS)).cast("int"))
    return one.join(salted.withColumnRenamed(group, "_few"), (F.col(group).eqNullSafe(F.col("_few"))) & (one["_salt"] == salted["_salt"])).drop("_few", "_salt")


def medoid(points: DataFrame, group: str) -> DataFrame:
    """(group, idx): the point with the least sum of angles to those of its group, ties (of sums rounded to 9 digits) to the lesser idx.

    A point stands for each cube of side CELL; as the sphere has fewer than 13 / CELL^2 such cubes, a group has a bounded
    number. Sums with a cube's points at its place are off by no more than the sum of all points' angles to their cubes'
    (triangle inequality), so only points within twice that of the least can be the medoid, and only those meet all points.
    """
    cube = F.array(*(F.floor(F.col(c) / CELL) for c in "xyz"))
    p = points.select(group, "idx", "x", "y", "z", cube.alias("_c"))
    at = p.groupBy(group, "_c").agg(F.min(F.struct("idx", "x", "y", "z")).alias("o"))
    cells = checkpointed(at.select(F.col(group).alias("_g"), F.col("_c").alias("_k"), *(F.col(f"o.{c}").alias(f"o{c}") for c in "xyz")))
    near = p.join(cells, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_c") == F.col("_k")))
    near = checkpointed(near.groupBy("_g", "_k", "ox", "oy", "oz").agg(F.count("*").alias("n"), F.sum(S.angle(S.vec("o"), S.vec())).alias("off")))
    packed = near.groupBy(F.col("_g").alias(group)).agg(F.collect_list(F.struct("ox", "oy", "oz", "n")).alias("_o"), F.sum("off").alias("_off"))
    about = F.aggregate("_o", F.lit(0.0), lambda s, o: s + o["n"] * S.angle(S.vec(), S.Vec(o["ox"], o["oy"], o["oz"])))
    rough = checkpointed(_meet(p.drop("_c"), packed, group).select(group, "idx", "x", "y", "z", about.alias("_about"), "_off"))
    least = rough.groupBy(F.col(group).alias("_g")).agg(F.min("_about").alias("_least"))
    some = rough.join(least, F.col(group).eqNullSafe(F.col("_g"))).where(F.col("_about") <= F.col("_least") + 2 * F.col("_off") + 1e-6)
    some = some.select(group, F.col("idx").alias("_idx"), *(F.col(c).alias(f"o{c}") for c in "xyz"))
    sums = _meet(p.drop("_c"), some, group).groupBy(group, "_idx").agg(F.round(F.sum(S.angle(S.vec("o"), S.vec())), 9).alias("_d"))
    return sums.groupBy(group).agg(F.min_by("_idx", F.struct("_d", "_idx")).alias("idx"))


def coverage(points: DataFrame, *group: str) -> DataFrame:
    """mean vector and its norm, second moment (xx, xy, xz, yy, yz, zz), and isotropy = |C - I/3|² of unit vectors."""
    terms = {"xx": ("x", "x"), "xy": ("x", "y"), "xz": ("x", "z"), "yy": ("y", "y"), "yz": ("y", "z"), "zz": ("z", "z")}
    g = points.groupBy(*group).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"), *(F.avg(F.col(a) * F.col(b)).alias(n) for n, (a, b) in terms.items()))
    third = 1 / 3
    iso = F.pow(F.col("xx") - third, F.lit(2)) + F.pow(F.col("yy") - third, F.lit(2)) + F.pow(F.col("zz") - third, F.lit(2)) + 2 * (F.col("xy") * F.col("xy") + F.col("xz") * F.col("xz") + F.col("yz") * F.col("yz"))
    return g.withColumns({"norm": S.length(S.Vec(F.col("mx"), F.col("my"), F.col("mz"))), "isotropy": iso})


def moment_eigenvalues(moments: DataFrame) -> DataFrame:
    """moments with e1 >= e2 >= e3, the eigenvalues of the symmetric matrix (xx, xy, xz, yy, yz, zz), by the trigonometric formula."""
    c = F.col
    q = (c("xx") + c("yy") + c("zz")) / 3
    off = c("xy") * c("xy") + c("xz") * c("xz") + c("yz") * c("yz")
    d = moments.withColumn("_q", q).withColumn("_p", F.sqrt((F.pow(c("xx") - c("_q"), F.lit(2)) + F.pow(c("yy") - c("_q"), F.lit(2)) + F.pow(c("zz") - c("_q"), F.lit(2)) + 2 * off) / 6))
    a, b, e = c("xx") - c("_q"), c("yy") - c("_q"), c("zz") - c("_q")
    det = a * (b * e - c("yz") * c("yz")) - c("xy") * (c("xy") * e - c("yz") * c("xz")) + c("xz") * (c("xy") * c("yz") - b * c("xz"))
    d = d.withColumn("_f", F.acos(S.clamp(det / (2 * F.pow(c("_p"), F.lit(3))), -1.0, 1.0)) / 3)
    e1, e3 = c("_q") + 2 * c("_p") * F.cos("_f"), c("_q") + 2 * c("_p") * F.cos(c("_f") + 2 * math.pi / 3)
    flat = c("_p") < 1e-15
    d = d.withColumns({"e1": F.when(flat, c("_q")).otherwise(e1), "e3": F.when(flat, c("_q")).otherwise(e3)})
    return d.withColumn("e2", 3 * c("_q") - c("e1") - c("e3")).drop("_q", "_p", "_f")


def cap_radius(points: DataFrame, centres: DataFrame, group: str, spacing: Column) -> DataFrame:
    """(group, radius): greatest angle from the centre, plus min(.14, .6 spacing), within .12 to 1.55."""
    c = centres.select(group, *(F.col(n).alias(f"c{n}") for n in "xyz"))
    j = points.join(c, group).groupBy(group).agg(F.max(S.angle(S.vec("c"), S.vec())).alias("far"))
    return j.select(group, S.clamp(F.col("far") + F.least(F.lit(0.14), 0.6 * spacing), 0.12, 1.55).alias("radius"))


def destinations(targets: DataFrame) -> DataFrame:
    """(node, dest, w, x, y, z): weight and mean direction by destination group of targets(node, dest, w, x, y, z) of positive weight."""
    g = targets.where("w > 0").groupBy("node", "dest").agg(F.sum("w").alias("weight"), *(F.sum(F.col("w") * F.col(c)).alias(c) for c in "xyz"))
    m = S.normal(S.vec())
    return g.select("node", "dest", F.col("weight").alias("w"), *(c.alias(n) for c, n in zip(m, "xyz")))


def port_facts(nodes: DataFrame, dests: DataFrame) -> DataFrame:
    """(node, group, mass, share, diversity, coherence): weight to other groups, its share of `incident`, 1 - sum of squared shares (0 for one
    destination), and the length of the weighted sum of tangents over the weight. nodes(node, group, incident, ox, oy, oz)."""
    j = dests.join(nodes.select("node", "ox", "oy", "oz"), "node")
    t = S.normal(S.tangent_part(S.vec("o"), S.vec()))
    j = j.withColumns({f"t{n}": F.coalesce(c, F.lit(0.0)) for n, c in zip("xyz", t)})
    g = j.groupBy("node").agg(F.sum("w").alias("mass"), F.count("*").alias("k"), F.sum(F.col("w") * F.col("w")).alias("w2"), *(F.sum(F.col("w") * F.col(f"t{c}")).alias(f"s{c}") for c in "xyz"))
    diversity = F.when(F.col("k") <= 1, 0.0).otherwise(S.clamp(1 - F.col("w2") / (F.col("mass") * F.col("mass")), 0.0, 1.0))
    coherence = S.clamp(S.length(S.vec("s")) / F.col("mass"), 0.0, 1.0)
    f = nodes.join(g, "node", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    share = F.when(F.col("incident") > 0, S.clamp(F.col("mass") / F.col("incident"), 0.0, 1.0)).otherwise(0.0)
    return f.select("node", "group", "mass", F.round(share, 9).alias("share"), F.round(F.coalesce(diversity, F.lit(0.0)), 9).alias("diversity"), F.coalesce(coherence, F.lit(0.0)).alias("coherence"))


def port_scores(facts: DataFrame, low: float = 0.2, high: float = 0.65) -> DataFrame:
    """facts with mid-rank percentiles in their group and score = (.55 mass + .30 share + .15 diversity) percentiles times the coherence gate."""
    ok = F.col("mass") > 0
    p = facts.withColumns({f"p_{c}": mid_rank(c, "group", ok) for c in ("mass", "share", "diversity")})
    raw = 0.55 * F.col("p_mass") + 0.30 * F.col("p_share") + 0.15 * F.col("p_diversity")
    return p.withColumn("score", F.when(ok, raw * gate(F.col("coherence"), low, high)).otherwise(0.0))


def separated_top(scores: DataFrame, group: str, apart: float, capacity: int) -> DataFrame:
    """Of each group, greedily by score, coherence, mass (high first, nulls last), node: those at least `apart` from all taken before, up to `capacity`.

    A round takes one row of every group that has one left, by a grouped minimum, so no group is in one task; only the
    rows taken, at most `capacity` a group, are kept between rounds.
    """
    rows = checkpointed(scores)
    rank = F.struct(*(F.coalesce(-F.col(c), F.lit(float("inf"))) for c in ("score", "coherence", "mass")), F.col("node"))
    taken = None
    for _ in range(capacity):
        left = rows
        if taken is not None:
            before = taken.groupBy(F.col(group).alias("_g")).agg(F.collect_list(F.struct("x", "y", "z")).alias("_t"))
            far = F.forall("_t", lambda t: S.angle(S.vec(), S.Vec(t["x"], t["y"], t["z"])) >= apart)
            left = rows.join(before, F.col(group).eqNullSafe(F.col("_g"))).where(far).select(*rows.columns)
        best = checkpointed(left.groupBy(F.col(group).alias("_g")).agg(F.min_by(F.struct(*rows.columns), rank).alias("_b")).select("_b.*"))
        if best.isEmpty():
            break
        taken = best if taken is None else taken.union(best)
    return taken if taken is not None else rows


def best_rotation(pairs: DataFrame) -> np.ndarray:
    """The proper rotation that takes points (ax, ay, az) closest to (bx, by, bz): eigenvector of the 4x4 matrix of nine sums."""
    s = pairs.agg(*(F.coalesce(F.sum(F.col(f"a{i}") * F.col(f"b{j}")), F.lit(0.0)).alias(f"{i}{j}") for i in "xyz" for j in "xyz")).first()
    m = np.array([[s[f"{i}{j}"] for j in "xyz"] for i in "xyz"])
    z = np.array([m[1, 2] - m[2, 1], m[2, 0] - m[0, 2], m[0, 1] - m[1, 0]])
    k = np.zeros((4, 4))
    k[0, 0], k[0, 1:], k[1:, 0] = np.trace(m), z, z
    k[1:, 1:] = m + m.T - np.trace(m) * np.eye(3)
    w, x, y, zz = np.linalg.eigh(k)[1][:, -1]
    return np.array([[1 - 2 * (y * y + zz * zz), 2 * (x * y - w * zz), 2 * (x * zz + w * y)], [2 * (x * y + w * zz), 1 - 2 * (x * x + zz * zz), 2 * (y * zz - w * x)], [2 * (x * zz - w * y), 2 * (y * zz + w * x), 1 - 2 * (x * x + y * y)]])


def rotated(points: DataFrame, r: np.ndarray) -> DataFrame:
    return points.withColumns({n: sum((F.lit(float(r[i, j])) * F.col(c) for j, c in enumerate("xyz")), F.lit(0.0)) for i, n in enumerate("xyz")})


def match_groups(prev: DataFrame, cur: DataFrame, least: float = 0.42) -> DataFrame:
    """(prev, cur, similarity): groups(group, id) matched one to one by Jaccard similarity of at least `least`, greatest first, then by name.

    Similarities come from one equality join on ids. A greedy pass needs an order over the pairs of a connected bunch of
    groups, so each bunch is walked in a task of its own.
    """
    from meridian.operators.traversal import components

    sp, sc = prev.groupBy(F.col("group").alias("prev")).agg(F.countDistinct("id").alias("np")), cur.groupBy(F.col("group").alias("cur")).agg(F.countDistinct("id").alias("nc"))
    both = prev.select(F.col("group").alias("prev"), "id").distinct().join(cur.select(F.col("group").alias("cur"), "id").distinct(), "id").groupBy("prev", "cur").agg(F.count("*").alias("n"))
    sim = both.join(sp, "prev").join(sc, "cur").select("prev", "cur", F.round(F.col("n") / (F.col("np") + F.col("nc") - F.col("n")), 9).alias("similarity")).where(F.col("similarity") >= least)
    bunch = components(sim.select(F.concat(F.lit("p:"), "prev").alias("src"), F.concat(F.lit("c:"), "cur").alias("dst")))

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for r in g.sort_values(["similarity", "prev", "cur"], ascending=[False, True, True]).itertuples(index=False):
            if ("p", r.prev) not in used and ("c", r.cur) not in used:
                used |= {("p", r.prev), ("c", r.cur)}
                rows.append((r.prev, r.cur, r.similarity))
        return pd.DataFrame(rows, columns=["prev", "cur", "similarity"])

    named = sim.join(bunch, F.concat(F.lit("p:"), "prev") == F.col("id"))
    return named.groupBy("component").applyInPandas(walk, f"prev {sim.schema['prev'].dataType.simpleString()}, cur {sim.schema['cur'].dataType.simpleString()}, similarity double")
