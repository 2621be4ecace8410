"""Joins and rasters on the unit sphere. Neighbours are found through buckets of space, never by comparing all with all."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions import sphere as S
from meridian.sources.state import checkpointed


def chord(angle: float) -> float:
    return 2 * float(np.sin(min(angle, np.pi) / 2))


def _cell(size: float) -> list[Column]:
    return [F.floor((F.col(c) + 1) / size).cast("int").alias(f"c{c}") for c in "xyz"]


def _around(size: float) -> Column:
    steps = [F.struct(*((F.floor((F.col(c) + 1) / size).cast("int") + F.lit(d)).alias(f"c{c}") for c, d in zip("xyz", (i, j, k)))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    return F.explode(F.array(*steps)).alias("c")


def first_radius(points: DataFrame, most: int = 64) -> float:
    """The greatest of the angles pi / 2, pi / 4, ... for whose cells no cell holds more than `most` points (idx, x, y, z), down to 2**-24 of pi.

    One pass counts the cells of all sizes.
    """
    sizes = {i: max(chord(float(np.pi) / 2**i), 1e-9) for i in range(1, 25)}
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), *_cell(s)) for i, s in sizes.items()))).alias("c")
    counts = points.select("x", "y", "z", cells).groupBy("c").agg(F.count("*").alias("n")).groupBy("c.level").agg(F.max("n").alias("n"))
    small = counts.where(F.col("n") <= most).agg(F.min("level")).first()[0]
    return float(np.pi) / 2 ** (small or 24)


def within(points: DataFrame, others: DataFrame, angle: float, by: str | None = None) -> DataFrame:
    """(idx, other, distance): each point (idx, x, y, z) with the others (idx, x, y, z) within the angle, of the same value of `by` if that is given. Points look into 27 cells of that size."""
    return facing(points, others, angle, by).select("idx", "other", "distance")


def facing(points: DataFrame, others: DataFrame, angle: float, by: str | None = None, carry: str | None = None) -> DataFrame:
    """within(), with both places (px, py, pz and x, y, z) and, if asked for, a column of either side (its name with p before it, and its name)."""
    size = max(chord(angle), 1e-9)
    group, more = [by] if by else [], [carry] if carry else []
    p = points.select("idx", *group, *(F.col(c).alias(f"p{c}") for c in ("x", "y", "z", *more)), _around(size)).select("idx", *group, *(f"p{c}" for c in ("x", "y", "z", *more)), "c.*")
    o = others.select(F.col("idx").alias("other"), *group, "x", "y", "z", *more, *_cell(size))
    j = p.join(o, [*group, "cx", "cy", "cz"])
    return j.withColumn("distance", S.angle(S.Vec(F.col("px"), F.col("py"), F.col("pz")), S.vec())).drop("cx", "cy", "cz").where(F.col("distance") <= angle)


def near_pairs(points: DataFrame, angle: float) -> DataFrame:
    """(a, b, distance): pairs a < b within the angle; pairs of which neither may move (movable) are left out where that is known."""
    p = within(points, points, angle).where("idx < other").select(F.col("idx").alias("a"), F.col("other").alias("b"), "distance")
    if "movable" not in points.columns:
        return p
    m = points.select("idx", "movable")
    return p.join(m.withColumnRenamed("idx", "a").withColumnRenamed("movable", "_ma"), "a").join(m.withColumnRenamed("idx", "b").withColumnRenamed("movable", "_mb"), "b").where("_ma OR _mb").select("a", "b", "distance")


def k_nearest(points: DataFrame, others: DataFrame, k: int, start: float | None = None, same: bool = False, by: str | None = None) -> DataFrame:
    """(idx, other, distance, rank): the k nearest others of each point (of the same value of `by`), ties to the lesser other.

    The first radius follows from how densely the others lie, so that a cell holds few; points without k within a radius try twice it.
    """
    left, out, radius = points, None, start or first_radius(others, 16 * k)
    while True:
        near = within(left, others, radius, by)
        if not same:
            near = near.where("idx != other")
        w = Window.partitionBy("idx")
        ranked = near.withColumns({"rank": F.row_number().over(w.orderBy("distance", "other")), "_n": F.count("*").over(w)})
        ranked = ranked.where("rank <= " + str(k))
        last = radius >= np.pi
        done = checkpointed((ranked if last else ranked.where(f"_n >= {k}")).select("idx", "other", "distance", "rank"))
        out = done if out is None else out.union(done)
        if last:
            return out
        left = checkpointed(left.join(done.select("idx").distinct(), "idx", "left_anti"))
        if left.isEmpty():
            return out
        radius = min(radius * 2, float(np.pi))


def nearest(points: DataFrame, grid: DataFrame, start: float | None = None) -> DataFrame:
    """(idx, cell, distance): the nearest grid point (idx, x, y, z) of each point, ties to the lesser."""
    return k_nearest(points, grid, 1, start, same=True).select("idx", F.col("other").alias("cell"), "distance")


def spacing(points: DataFrame, k: int = 4, start: float | None = None) -> DataFrame:
    """(idx, kth, characteristic, local): the k-th nearest angle; its median clamped to .035 to .7; the former within .5 to 2.2 times the latter."""
    kth = k_nearest(points, points, k, start).where(f"rank = {k}").select("idx", F.col("distance").alias("kth"))
    c = kth.agg(F.least(F.lit(0.7), F.greatest(F.lit(0.035), F.median("kth"))).alias("characteristic"))
    return kth.crossJoin(F.broadcast(c)).withColumn("local", F.least(2.2 * F.col("characteristic"), F.greatest(0.5 * F.col("characteristic"), "kth")))


def density(grid: DataFrame, points: DataFrame, spaced: DataFrame, by: str | None = None) -> DataFrame:
    """(cell[, by], density) of the grid points that anything reaches: two compact kernels of each point, .82 of the fine one and .18 of one twice
    as wide. A point's bandwidth is .82 of its local spacing, within .55 and 1.45 of the characteristic one; w weighs it."""
    c, low, high = F.col("characteristic"), F.lit(0.55), F.lit(1.45)
    band = F.least(high * c, F.greatest(low * c, 0.82 * F.col("local")))
    p = checkpointed(points.join(spaced.select("idx", "characteristic", "local"), "idx").withColumn("band", band))
    most = p.agg(F.max("band")).first()[0] or 0.0
    near = within(p, grid, min(2 * most, float(np.pi))).withColumnRenamed("other", "cell")
    j = near.join(p.select("idx", "band", "w", *([by] if by else [])), "idx")
    k = 0.82 * S.compact_kernel(F.col("distance"), F.col("band")) + 0.18 * S.compact_kernel(F.col("distance"), 2 * F.col("band"))
    return j.groupBy("cell", *([by] if by else [])).agg(F.sum(F.col("w") * k).alias("density")).where("density > 0")


def ascent_roots(values: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, root): where steepest ascent ends. A cell goes to its greatest neighbour if that is greater (ties to the lesser cell); pointers are doubled each round."""
    v = values.select("cell", "value")
    n = links.join(v.select(F.col("cell").alias("b"), F.col("value").alias("bv")), "b").groupBy(F.col("a").alias("cell")).agg(F.max(F.struct("bv", (-F.col("b")).alias("nb"))).alias("best"))
    up = v.join(n, "cell", "left").select("cell", F.when(F.col("best.bv") > F.col("value"), -F.col("best.nb")).otherwise(F.col("cell")).alias("root"))
    up = checkpointed(up)
    while True:
        nxt = checkpointed(up.alias("u").join(up.select(F.col("cell").alias("at"), F.col("root").alias("to")), F.col("u.root") == F.col("at")).select("u.cell", F.col("to").alias("root")))
        if up.exceptAll(nxt).isEmpty():
            return nxt
        up = nxt


def thin_cells(owners: DataFrame, links: DataFrame, most: int = 2) -> DataFrame:
    """(owner, cells, thin): owned cells by owner, and how many have at most `most` neighbours of the same owner."""
    a, b = owners.select(F.col("cell").alias("a"), F.col("owner").alias("oa")), owners.select(F.col("cell").alias("b"), F.col("owner").alias("ob"))
    same = links.join(a, "a").join(b, "b").where("oa = ob AND oa >= 0").groupBy(F.col("a").alias("cell")).agg(F.count("*").alias("n"))
    own = owners.where("owner >= 0").join(same, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return own.groupBy("owner").agg(F.count("*").alias("cells"), F.count_if(F.col("n") <= most).alias("thin"))


def sea_between(owners: DataFrame, links: DataFrame) -> DataFrame:
    """owners where each cell next to a cell of another owner becomes sea (-1), unless it is protected."""
    a, b = owners.select(F.col("cell").alias("a"), F.col("owner").alias("oa")), owners.select(F.col("cell").alias("b"), F.col("owner").alias("ob"))
    touch = links.join(a, "a").join(b, "b").where("oa >= 0 AND ob >= 0 AND oa != ob").select(F.col("a").alias("cell")).distinct().withColumn("_touch", F.lit(True))
    held = F.col("protected") if "protected" in owners.columns else F.lit(False)
    return owners.join(touch, "cell", "left").select("cell", F.when(F.coalesce("_touch", F.lit(False)) & ~held, -1).otherwise(F.col("owner")).alias("owner"))


def drop_unanchored(owners: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """owners where connected pieces of an owner without a member (cell, owner) become sea."""
    from meridian.operators.traversal import components

    a, b = owners.select(F.col("cell").alias("src"), F.col("owner").alias("oa")), owners.select(F.col("cell").alias("dst"), F.col("owner").alias("ob"))
    inner = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).join(a, "src").join(b, "dst").where("oa >= 0 AND oa = ob").select("src", "dst")
    piece = components(inner).withColumnRenamed("id", "cell")
    of = owners.join(piece, "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    kept = of.join(members.select("cell", "owner"), ["cell", "owner"], "left_semi").select("component").distinct().withColumn("_kept", F.lit(True))
    return of.join(kept, "component", "left").select("cell", F.when((F.col("owner") >= 0) & F.col("_kept").isNull(), -1).otherwise(F.col("owner")).alias("owner"))


def fill_enclosed(owners: DataFrame, links: DataFrame) -> DataFrame:
    """owners where all water but the largest connected piece (least cell first) goes to the owner it borders most (lesser owner first)."""
    from meridian.operators.traversal import components

    water = owners.where("owner < 0").select("cell")
    inner = links.join(water.withColumnRenamed("cell", "a"), "a").join(water.withColumnRenamed("cell", "b"), "b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    piece = water.join(components(inner).withColumnRenamed("id", "cell"), "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    ocean = piece.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    lake = checkpointed(piece.join(ocean, "component", "left_anti"))
    border = links.join(lake.select(F.col("cell").alias("a"), "component"), "a").join(owners.where("owner >= 0").select(F.col("cell").alias("b"), "owner"), "b")
    best = border.groupBy("component", "owner").agg(F.count("*").alias("n")).groupBy("component").agg(F.max(F.struct("n", (-F.col("owner")).alias("o"))).alias("best"))
    new = lake.join(best, "component").select("cell", (-F.col("best.o")).alias("_new"))
    return owners.join(new, "cell", "left").select("cell", F.coalesce("_new", "owner").cast("int").alias("owner"))


def dilation_frontier(owners: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, owner, n): water cells that touch exactly one owner, and by how many neighbours."""
    a, b = owners.where("owner < 0").select(F.col("cell").alias("a")), owners.where("owner >= 0").select(F.col("cell").alias("b"), "owner")
    g = links.join(a, "a").join(b, "b").groupBy(F.col("a").alias("cell")).agg(F.countDistinct("owner").alias("k"), F.min("owner").alias("owner"), F.count("*").alias("n"))
    return g.where("k = 1").select("cell", "owner", "n")


def icosphere(spark: SparkSession, s: int) -> tuple[DataFrame, DataFrame]:
    """(grid(idx, x, y, z), links(a, b)) of an icosahedron whose faces are halved s times (0 to 6): 10 * 4**s + 2 vertices, links both ways."""
    if not 0 <= s <= 6:
        raise ValueError("a subdivision is from 0 to 6")
    g = (1 + 5**0.5) / 2
    v = np.array([(x, y, 0) for x in (-1, 1) for y in (-g, g)] + [(0, x, y) for x in (-1, 1) for y in (-g, g)] + [(y, 0, x) for x in (-1, 1) for y in (-g, g)], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    d = v @ v.T
    near = d > 0.4
    np.fill_diagonal(near, False)
    faces = np.array([(i, j, k) for i in range(12) for j in range(i + 1, 12) if near[i, j] for k in range(j + 1, 12) if near[i, k] and near[j, k]])
    for _ in range(s):
        ends = np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [0, 2]]]), axis=1)
        pairs, at = np.unique(ends, axis=0, return_inverse=True)
        mid = v[pairs[:, 0]] + v[pairs[:, 1]]
        a, b, c = (len(v) + at.reshape(3, -1))
        v = np.concatenate((v, mid / np.linalg.norm(mid, axis=1)[:, None]))
        x, y, z = faces.T
        faces = np.concatenate([np.stack(t, 1) for t in ((x, a, c), (y, a, b), (z, b, c), (a, b, c))])
    ends = np.unique(np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [0, 2]]]), axis=1), axis=0)
    grid = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "idx int, x double, y double, z double")
    links = spark.createDataFrame([tuple(map(int, e)) for e in np.concatenate((ends, ends[:, ::-1]))], "a int, b int")
    return grid, links


def subdivision_for(spaced: float) -> int:
    """The least of 2 to 5 whose edges are no longer than max(.045, .55 spacing)."""
    edge = 1.1071487177940904
    return next((s for s in range(2, 5) if edge / 2**s <= max(0.045, 0.55 * spaced)), 5)
