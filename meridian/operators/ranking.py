"""Visibility, ranking, search, percentiles and apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import paths as P


def orphan() -> Column:
    return F.coalesce("is_orphan", F.col("degree") == 0)


def visible(nodes: DataFrame, orphans: bool = True, notes: bool = True, attachments: bool = True, unresolved: bool = True) -> DataFrame:
    """Nodes that the filters let through: the orphan toggle first, then that of the kind."""
    kinds = [k for k, on in (("note", notes), ("attachment", attachments), ("unresolved", unresolved)) if on]
    return nodes.where((F.lit(orphans) | ~orphan()) & F.col("kind").isin(kinds))


def top_labels(nodes: DataFrame, offers: DataFrame, budget: int) -> DataFrame:
    """(id, priority, rank): ids in the order of their best offer (lesser first), then degree, then id; the first `budget`. Others are offered last."""
    best = offers.groupBy("id").agg(F.min("priority").alias("priority"))
    ranked = nodes.join(best, "id", "left").withColumn("priority", F.coalesce("priority", F.lit(7)))
    return ranked.orderBy("priority", F.desc("degree"), "id").limit(budget).select("id", "priority", "degree")


def top_tags(tags: DataFrame, linked: DataFrame, most: int = 96) -> DataFrame:
    """Tags that linked nodes bear first, then by number of nodes, then by label; the first `most`."""
    hit = tags.select("tag", F.explode("ids").alias("id")).join(linked.select("id"), "id", "left_semi").groupBy("tag").agg(F.lit(True).alias("linked"))
    return tags.join(hit, "tag", "left").orderBy(F.desc(F.coalesce("linked", F.lit(False))), F.desc("n"), "label").limit(most).select("tag", "n", F.coalesce("linked", F.lit(False)).alias("linked"))


def fuzzy_score(name: Column, query: str) -> Column:
    """How well the lower-case query fits a name: 1000 equal, 800 less extra length for a prefix, 600 less twice the place and a tenth of the
    extra length inside, else for a subsequence 300 + 10 a neighbouring letter - 3 a skipped one - the first place; -1 if it does not fit."""
    n, q = F.lower(P.trimmed(name)), query
    extra = (F.length(n) - len(q)).cast("double")
    at = F.instr(n, q)
    steps = F.array(*(F.lit(c) for c in q))
    # state: place after the last match (0: none yet), first match, neighbouring letters, skipped letters; place -1 once it fails

    def step(s, c):
        found = F.position(c, n, s["at"] + 1)
        return F.when((s["at"] < 0) | (found == 0), F.struct(F.lit(-1).alias("at"), s["first"].alias("first"), s["near"].alias("near"), s["gaps"].alias("gaps"))).otherwise(
            F.struct(found.alias("at"), F.when(s["at"] == 0, found - 1).otherwise(s["first"]).alias("first"), (s["near"] + ((s["at"] > 0) & (found == s["at"] + 1)).cast("int")).alias("near"), (s["gaps"] + F.when(s["at"] > 0, found - s["at"] - 1).otherwise(0)).alias("gaps"))
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("near"), F.lit(0).alias("gaps"))
    walked = F.aggregate(steps, start, step, lambda s: F.when(s["at"] < 0, -1.0).otherwise((300 + 10 * s["near"] - 3 * s["gaps"] - s["first"]).cast("double")))
    return F.when(n == q, 1000.0).when(at == 1, 800 - extra).when(at > 1, 600 - 2.0 * (at - 1) - 0.1 * extra).otherwise(walked)


def search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, score): ids by the better of their name's score plus 30 and their path's, then by degree, then by id. A blank query finds nothing."""
    q = query.strip().lower()
    if not q:
        return nodes.limit(0).select("id", F.lit(0.0).alias("score"))
    name, path = fuzzy_score(F.col("basename"), q), fuzzy_score(F.col("id"), q)
    score = F.greatest(F.when(name >= 0, name + 30).otherwise(-1.0), path)
    return nodes.withColumn("score", score).where("score >= 0").orderBy(F.desc("score"), F.desc("degree"), "id").limit(limit).select("id", "score")


def mid_rank(value: str, group: str, eligible: Column) -> Column:
    """The mean rank of a value among the eligible ones of its group, from 0 to 1. A single value, or values all equal: 1 or .5 if positive, else 0; not eligible: 0."""
    g = Window.partitionBy(group, eligible)
    n, same = F.count("*").over(g), F.count("*").over(Window.partitionBy(group, eligible, value))
    rank = F.rank().over(g.orderBy(value))
    mid = (2 * (rank - 1) + same - 1) / (2 * (n - 1))
    return F.when(~eligible, 0.0).when(n == 1, (F.col(value) > 0).cast("double")).when(same == n, F.when(F.col(value) > 0, 0.5).otherwise(0.0)).otherwise(mid)


def gate(x: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high, t^2 (3 - 2t) between; a step where they are equal."""
    if high <= low:
        return (x >= high).cast("double")
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))
    return t * t * (3 - 2 * t)


def apportion(sizes: DataFrame, total: int, least: int, power: float = 0.88) -> DataFrame:
    """(owner, n, target): `least` each, and the rest of `total` by max(1, n)**power; floors first, then the largest fractions, lesser owner first."""
    whole = sizes.agg(F.sum(F.pow(F.greatest(F.lit(1.0), F.col("n").cast("double")), F.lit(power))).alias("whole"), F.count("*").alias("k"))
    s = sizes.crossJoin(F.broadcast(whole)).withColumn("share", (F.lit(total) - least * F.col("k")) * F.pow(F.greatest(F.lit(1.0), F.col("n").cast("double")), F.lit(power)) / F.col("whole"))
    s = s.withColumns({"low": F.floor("share"), "frac": F.round(F.col("share") - F.floor("share"), 9)})
    left = s.agg((F.max(F.lit(total) - least * F.col("k")) - F.sum("low")).alias("left"))
    ranked = s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("frac"), "owner"))).crossJoin(F.broadcast(left))
    return ranked.select("owner", "n", (F.lit(least) + F.col("low") + (F.col("place") <= F.col("left")).cast("int")).cast("long").alias("target"))


def top_two(df: DataFrame, key: str, value: str, owner: str) -> DataFrame:
    """(key, best, best_value, second_value): the greatest value of each key (lesser owner first) and the next one (0 if none)."""
    w = Window.partitionBy(key).orderBy(F.desc(value), owner)
    r = df.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    return r.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col(owner))).alias("best"), F.max(F.when(F.col("_r") == 1, F.col(value))).alias("best_value"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col(value))), F.lit(0.0)).alias("second_value"))
