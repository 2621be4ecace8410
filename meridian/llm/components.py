"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.shared import skew_join, written


def _stars(links: DataFrame, both_ways: bool) -> DataFrame:
    """Tie the neighbours of each node to the least of them: the greater neighbours (large star), or the lesser ones and the node itself (small star)."""
    if both_ways:
        around = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = around.join(least, "a")
    if both_ways:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the ends of the links (a, b): component is the least id that is reachable.

    Each round is written to the shared folder. Links of a node to itself and repeated links change nothing.
    """
    now, seen = written(links.select("a", "b").where("a != b").distinct()), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen, now = state, written(_stars(written(_stars(now, True)), False))
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _tree_pairs(radius: int):
    """Streams rows (s, part, query, sig, size, fp) sorted with the rows of a shard's part before its queries; yields pairs (x, y) within the radius.

    The part's rows make a BK-tree, in which each query is looked up.
    """

    def run(batches):
        import pyarrow as pa

        from meridian.llm.hamming import BKTree

        at, tree, ids, out = None, BKTree(), [], []
        for batch in batches:
            for s, part, query, sig, fp in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (s, part) != at:
                    at, tree, ids = (s, part), BKTree(), []
                fp &= (1 << 64) - 1
                if query:
                    out += [(sig, ids[j]) for j in tree.near(fp, radius) if ids[j] != sig]
                else:
                    tree.add(fp)
                    ids.append(sig)
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["x", "y"])
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["x", "y"])

    return run


BLOCK = 256  #: about so many rows of a shard are compared beside each other in a task
SHOWN = 16  #: about so many rows of a large shard are compared with what is outside its largest component before all others are


def linked_in_shards(shards: DataFrame, decided, similar: float, radius: int | str, limit: int, tree: bool = False, bits: str = "bit_count(fx ^ fy)", known: DataFrame | None = None, beside=None) -> DataFrame:
    """Links (a, b), enough to connect all pairs of a shard that decided(pairs) lets through. shards: distinct (s, sig, size, fp),
    or distinct (s, n, least, sig), with the rows and the least sig of each shard, and known: (sig, size, fp), a row each.
    A pair is only proposed where the lesser size is at least `similar` of the greater, and fingerprints fp differ in at most `radius` bits (a number, or SQL over the sizes nx, ny);
    `bits` is SQL for how many bits differ, where fp is not one number. Pairs are given to `decided` as a written table.

    First each row is compared with its shard's least. Then what is not connected yet: the rows outside a shard's largest
    component with all rows of other components, in parts of about `limit` rows (with `tree`, a BK-tree a part); without
    `tree`, with about SHOWN rows first and then, of what that did not connect, with the rest, a pair in the first shard that
    it shares. So a large shard of copies costs a pair a row, and no pair is left out that could connect anything.
    beside(rows) may give the links of the last step instead, from (s, part, query, sig, size, fp, d, inner, ss): in each part of a
    shard all rows that are no query, and as queries the rows that each of them has to be compared with, if their d differ, the
    query is less or the other `inner`, and the shard is the first in the ss of both. So rows, not pairs, go through joins.
    """
    near = f"LEAST(nx, ny) >= {similar} * GREATEST(nx, ny) - 1e-9 AND {bits} <= {radius}"
    if known is None:
        shards = written(shards.select("s", "sig", "size", "fp"))
        known = written(shards.select("sig", "size", "fp").dropDuplicates(["sig"]))
        least = shards.groupBy("s").agg(F.count("*").alias("n"), F.min("sig").alias("least")).where("n > 1")
        shards = written(skew_join(shards.select("s", "sig"), least, "s", least.select("s", "n")))
    one = known.select(F.col("sig").alias("b"), F.col("size").alias("nx"), F.col("fp").alias("fx"))
    other = known.select(F.col("sig").alias("a"), F.col("size").alias("ny"), F.col("fp").alias("fy"))
    begun = written(shards.where("sig != least").select(F.col("least").alias("a"), F.col("sig").alias("b")).distinct())
    first = written(decided(written(skew_join(begun, other, "a").join(one, "b").where(near).select("a", "b"))))
    of = components(first)
    at = written(shards.join(of, shards["sig"] == of["id"], "left").select("s", "least", "sig", F.coalesce("component", "sig").alias("c")))
    main = at.groupBy("s", "c").count().groupBy("s").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("kinds"), F.sum("count").alias("n")).where("kinds > 1")
    parts = F.ceil(F.col("n") / limit).cast("int")
    main = written(main)
    apart = written(skew_join(at.where("sig != least").select("s", "sig", "c"), main, "s", main.select("s", "n")).join(known.withColumnsRenamed({"size": "nx", "fp": "fx"}), "sig"))
    part, all_parts = F.pmod(F.xxhash64("sig"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
    outside = (F.col("sig").alias("x"), "nx", "fx", F.col("c").alias("cx"))
    inside = (F.col("sig").alias("y"), F.col("nx").alias("ny"), F.col("fx").alias("fy"), F.col("c").alias("cy"))
    pair = (F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    joined = of.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    if tree:
        few, every = apart.where("c != main").select("s", all_parts, *outside), apart.select("s", part, *inside)
        both = every.select("s", "part", F.lit(0).alias("query"), F.col("y").alias("sig"), F.col("fy").alias("fp")).union(few.select("s", "part", F.lit(1), "x", "fx"))
        found = both.repartition("s", "part").sortWithinPartitions("s", "part", "query").mapInArrow(_tree_pairs(radius), "x long, y long").distinct()
        size = apart.select("sig", "nx", "c").distinct()
        found = found.join(size.withColumnsRenamed({"sig": "x", "c": "cx"}), "x").join(size.withColumnsRenamed({"sig": "y", "nx": "ny", "c": "cy"}), "y")
        cross = found.where(f"cx != cy AND LEAST(nx, ny) >= {similar} * GREATEST(nx, ny) - 1e-9").select(*pair).distinct()
        cross = written(cross)
        return joined if cross.isEmpty() else joined.union(written(decided(cross)))
    shown = F.pmod(F.xxhash64(F.lit(SHOWN), "sig"), F.ceil(F.col("n") / SHOWN)) == 0
    if beside:  # blocks of smaller shards compare no more, as what a block connects is not compared again in it
        shown = shown & (F.col("n") > SHOWN * BLOCK)
    met = apart.where("c != main").select("s", part, "main", *outside).join(apart.where(shown).select("s", all_parts, *inside), ["s", "part"])
    met = written(met.where(f"cx != cy AND (cy = main OR x < y) AND {near}").select(*pair).distinct())
    every, now = joined, of
    if not met.isEmpty():
        every = joined.union(written(decided(met)))
        now = components(every)
    # where each row is: its component by now, and its shards, so that a pair is proposed in the first it shares
    where = apart.groupBy("sig").agg(F.array_sort(F.collect_list("s")).alias("ss")).join(now.select(F.col("id").alias("sig"), "component"), "sig", "left").select("sig", "ss", F.coalesce("component", "sig").alias("d"))
    rest = written((apart if beside else apart.where(f"n > {SHOWN}")).join(where, "sig"))
    if beside:
        block = F.ceil(F.col("n") / BLOCK).cast("int")
        row = ("sig", F.col("nx").alias("size"), F.col("fx").alias("fp"), "d", (F.col("c") == F.col("main")).alias("inner"), "ss")
        rows = rest.where(~shown).select("s", F.pmod(F.xxhash64("sig"), block).cast("int").alias("part"), F.lit(0).alias("query"), *row)
        return every.union(written(beside(rows.union(rest.where("c != main").select("s", F.explode(F.sequence(F.lit(0), block - 1)).alias("part"), F.lit(1), *row)))))
    few = rest.where("c != main").select("s", all_parts, "main", F.col("d").alias("dx"), F.col("ss").alias("sx"), *outside)
    cross = few.join(rest.where(~shown).select("s", part, F.col("d").alias("dy"), F.col("ss").alias("sy"), *inside), ["s", "part"])
    cross = written(cross.where(f"cx != cy AND (cy = main OR x < y) AND dx != dy AND {near} AND s = array_min(array_intersect(sx, sy))").select(*pair).distinct())
    return every if cross.isEmpty() else every.union(written(decided(cross)))
