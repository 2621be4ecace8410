"""Mixing overlapping sources to target weights: a min-cost flow over membership patterns, then seeded documents.

Documents are summed by membership pattern (the set of sources that a document belongs to) and size. Each pattern's
words may be taken once for nothing, a second time at cost 1, a third time at cost 2, and so on (convex costs of
repetition), by any of its sources, up to the sources' quotas. The flow says how many words of each pattern go to each
source; documents are then taken in the order of a seeded digest. The driver holds sums by pattern and source only;
their number is checked against max_patterns.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.shared import fresh, written

DIGIT = 3  #: hex digits of the digest that a histogram resolves: 4096 cells
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column) -> Column:
    """Runs of anything but space and \\t..\\r; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share total by weight; a share stops at most * size and its excess is shared again until none is above."""
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0]
    while open_:
        left = total - sum(out)
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > most * sizes[i]] if whole else open_
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(most * sizes[i])
        open_ = [i for i in open_ if i not in set(over)]
    return out


def min_cost_flow(capacity: dict[tuple, int], quota: dict, repeats: int) -> dict[tuple, dict]:
    """Words that each pattern (a tuple of sources) sends to each of its sources, at the least total cost of repetition.

    Successive shortest augmenting paths with potentials, on the graph start -> pattern (one arc for each repetition,
    of cost 0, 1, 2, ...) -> source -> end. Of several cheapest flows the order of the keys decides, so runs agree.
    """
    patterns, sources = sorted(capacity, key=repr), sorted(quota, key=repr)
    node = {("s",): 0} | {("p", p): 1 + i for i, p in enumerate(patterns)}
    node |= {("q", q): len(node) + i for i, q in enumerate(sources)}
    end = len(node)
    arcs: list[list] = []  # to, left, cost
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, most: int, cost: int) -> None:
        for x, y, m, c in ((a, b, most, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, m, c])

    first: dict[tuple, int] = {}
    for p in patterns:
        for r in range(repeats):
            arc(0, node["p", p], capacity[p], r)
        for q in p:
            if q in quota:
                first[p, q] = len(arcs)
                arc(node["p", p], node["q", q], repeats * capacity[p], 0)
    for q in sources:
        arc(node["q", q], end, quota[q], 0)
    height = [0] * (end + 1)
    while True:
        far, via, heap = {0: 0}, {}, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                b, left, cost = arcs[e]
                if left > 0 and (to := d + cost + height[a] - height[b]) < far.get(b, 1 << 60):
                    far[b], via[b] = to, e
                    heapq.heappush(heap, (to, b))
        if end not in far:
            break
        for a in range(end + 1):
            height[a] += far.get(a, far[end]) if far.get(a, far[end]) < far[end] else far[end]
        at, push = end, 1 << 62
        while at:
            push, at = min(push, arcs[via[at]][1]), arcs[via[at] ^ 1][0]
        at = end
        while at:
            arcs[via[at]][1] -= push
            arcs[via[at] ^ 1][1] += push
            at = arcs[via[at] ^ 1][0]
    flow: dict[tuple, dict] = {p: {} for p in patterns}
    for (p, q), e in first.items():
        if arcs[e ^ 1][1]:
            flow[p][q] = arcs[e ^ 1][1]
    return flow


def _edges(slim: DataFrame, plan: DataFrame) -> list[DataFrame]:
    """Where the words of a pattern, in the order of digests, reach its remainder: two runs of digits, then the last document.

    Found by radix: a histogram of the leading digits, then one of the next digits within the cell that holds the end,
    then a sum over the few documents left. Nothing is sorted whole. What the last document leaves open goes to a filler:
    of the documents after it the largest that fits. One row a pattern in each.
    """
    level = slim.join(F.broadcast(plan), "pattern").where("rest > 0").withColumn("before", F.lit(0).cast("long"))
    out = []
    for i in (0, 1):
        level = level.withColumn("cell", F.substring("digest", 1 + DIGIT * i, DIGIT))
        sums = level.groupBy("pattern", "cell").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max("before").alias("start"))
        w = Window.partitionBy("pattern").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(w), F.lit(0)))
        edge = sums.where("before < rest AND before + words >= rest").select("pattern", "cell", "before")
        out.append(edge.select("pattern", F.col("cell").alias(f"edge{i}")))
        level = level.drop("before").join(F.broadcast(edge), ["pattern", "cell"]).drop("cell")
    w = Window.partitionBy("pattern").orderBy("digest", "doc_key", "rid").rowsBetween(Window.unboundedPreceding, -1)
    sums = level.withColumn("upto", F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("upto") <= F.col("rest")
    last = sums.groupBy("pattern").agg(F.max(F.when(fits, F.struct("digest", "doc_key", "rid"))).alias("last"), (F.max("rest") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.max("before"))).alias("gap"))
    out.append(last)
    left = slim.where("size > 0")
    for e in (plan, *out):
        left = left.join(F.broadcast(e), "pattern")
    left = left.where("rest > 0 AND size <= gap").where(~_before_edge())
    out.append(left.groupBy("pattern").agg(F.max(F.struct("size", "digest", "doc_key", "rid")).alias("filler")))
    return out


def _before_edge() -> Column:
    at = F.concat("edge0", "edge1")
    return F.when(F.substring("digest", 1, 2 * DIGIT) < at, True).otherwise(F.coalesce(F.struct("digest", "doc_key", "rid") <= F.col("last"), F.lit(False)))


def _select(docs: DataFrame, plan: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """taken: whole repetitions for all, one more for the documents before the edge."""
    d = docs.join(F.broadcast(plan), "pattern", "left")
    for e in edges:
        d = d.join(F.broadcast(e), "pattern", "left")
    filler = F.coalesce(F.struct("digest", "doc_key", "rid") == F.struct("filler.digest", "filler.doc_key", "filler.rid"), F.lit(False))
    more = F.when(F.coalesce("rest", F.lit(0)) <= 0, False).otherwise(_before_edge() | filler)
    return d.withColumn("taken", F.col("size") * (F.coalesce("whole", F.lit(0)) + more.cast("long"))).drop("whole", "rest", "edge0", "edge1", "last", "gap", "filler")


def _mixed(docs: DataFrame, quota_of, sources: Column, key: str, text: str, keep: Sequence[str], repeats: int, seed: int, max_patterns: int) -> DataFrame:
    """(row, pattern, of, size, taken) for each row of docs: its size, its set of sources and how many words are taken; row is a struct of the columns to keep, so no name of theirs meets one of these."""
    spark = docs.sparkSession
    pattern = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    k = F.col(key).cast("string")
    like = F.lower(F.hex(F.xxhash64(*(F.col(c) if not t.startswith("map") else F.map_entries(c) for c, t in docs.dtypes))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(k, F.concat(F.lit(" "), like))).cast("binary"))
    names = F.to_json(F.struct(pattern.alias("p")), {"ignoreNullFields": "false"})
    d = docs.select(F.struct(*keep).alias("row"), n_words(text).alias("size"), names.alias("pattern"), pattern.alias("of"), F.concat(F.coalesce(k, F.lit("")), F.lit(" "), like).alias("doc_key"), digest.alias("digest"), F.monotonically_increasing_id().alias("rid"))
    d = written(d)  # rows keep their numbers
    found = d.groupBy("pattern", "of").agg(F.sum("size").alias("words")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns: merge rare sources first")
    named = {tuple(r["of"]): r["pattern"] for r in found}
    capacity = {tuple(r["of"]): r["words"] for r in found}
    of_source: dict = {}
    for p, n in capacity.items():
        for s in p:
            of_source[s] = of_source.get(s, 0) + n
    quota = quota_of(of_source)
    flow = min_cost_flow({p: n for p, n in capacity.items() if n > 0}, {s: round(q) for s, q in quota.items()}, repeats)
    rows = [(named[p], sum(f.values()) // capacity[p], sum(f.values()) % capacity[p]) for p, f in flow.items()]
    plan = spark.createDataFrame(rows, "pattern string, whole long, rest long")
    return _select(d, plan, _edges(d.select("pattern", "size", "doc_key", "digest", "rid"), plan)).select("row", "pattern", "of", "size", "taken")


def mix(docs: DataFrame, quota_of, sources: str = "sources", key: str = "doc_id", text: str = "text", repeats: int = 3, seed: int = 7, max_patterns: int = 100_000) -> DataFrame:
    """docs with size, pattern, and taken: the words that the mix takes of a document, a multiple of its size.

    sources is a column of arrays (null and empty: no source). quota_of gets {source: words} and returns
    {source: quota}. Documents are taken in the order of a seeded digest of their keys; without a key, of the whole row. Rows that
    repeat are documents of their own: as many of them are taken as fit. A document of size 0 is taken 0 times. Where docs
    has columns of the new names, these get an underscore.
    """
    mixed = _mixed(docs, quota_of, F.col(sources), key, text, docs.columns, repeats, seed, max_patterns)
    size, pattern, taken = fresh(docs, "size", "pattern", "taken")
    return mixed.select("row.*", F.col("size").alias(size), F.col("pattern").alias(pattern), F.col("taken").alias(taken))


def cycling_quotas(of_source: dict, most: int = 3) -> dict:
    """Sources by code point, null last, weigh 1, 2, 3, 1, ...; together they get all words; none gets over most times its own."""
    order = sorted(of_source, key=lambda s: (s is None, s or ""))
    return dict(zip(order, water_fill([of_source[s] for s in order], [1 + i % 3 for i in range(len(order))], sum(of_source.values()), most)))


def _one_source(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(row, size, source_size, target, taken) for documents of one source each."""
    held: dict = {}

    def quotas(of_source: dict) -> dict:
        held.update({s: (n, q) for (s, n), q in zip(of_source.items(), map(cycling_quotas(of_source).get, of_source))})
        return {s: q for s, (_, q) in held.items()}

    mixed = _mixed(docs, quotas, F.array(F.col("source").cast("string")), "doc_id", "text", keep, 3, 7, 100_000)
    facts = docs.sparkSession.createDataFrame([(s, n, float(q)) for s, (n, q) in held.items()], "s string, source_size long, target double")
    return mixed.join(F.broadcast(facts), F.get("of", F.lit(0)).eqNullSafe(F.col("s"))).select("row", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents and size, source_size, target, taken, for documents of one source each (null is a source).

    Where docs has columns of the new names, these get an underscore. Keys, repeats and texts as in mix(). An empty table gives no rows.
    """
    new = ("size", "source_size", "target", "taken")
    return _one_source(docs, docs.columns).select("row.*", *(F.col(c).alias(n) for c, n in zip(new, fresh(docs, *new))))


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return _one_source(docs, ["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


def sizes_sql(docs: str) -> str:
    """CTEs up to m: doc_id, source, size, source_size, target, taken of the table docs."""
    shares = "".join(
        f", f{i + 1} AS (SELECT s, n, w, CASE WHEN fixed IS NOT NULL THEN fixed WHEN lft * w / wt > 3 * n THEN 3.0 * n END AS fixed FROM (SELECT *, (SELECT sum(n) FROM f0) - coalesce(sum(fixed) OVER (), 0) AS lft, sum(CASE WHEN fixed IS NULL THEN w END) OVER () AS wt FROM f{i}))"
        for i in range(8)
    )
    return rf"""d AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM {docs}),
    f0 AS (SELECT s, n, w, CASE WHEN n = 0 THEN 0.0 END AS fixed FROM (SELECT source AS s, sum(size)::DOUBLE AS n, 1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source)){shares},
    t AS (SELECT s, n::BIGINT AS source_size, coalesce(fixed, ((SELECT sum(n) FROM f0) - coalesce(sum(fixed) OVER (), 0)) * w / sum(CASE WHEN fixed IS NULL THEN w END) OVER ()) AS target FROM f8),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN least(round(target)::BIGINT, 3 * source_size) // source_size ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN least(round(target)::BIGINT, 3 * source_size) % source_size ELSE 0 END AS rest FROM t),
    o AS (SELECT d.*, source_size, target, whole, rest, sum(size) OVER (PARTITION BY source ORDER BY digest, coalesce(doc_id::VARCHAR, '') ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.s),
    g AS (SELECT *, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM o),
    q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN rest > 0 AND upto > rest AND size > 0 AND size <= gap THEN size END DESC NULLS LAST, digest DESC, doc_id::VARCHAR DESC) = 1 AND rest > 0 AND upto > rest AND size > 0 AND size <= gap AS filler FROM g),
    m AS (SELECT *, size * (whole + CASE WHEN rest > 0 AND upto <= rest OR filler THEN 1 ELSE 0 END) AS taken FROM q)"""


OP2_SQL = f"WITH {sizes_sql('documents')} SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken FROM m"


def taken_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents: each document as often as the mix takes it; those of no words stay once, as they cost nothing."""
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(1)
    return _one_source(docs, docs.columns).select("row", F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))))).select("row.*")
