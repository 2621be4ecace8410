"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions only.

A paragraph is a line that is not empty; a document is the set of its paragraphs' 64-bit digests. A sketch has three rows of
cells; each digest is added to one cell of each row (count, xor of digests, xor of checks). Cell by cell, one version's
sketch is subtracted from another's, and cells that hold a single digest are peeled off until none is left: what comes off
are the digests that differ. If cells remain, both are sketched again, larger: the digests are dealt by hash to 3, 9, 36, 144, 576
sketches. Where the largest fails too, the digest sets are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.shared import written

WIDTH, ROWS, ROUNDS = 12, 3, 10
LEVELS = (1, 3, 9, 36, 144, 576)
IDS_A_TASK = 200_000


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column) -> Column:
    """The set of the digests of a text's paragraphs; null is the empty text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != "")
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


def _placed(d: Column, sign: int) -> Column:
    """A digest with its sign, its check, and its cell in each row (p0, p1, p2)."""
    at = [F.pmod(F.xxhash64(d, F.lit(j)), F.lit(WIDTH)).cast("int").alias(f"p{j}") for j in range(ROWS)]
    return F.struct(F.lit(sign).alias("s"), d.alias("k"), F.xxhash64(d, F.lit(99)).alias("c"), *at)


def _add(cells: Column, placed: Column) -> Column:
    """Cells after each of the placed digests is added by its sign, row by row."""

    def put(a, e):
        return F.struct((a["n"] + e["s"]).alias("n"), a["k"].bitwiseXOR(e["k"]).alias("k"), a["c"].bitwiseXOR(e["c"]).alias("c"))

    def row(j):
        return F.transform(F.slice(cells, j * WIDTH + 1, WIDTH), lambda x, i: F.aggregate(F.filter(placed, lambda e: e[f"p{j}"] == i), x, put))

    return F.concat(*(row(j) for j in range(ROWS)))


def _empty() -> Column:
    return F.array_repeat(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c")), WIDTH * ROWS)


def sketch(d: Column) -> Column:
    """array<struct<n, k, c>> of the cells."""
    return let(F.transform(d, lambda x: _placed(x, 1)), lambda placed: let(_empty(), lambda cells: _add(cells, placed)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column) -> Column:
    """struct<plus, minus>: the digests in the first sketch only and in the second only; null if cells remain."""
    none = F.array().cast("array<bigint>")

    def single(x, sign):
        return (x["n"] == sign) & (x["c"] == F.xxhash64(x["k"], F.lit(99)))

    def one_round(s, _):
        def body(found):
            placed = F.concat(F.transform(found["p"], lambda d: _placed(d, -1)), F.transform(found["m"], lambda d: _placed(d, 1)))
            return let(placed, lambda e: F.struct(_add(s["cells"], e).alias("cells"), F.concat(s["plus"], found["p"]).alias("plus"), F.concat(s["minus"], found["m"]).alias("minus")))

        pure = [F.array_distinct(F.transform(F.filter(s["cells"], lambda x: single(x, sign)), lambda x: x["k"])) for sign in (1, -1)]
        return let(F.struct(pure[0].alias("p"), pure[1].alias("m")), lambda found: F.when(F.size(found["p"]) + F.size(found["m"]) == 0, s).otherwise(body(found)))

    start = F.struct(cells.alias("cells"), none.alias("plus"), none.alias("minus"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)
    return let(end, lambda s: F.when(F.forall(s["cells"], lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)), F.struct(s["plus"].alias("plus"), s["minus"].alias("minus"))))


def differences(pairs: DataFrame) -> DataFrame:
    """(pair, plus, minus) of pairs(pair, a, b): how many digests of a are not in b, and of b not in a. Pairs must be distinct.

    Each pair is sketched and peeled; those that fail are dealt by hash to more sketches, which are rows of their own, and
    so on. What the largest leaves over is compared exactly.
    """
    todo, out = pairs, None
    for parts in LEVELS:
        j = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j")
        dealt = todo.select("pair", "a", "b", j)
        if parts > 1:
            dealt = dealt.withColumns({c: F.filter(c, lambda x: F.pmod(F.xxhash64(x, F.lit(7)), F.lit(parts)) == F.col("j")) for c in ("a", "b")})
        peeled = dealt.select("pair", "a", "b", sketch(F.col("a")).alias("sa"), sketch(F.col("b")).alias("sb")).select("pair", peel(subtract(F.col("sa"), F.col("sb"))).alias("p"))
        sums = written(peeled.groupBy("pair").agg(F.every(F.col("p").isNotNull()).alias("ok"), F.sum(F.size("p.plus")).alias("plus"), F.sum(F.size("p.minus")).alias("minus")))
        done = sums.where("ok").select("pair", "plus", "minus")
        out = done if out is None else out.union(done)
        failed = sums.where("NOT ok").select("pair")
        if failed.isEmpty():
            return out
        todo = written(todo.join(failed, "pair", "left_semi"))
    return out.union(todo.select("pair", F.size(F.array_except("a", "b")).cast("long"), F.size(F.array_except("b", "a")).cast("long")))


def likeness(n_a: Column, n_b: Column, plus: Column) -> Column:
    """Paragraphs in both, as a share of those in either, from the sizes and how many of a are not in b; 1 if neither has any."""
    either = n_b + plus
    return F.when(either == 0, 1.0).otherwise((n_a - plus) / either)


def named(cells: Column) -> Column:
    """The sketch as 32 hex digits."""
    return F.md5(F.array_join(F.transform(cells, lambda x: F.concat_ws(",", x["n"], F.hex(x["k"]), F.hex(x["c"]))), ";").cast("binary"))


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(rk, n, prev_rk, prev_n) of each distinct row, rk being xxhash64(key, text): the row before, by key then rk; before the first, the last.

    Keys are range-partitioned and numbered by partition; rows meet their neighbours in a window over each partition,
    and the partitions' ends in a table of one row a partition.
    """
    spark = docs.sparkSession
    keys = written(docs.select(F.xxhash64(key, text).alias("rk"), F.col(key).alias("k"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n")).distinct())
    parts = max(1, -(-keys.count() // IDS_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    ranged = written(keys.repartitionByRange(parts, "k", "rk").withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part").orderBy("k", "rk")
    row = F.struct("rk", "n")
    ends = ranged.groupBy("part").agg(F.max(F.struct("k", "rk", "n")).alias("end"))
    by = Window.orderBy("part")
    before = F.coalesce(F.lag("end").over(by), F.last("end").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = ends.select("part", F.struct(before["rk"].alias("rk"), before["n"].alias("n")).alias("outside"))
    out = ranged.withColumn("inside", F.lag(row).over(here)).join(F.broadcast(ends), "part").withColumn("prev", F.coalesce("inside", "outside"))
    return written(out.select("rk", "n", F.col("prev.rk").alias("prev_rk"), F.col("prev.n").alias("prev_n")))


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rk, key, text, n_chars, next_key, next_digests, edited: the text with its last floor(n/2) code points replaced by the next row's first ones.

    The next row is that of the next greater key; equal keys go by a hash of the row, and rows equal in key and text count
    as one. After the last comes the first; a single document is its own next one. Null is the empty text.
    """
    order = in_order(docs, key, text)
    rows = docs.select(F.xxhash64(key, text).alias("rk"), F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    own = rows.join(order.select("rk", "n"), "rk")
    heads = rows.join(order.select("rk", "prev_rk", "prev_n"), "rk").select(F.col("prev_rk").alias("to"), F.col("k").alias("next_key"), F.left("t", F.expr("cast(prev_n div 2 as int)")).alias("head"), digests(F.col("t")).alias("next_digests"))
    if docs.count() > order.count():
        heads = heads.dropDuplicates(["to"])
    edited = F.concat(F.left("t", F.expr("cast(n - n div 2 as int)")), F.col("head"))
    return own.join(heads, F.col("rk") == F.col("to")).select("rk", F.col("k").alias(key), F.col("t").alias(text), F.col("n").cast("long").alias("n_chars"), "next_key", "next_digests", edited.alias("edited"))


def compare(rows: DataFrame, *keep: Column | str, text: str = "text") -> DataFrame:
    """The columns `keep` of rows of with_edits, and fingerprint, edited_fingerprint, near_edited, near_next.

    Digests and fingerprints are written to the shared folder; the text is read once.
    """
    d = rows.select("rk", *keep, digests(F.col(text)).alias("a"), digests(F.col("edited")).alias("b"), F.col("next_digests").alias("c"))
    names = d.columns[1:-3]
    d = written(d.select("rk", *names, "a", "b", "c", named(sketch(F.col("a"))).alias("fingerprint"), named(sketch(F.col("b"))).alias("edited_fingerprint")))
    one = d.dropDuplicates(["rk"])  # rows that repeat are compared once
    pair = F.struct("rk", F.lit("b").alias("with"))
    both = one.select(pair.alias("pair"), "a", "b").union(one.select(F.struct("rk", F.lit("c").alias("with")), "a", "c"))
    found = differences(both).select("pair.rk", "pair.with", "plus")
    found = found.groupBy("rk").agg(F.max(F.when(F.col("with") == "b", F.col("plus"))).alias("plus_b"), F.max(F.when(F.col("with") == "c", F.col("plus"))).alias("plus_c"))
    j = d.join(found, "rk")
    return j.select(*names, "fingerprint", "edited_fingerprint", likeness(F.size("a"), F.size("b"), F.col("plus_b")).alias("near_edited"), likeness(F.size("a"), F.size("c"), F.col("plus_c")).alias("near_next"))


def op9_ibl_sketch(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    out = compare(with_edits(docs), "doc_id", "n_chars", digest, F.col("next_key").alias("next_doc_id"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_doc_id")
