"""MinHash near-dedup with tensored banding: the key of a table joins two of a few collections of least hashes.

Sets of shingles have COLLECTIONS values, each made of WIDTH least hashes. There is a table for every pair of collections, so
COLLECTIONS * (COLLECTIONS - 1) / 2 tables with keys of 2 * WIDTH least hashes need COLLECTIONS * WIDTH hashes, not as many
for each table. Two sets meet where two of their collections agree: at similarity 0.85 and with 10 collections of two,
all but 7 in 100,000 pairs do (one pair; copies in a group are linked over many).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.components import components
from meridian.llm.shared import fresh, put_set, skew_join, slices, small_batches, written
from meridian.llm.simhash_dedup import _blocks, _similar, _texts_of
from meridian.llm.words import U, encoded, mix

COLLECTIONS, WIDTH = 10, 2


def _measured(width: int, many: int, wide: int):
    """Streams (k, t); yields (k, sig, size, u): hash of the shingle set, its size, and the hashes of its collections."""
    salts = mix(np.arange(1, many * wide + 1, dtype=U) * U(0xD1342543DE82EF95))

    def run(batches):
        for batch in slices(batches):
            texts = encoded(batch.column(1))
            sig, size, u = np.zeros(len(texts), U), np.zeros(len(texts), np.int64), np.zeros((len(texts), many), U)
            for at, s, n in _blocks(texts, width):
                part, some = slice(at, at + len(n)), np.flatnonzero(n) + at
                size[part] = n
                if len(s):
                    start = (np.cumsum(n) - n)[n > 0]
                    sig[some] = mix(np.add.reduceat(mix(s), start) + n[n > 0].astype(U))
                    for c in range(many):
                        name = np.full(len(some), U(c))
                        for x in salts[c * wide : (c + 1) * wide]:
                            name = mix(name + np.minimum.reduceat(mix(s ^ x), start))
                        u[some, c] = name
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * many, pa.int32()), pa.array(u.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig.view(np.int64)), pa.array(size), lists], names=["k", "sig", "size", "u"])

    return run


def _compatible(x: str, y: str, similar: float) -> str:
    return f"LEAST({x}, {y}) >= {similar} * GREATEST({x}, {y}) - 1e-9"


def _with_pivots(shards: DataFrame, similar: float) -> DataFrame:
    """(a, b): each set of shards(s, sig, size, copies, m) with the pivot of each of its tables' rows.

    That is the one whose keys are the most common, as those of the text that others were made from are; of several the one of most copies.
    """
    known = skew_join(shards, shards.groupBy("sig").agg(F.sum("m").alias("common")), "sig")
    known = written(known.select("s", "sig", "size", "common", "copies"))
    pivot = known.groupBy("s").agg(F.max(F.struct("common", "copies", "sig", "size")).alias("p"), F.count("*").alias("n")).select("s", "n", F.col("p.sig").alias("pivot"), F.col("p.size").alias("pivot_size"))
    met = skew_join(known, pivot.drop("n"), "s", pivot.select("s", "n")).where("sig != pivot").where(_compatible("size", "pivot_size", similar))
    return met.select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b"))


def _tokens(width: int):
    """Streams (sig, t); yields (sig, token) for each distinct shingle."""

    def run(batches):
        for batch in slices(batches, 64):
            sig = batch.column(0).to_numpy(zero_copy_only=False)
            for at, s, n in _blocks(encoded(batch.column(1)), width):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sig[at : at + len(n)], n)), pa.array(s.view(np.int64))], names=["sig", "token"])

    return run


def _apart(shards: DataFrame, nodes: DataFrame, forms: DataFrame, at: DataFrame, similar: float, width: int) -> DataFrame:
    """(a, b): pairs that meet in a table, lie in different components (at: id, component), and may be similar.

    Where all of a table's row is one component, nothing is left to do. Of the other sets, two that are similar have a shingle in
    common among the rarest of either: as many as may be missing from the other, and one; and from the first such on, both must have as
    many as the similarity takes. That leaves out no similar pair, and copies that were each edited on their own share none of those. Of a shingle's sets, those outside its largest component
    look at all others.
    """
    of = at.select(F.col("id").alias("sig"), F.col("component").alias("c"))
    placed = written(shards.select("s", "sig").join(of, "sig", "left").select("s", "sig", F.coalesce("c", "sig").alias("c")))
    open_ = placed.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("s")
    v = written(placed.join(open_, "s").select("sig", "c").distinct())
    tokens = written(forms.join(v.select("sig"), "sig").select("sig", "t").mapInArrow(_tokens(width), "sig long, token long"))
    df = tokens.groupBy("token").agg(F.count("*").alias("n"))
    ranked = skew_join(tokens, df.where("n > 1"), "token", df).groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("x"))
    # shingles of one set only come first, and need no place in the list
    sized = ranked.join(nodes.select("sig", "size", "u"), "sig").withColumn("alone", F.col("size") - F.size("x"))
    most = F.col("size") - F.ceil(F.col("size") * similar - 1e-9) + 1 - F.col("alone")
    rare = sized.where(most > 0).join(v, "sig").select("sig", "c", "size", "u", "alone", F.posexplode(F.slice("x", F.lit(1), most.cast("int"))).alias("p", "x"))
    # left: the shingles from this one on, the most that a pair can have in common whose first common one this is
    rare = written(rare.select("sig", "c", "size", "u", (F.col("size") - F.col("alone") - F.col("p")).alias("left"), F.col("x.token").alias("token")))
    main = rare.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("kinds"), F.sum("k").alias("n")).where("kinds > 1")
    known = written(skew_join(rare, main.select("token", "main"), "token", main.select("token", "n")))
    few = known.where("c != main").select("token", "main", F.col("sig").alias("x"), F.col("c").alias("cx"), F.col("size").alias("nx"), F.col("left").alias("lx"), F.col("u").alias("ux"))
    every = known.select("token", F.col("sig").alias("y"), F.col("c").alias("cy"), F.col("size").alias("ny"), F.col("left").alias("ly"), F.col("u").alias("uy"))
    enough = f"LEAST(lx, ly) >= {similar} / (1 + {similar}) * (nx + ny) - 1e-9"
    met = few.join(every, "token").where(f"cx != cy AND (cy = main OR x < y) AND {enough}").where(_compatible("nx", "ny", similar))
    tabled = F.size(F.filter(F.zip_with("ux", "uy", lambda p, q: p == q), lambda e: e)) >= 2  # two collections agree, so a table has both under one key
    return met.where(tabled).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similar: float = 0.85, many: int = COLLECTIONS, wide: int = WIDTH) -> DataFrame:
    """(key, n_shingles long, component_id, kept boolean) for each row.

    A text's set has its distinct shingles of `width` words (runs of other than space and \\t..\\r, A-Z as a-z), or all words
    as one where there are fewer. Texts are linked where the sets' intersection is at least `similar` of their union;
    component_id is the least key that links lead to, kept says whether it is the row's own. Null and wordless texts have
    empty sets and link with nothing. Equal sets are one node, whatever their number. A null key is least only among null keys, and is
    then kept. Rows of one key get a row each. An empty table gives no rows.

    Candidates have equal keys in a table and sizes that allow the similarity. Each set is compared with its tables' pivots first; pairs
    of what is not connected then go through a filter that leaves out no similar pair. All are decided on the full sets of
    the whole texts.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = written(texts.mapInArrow(_measured(width, many, wide), f"k {texts.schema['k'].dataType.simpleString()}, sig long, size long, u array<long>"))
    nodes = written(found.where("size > 0").groupBy("sig").agg(F.min("k").alias("least"), F.count("*").alias("n"), F.min("size").alias("size"), F.first("u").alias("u")))
    tables = F.array(*(F.xxhash64(F.lit(many * i + j), F.get("u", F.lit(i)), F.get("u", F.lit(j))) for i, j in combinations(range(many), 2)))
    tabled = nodes.select(F.explode(tables).alias("s"), "sig", "size", F.col("n").alias("copies"))
    met = tabled.groupBy("s").agg(F.count("*").alias("m")).where("m > 1")
    shards = written(tabled.join(met, "s"))
    some = put_set(shards.select("sig").distinct(), "sig", 1 + nodes.count() // 2_000_000)
    forms = written(texts.select("t").mapInArrow(_texts_of(some, width), "sig long, t string").dropDuplicates(["sig"]))

    def decided(pairs: DataFrame) -> DataFrame:
        one, other = (forms.select(F.col("sig").alias(x), F.col("t").alias(f"t{x}")) for x in "ab")
        return written(skew_join(written(pairs.distinct()).join(other, "b"), one, "a").select("a", "b", "ta", "tb").mapInArrow(_similar(similar, width), "a long, b long"))

    first = decided(_with_pivots(shards, similar))
    at = written(components(first))
    more = decided(_apart(shards, nodes, forms, at, similar, width))
    joined = components(first.union(more))
    of = written(nodes.select("sig", "least", "n").join(joined.select(F.col("id").alias("sig"), "component"), "sig", "left").select("sig", "least", "n", F.coalesce("component", "sig").alias("c")))
    named = written(skew_join(of, of.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("sig", "n", "component_id"))
    sized, lone = found.where("size > 0").select("k", "sig", "size"), found.where("size = 0").select("k", "size", F.col("k").alias("component_id"))
    out = skew_join(sized, named.select("sig", "component_id"), "sig", named.select("sig", "n")).select("k", "size", "component_id").unionByName(lone)
    a, b, c = fresh(docs.select(key), "n_shingles", "component_id", "kept")
    return out.select(F.col("k").alias(key), F.col("size").alias(a), F.col("component_id").alias(b), F.col("k").eqNullSafe(F.col("component_id")).alias(c))


def op12_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by Jaccard similarity 0.85 of 5-word shingle sets; the one with the least doc_id is kept."""
    return near_sets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP12_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS meet FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * meet >= 85 * (na.n + nb.n - meet)),
arcs AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM arcs UNION SELECT r.a, e.b FROM reach r JOIN arcs e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.least, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
