"""SimHash near-dedup: fingerprints of word shingles, linked through BK-trees in pigeonhole shards.

The shard trees are not broadcast: all trees together grow with the corpus. They are dealt by shuffle, and a
fingerprint is sent to the shards that can hold its neighbours (see hamming.py); the tree search is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.components import components, linked_in_shards
from meridian.llm.hamming import links
from meridian.llm.shared import fresh, in_set, put_set, skew_join, slices, small_batches, written
from meridian.llm.words import U, docs_hashes, encoded, lane_votes, majority, mix

SEED = 42


def simhash(text: bytes, width: int) -> int:
    """The signed 64-bit fingerprint of the text's shingles of `width` words, repeats included; 0 without words.

    Words are runs of other than space and \\t..\\r, A-Z as a-z; fewer than `width` make one shingle. A bit is 1 if it
    is set in over half of the shingles' XXH64 (seed 42).
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= width:
        h = np.array([digest(join(words), SEED)], np.uint64)
    else:
        h = np.fromiter((digest(join(x), SEED) for x in zip(*(words[i:] for i in range(width)))), np.uint64, len(words) - width + 1)
    ones, n = lane_votes(h, np.zeros(len(h), np.int64), 1)
    return int(majority(ones, n).view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, fp) for each row; null is the empty text."""
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches):
        for batch in slices(batches):
            fp = [simhash(x or b"", width) for x in batch.column(1).cast("binary").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["k", "fp"])

    return d.mapInArrow(run, f"k {d.schema['k'].dataType.simpleString()}, fp long").withColumnRenamed("k", key)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(key, fp, component_id) for each row: component_id is the least key reachable by links of at most `radius` bits.

    Only distinct fingerprints are compared; equal ones share a component at once, whatever their number. Texts without
    words link with each other (fingerprint 0). Null keys never are a component's least key unless all are null.
    """
    small_batches(docs.sparkSession)
    name, = (("_k",) if key.lower() in ("fp", "component_id", "n", "least", "c") else (key,))
    d = written(fingerprints(docs.select(F.col(key).alias(name), F.col(text).alias("_t")), name, "_t", width))
    least = written(d.groupBy("fp").agg(F.min(name).alias("least"), F.count("*").alias("n")))
    joined = components(links(least.select(F.col("fp").alias("id"), "fp"), radius, radius + 1))
    of = written(least.join(joined.select(F.col("id").alias("fp"), "component"), "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("c")))
    named = written(skew_join(of, of.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("fp", "n", "component_id"))
    return skew_join(d, named.select("fp", "component_id"), "fp", named.select("fp", "n")).select(F.col(name).alias(key), "fp", "component_id")


BANDS, ROWS = 16, 4  #: shards of a text, least hashes that name one: at similarity 0.8 two texts share none once in 4,600 times
NEAR = 24  #: bits in which fingerprints of similar texts may differ (10 on average at 0.8, standard deviation 3)


def shingles(h: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts with word hashes h, n words each: the distinct shingles, text by text and sorted; how many each text has.

    A text of fewer than `width` words has one shingle of all, a text without words none.
    """
    step, of = U(0x9E3779B97F4A7C15), np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(h))  # words up to the end of the text
    s = np.zeros(len(h), U)
    for i in range(min(width, int(n.max(initial=0)))):
        s[: len(h) - i] += np.where(left[: len(h) - i] > i, mix(h[i:] + U(i * int(step) & 0xFFFFFFFFFFFFFFFF)) * step, U(0))
    whole = (left >= width) | ((np.repeat(n, n) < width) & (left == np.repeat(n, n)))
    s, of = mix(s[whole]), of[whole]
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    first = np.concatenate(([True], (s[1:] != s[:-1]) | (of[1:] != of[:-1]))) if len(s) else np.zeros(0, bool)
    return s[first], np.bincount(of[first], minlength=len(n))


def _blocks(texts: list[bytes], width: int):
    """shingles() of blocks of texts, with the number of the block's first text; a long text's pieces are put together."""
    for first, h, n in docs_hashes(texts):
        yield first, *shingles(h, n, width)


def _measured(width: int):
    """(k, sig, size, fp, bands): hash of the shingle set, its size, SimHash, and the hashes that name the text's shards."""
    salts = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)

    def run(batches):
        for batch in slices(batches):
            texts = encoded(batch.column(1))
            sig, size, fp, bands = np.zeros(len(texts), U), np.zeros(len(texts), np.int32), np.zeros(len(texts), U), np.zeros((len(texts), BANDS), U)
            for at, s, n in _blocks(texts, width):
                part, some = slice(at, at + len(n)), np.flatnonzero(n) + at
                size[part], of = n, np.repeat(np.arange(len(n)), n)
                ones, votes = lane_votes(s, of, len(n))
                fp[part] = majority(ones, votes)
                if len(s):
                    start = (np.cumsum(n) - n)[n > 0]
                    sig[some] = mix(np.add.reduceat(mix(s), start) + n[n > 0].astype(U))
                    least = [np.minimum.reduceat((s ^ (s >> U(29))) * x, start) for x in salts]
                    for b in range(BANDS):
                        name = np.full(len(some), U(b))
                        for x in least[b * ROWS : (b + 1) * ROWS]:
                            name = mix(name + x)
                        bands[some, b] = name
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig.view(np.int64)), pa.array(size), pa.array(fp.view(np.int64)), lists], names=["k", "sig", "size", "fp", "bands"])

    return run


def _similar(similar: float, width: int):
    """Streams pairs with both texts; yields those whose shingle sets have a Jaccard similarity of `similar` or more."""

    def sets(texts: list[bytes]) -> list[np.ndarray]:
        out = []
        for _, s, n in _blocks(texts, width):
            out += np.split(s, np.cumsum(n)[:-1])
        return out

    def run(batches):
        for batch in slices(batches, 64):
            a, b = batch.column(0).to_pylist(), encoded(batch.column(2))
            known = {}  # a text is often there many times
            for i in {x: i for i, x in enumerate(a)}.values():
                known[a[i]] = sets([b[i]])[0]
            ok = []
            for i, y in enumerate(sets(encoded(batch.column(3)))):
                x = known[a[i]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similar * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similar: float = 0.8, limit: int = 1024) -> DataFrame:
    """(key, component_id): least key reachable by links between texts whose shingle sets are at least `similar`.

    Texts of one shingle set are one node. Sets meet in BANDS shards, each named by ROWS of their least hashes, where SimHashes
    within NEAR bits are found through BK-trees (see components.py); the pairs found are decided on all shingles of the
    whole texts. Texts without words, null ones too, are copies of each other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = written(texts.mapInArrow(_measured(width), f"k {texts.schema['k'].dataType.simpleString()}, sig long, size int, fp long, bands array<long>"))
    d = found.select("k", "sig")
    nodes = written(found.groupBy("sig").agg(F.min("k").alias("least"), F.count("*").alias("n"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    shards = nodes.where("size > 0").select(F.explode("bands").alias("s"), "sig", "size", "fp")
    # the texts of all nodes that share a shard, once
    met = written(shards.groupBy("s").agg(F.count("*").alias("m")).where("m > 1").select("s"))
    shards = written(shards.join(met, "s"))
    some = put_set(shards.select("sig"), "sig", 1 + nodes.count() // 2_000_000)
    forms = written(texts.select("t").mapInArrow(_texts_of(some, width), "sig long, t string").dropDuplicates(["sig"]))

    def decided(pairs):
        one, other = (forms.select(F.col("sig").alias(x), F.col("t").alias(f"t{x}")) for x in "ab")
        many = written(pairs.groupBy("a").agg(F.count("*").alias("n")))
        return skew_join(pairs.join(other, "b"), one, "a", many).select("a", "b", "ta", "tb").mapInArrow(_similar(similar, width), "a long, b long")

    joined = components(linked_in_shards(shards, decided, similar, NEAR, limit, tree=True))
    of = written(nodes.select("sig", "least", "n").join(joined.select(F.col("id").alias("sig"), "component"), "sig", "left").select("sig", "least", "n", F.coalesce("component", "sig").alias("c")))
    named = written(skew_join(of, of.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("sig", "n", "component_id"))
    return skew_join(d, named.select("sig", "component_id"), "sig", named.select("sig", "n")).select(F.col("k").alias(key), "component_id")


def _texts_of(wanted, width: int):
    """Streams texts; yields (sig, t) for those whose shingle set is wanted."""

    def run(batches):
        for batch in slices(batches):
            texts = encoded(batch.column(0))
            sig = np.zeros(len(texts), U)
            for at, s, n in _blocks(texts, width):
                if len(s):
                    sig[np.flatnonzero(n) + at] = mix(np.add.reduceat(mix(s), (np.cumsum(n) - n)[n > 0]) + n[n > 0].astype(U))
            ok = in_set(wanted, sig) & (sig != 0)
            yield pa.RecordBatch.from_arrays([pa.array(sig[ok].view(np.int64)), batch.column(0).filter(pa.array(ok))], names=["sig", "t"])

    return run


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similar: float = 0.8) -> DataFrame:
    """The rows of docs whose key is its component's least (null keys: none is less); of several rows with that key, one."""
    found = near_copies(docs, key, text, width, similar)
    name, = fresh(docs, "_k")
    kept = written(found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias(name)))
    repeats = kept.groupBy(name).count().where("count > 1").limit(1).count()
    out = docs.join(kept.distinct(), docs[key].eqNullSafe(F.col(name)), "left_semi")
    return out.dropDuplicates([key]) if repeats else out


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
