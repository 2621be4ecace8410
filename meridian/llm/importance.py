"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Runs of four bytes, and runs of up to three word shapes (classes of the first and last bytes, length, whether it repeats
the word before), are hashed into BUCKETS counts. The target model is that of labelled good documents, the raw
model that of all documents. A document's log weight is the sum over its features of log(p_target / p_raw); with a
seeded Gumbel number added, the k highest stay, which samples k documents without replacement in proportion to weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.shared import slices, small_batches, written
from meridian.llm.words import PIECE, U, encoded, mix, pair, pieces, spans, word_hashes

BUCKETS = 1 << 16
MAX_LABELLED = 50_000  #: labelled rows that the target model and k are fitted on, drawn by hash
SMOOTH = 1.0
WIDTH = 8


_CLASS = np.full(256, 4, np.uint8)  #: of bytes: 0 punctuation, 1 digit, 2 upper, 3 lower, 4 beyond ASCII
_CLASS[:128] = [3 if c.islower() else 2 if c.isupper() else 1 if c.isdigit() else 0 for c in map(chr, range(128))]


def _buckets(a: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets and places of the features of bytes a: runs of four bytes, and runs of one to three word shapes."""
    wide = np.concatenate((a, np.full(3, 10, np.uint8))).astype(np.uint32)
    grams = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    start, end = spans(a)
    shape = (_CLASS[a[start]].astype(U) << U(12)) | (_CLASS[a[end - 1]].astype(U) << U(8)) | (np.minimum(end - start, 15).astype(U) << U(4))
    shape |= (_CLASS[a[np.maximum(end - 2, start)]].astype(U) << U(16)) | U(1)
    h = word_hashes(a.tobytes())[0]
    shape[1:] |= ((h[1:] == h[:-1]) & (start[1:] - end[:-1] < 4)).astype(U) << U(1)  # texts of a block lie four bytes apart
    two = pair(shape[:-1], shape[1:])
    runs = [mix(shape), two, pair(two[:-1], shape[2:])] if len(shape) > 1 else [mix(shape)]
    return [(grams * np.uint32(0x9E3779B1)) >> np.uint32(16), *((r >> U(48)).astype(np.uint32) for r in runs)], [np.arange(len(a)), *(start[len(start) - len(r) :] for r in runs)]


def _features(texts: list[bytes]):
    """In blocks: number of the first text, number of texts, buckets of the features, the text of each from that number."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < PIECE):
            size += len(texts[to])
            to += 1
        if to == at + 1:
            for part in pieces(texts[at]):
                for f in _buckets(np.frombuffer(part, np.uint8))[0] if part else []:
                    yield at, 1, f, np.zeros(len(f), np.int64)
        else:
            ends = np.cumsum([len(x) + 4 for x in texts[at:to]])
            a = np.frombuffer(b"".join(x + b"\n\n\n\n" for x in texts[at:to]), np.uint8)
            for k, (f, place) in enumerate(zip(*_buckets(a))):
                of = np.searchsorted(ends, place, side="right")
                ok = place < ends[of] - 4  # runs that start in the gap go
                if k == 1:
                    rank = np.arange(len(of)) - np.searchsorted(of, of)
                elif k:  # so do runs of k shapes that began in the text before
                    ok &= rank[k - 1 :] >= k - 1
                yield at, to - at, f[ok], of[ok]
        at = to


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, 1000):
        good = np.array(batch.column(1).to_pylist(), dtype=bool)
        for at, n, f, of in _features(encoded(batch.column(0))):
            raw += np.bincount(f, minlength=BUCKETS)
            if good[at : at + n].any():
                target += np.bincount(f[good[at + of]], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([raw.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary())], names=["raw", "target"])


def _sum_counts(batches):
    total = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)]
    for batch in batches:
        for i in (0, 1):
            for x in batch.column(i).to_pylist():
                total[i] += np.frombuffer(x, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total], names=["raw", "target"])


def labelled_sample(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, good) for at most `most` labelled documents, least hashes first; good: quality 1 and not toxic in every label row."""
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).alias("_good"), F.min(F.coalesce("quality", F.lit(0)) == 1).alias("_kept"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(most)


def fit(docs: DataFrame, sample: DataFrame, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """log(p_target / p_raw) of each bucket; counts of all documents. Zeros without any good document."""
    good = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), F.col("k") == sample["_id"], "left").select("t", F.coalesce("_good", F.lit(False)).alias("g"))
    counts = good.mapInArrow(_count, "raw binary, target binary")
    left = good.rdd.getNumPartitions()
    while left > WIDTH:  # tasks' sums meet in ever fewer tasks, the last WIDTH of a megabyte each on the driver
        left = max(WIDTH, left // 64)
        counts = counts.repartition(left).mapInArrow(_sum_counts, "raw binary, target binary")
    rows = counts.collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw += np.frombuffer(r["raw"], np.int64)
        target += np.frombuffer(r["target"], np.int64)
    if not target.sum():
        return np.zeros(BUCKETS)
    p = [(x + SMOOTH) / (x.sum() + SMOOTH * BUCKETS) for x in (target, raw)]
    return np.log(p[0] / p[1])


def log_weights(docs: DataFrame, weight: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row_hash, n_features, log_weight) of each row; null and empty texts weigh 0."""
    d = docs.select(F.col(key).alias("k"), F.xxhash64(key, text).alias("row_hash"), F.col(text).alias("t"))
    packed = weight.tobytes()

    def run(batches):
        w = np.frombuffer(packed)
        for batch in slices(batches, 1000):
            total, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for at, n, f, of in _features(encoded(batch.column(2))):
                total[at : at + n] += np.bincount(of, w[f], n)
                size[at : at + n] += np.bincount(of, minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(total)], names=["k", "row_hash", "n_features", "log_weight"])

    return d.mapInArrow(run, f"k {d.schema['k'].dataType.simpleString()}, row_hash long, n_features long, log_weight double").withColumnRenamed("k", key)


def gumbel(seed: int, *cols) -> Column:
    """A standard Gumbel number from a hash of the columns."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_highest(values: DataFrame, col: str, k: int) -> int:
    """The k-th highest value of a long column, by histograms of 16 bits at a time; the least long if there are fewer."""
    at, left = 0, k
    df = values.select((F.col(col).bitwiseXOR(F.lit(-(1 << 63)))).alias("v"))
    for shift in (48, 32, 16, 0):
        cell = F.shiftrightunsigned("v", shift).bitwiseAND(F.lit(0xFFFF))
        n = df.groupBy(cell.alias("c")).count()
        run = n.withColumn("upto", F.sum("count").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)))
        hit = run.where(F.col("upto") >= left).orderBy(F.desc("c")).first()
        if hit is None:
            return -(1 << 63)
        left -= hit["upto"] - hit["count"]
        at = at << 16 | hit["c"]
        df = df.where(cell == hit["c"])
    return (at ^ (1 << 63)) - (1 << 64 if (at ^ (1 << 63)) >> 63 else 0)


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", share: float | None = None, seed: int = 11) -> DataFrame:
    """(key, row_hash, n_features, log_weight, gumbel_key, kept) of each row of docs.

    k is `share` of the rows; without a share, that of the sampled labelled rows with quality 1 (all, without labels).
    Equal rows have equal keys and stay or go together; ties at the k-th key stay. Null and empty texts weigh 0.
    """
    small_batches(docs.sparkSession)
    sample = written(labelled_sample(labels))
    weights = written(log_weights(docs, fit(docs, sample, text, key), key, text).withColumn("gumbel_key", F.col("log_weight") + gumbel(seed, "row_hash")))
    if share is None:
        share = sample.agg(F.avg(F.col("_kept").cast("double"))).first()[0]
        share = 1.0 if share is None else share
    k = math.ceil(share * weights.count())
    # 1e6 steps a unit; far keys keep their order
    scaled = weights.withColumn("_rank", (F.greatest(F.least("gumbel_key", F.lit(9e12)), F.lit(-9e12)) * 1e6).cast("long"))
    least = kth_highest(scaled, "_rank", k) if k else (1 << 63) - 1
    return scaled.withColumn("kept", F.col("_rank") >= F.lit(least)).drop("_rank")


def op1_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return resample(docs, labels).select("doc_id", "n_features", "log_weight", "gumbel_key", "kept")
