"""Files in the cluster's shared folder: written tables and memory-mapped arrays."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset (tests), under a local temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="meridian-")
        spark.conf.set("spark.checkpoint.dir", base)
    # a path without a scheme lies in the default file system, as for Spark itself
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/meridian-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df does not have (Spark ignores case in names)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
        have.add(name.lower())
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send Python workers at most `rows` rows at a time from here on, so that they hold a few MB of text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def written(df: DataFrame, at: str | None = None) -> DataFrame:
    """The same rows read back from the shared folder: lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    at = at or f"{shared_dir(spark)}/table"
    df.write.mode("overwrite").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _fs(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def put_arrays(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Write each array to folder/name.key.npy. A task that is run again replaces the file with equal bytes."""
    where, path = _fs(folder)
    where.create_dir(path, recursive=True)
    for key, a in arrays.items():
        to, tmp = f"{path}/{name}.{key}.npy", f"{path}/.{uuid.uuid4().hex}"
        out = io.BytesIO()
        np.save(out, np.ascontiguousarray(a))
        with where.open_output_stream(tmp) as f:
            f.write(out.getbuffer())
        where.move(tmp, to)


@lru_cache(maxsize=4096)
def get_array(folder: str, name: str, key: str) -> np.ndarray:
    """Memory-map folder/name.key.npy. A folder that is not a mounted path is copied to local disk once a worker."""
    where, path = _fs(folder)
    path = f"{path}/{name}.{key}.npy"
    if where.type_name != "local":
        local = os.path.join(tempfile.mkdtemp(prefix="meridian-"), os.path.basename(path))
        with where.open_input_stream(path) as f, open(local, "wb") as to:
            while chunk := f.read(1 << 22):
                to.write(chunk)
        path = local
    return np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)


def pack(*arrays: np.ndarray) -> bytes:
    """Compress arrays of one length, byte plane by byte plane; u64 arrays that are sorted go as differences."""
    import zstandard

    parts = [np.uint64(len(arrays[0])).tobytes()]
    for a in arrays:
        rising = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        b = np.diff(a, prepend=a.dtype.type(0)) if rising else a
        parts += [bytes([a.dtype.itemsize, rising]), np.ascontiguousarray(b.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw[:8], np.uint64)[0]), 8, []
    while at < len(raw):
        w, rising = raw[at], raw[at + 1]
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * w, at + 2).reshape(w, n).T).reshape(-1).view(f"u{w}")
        out.append(np.cumsum(a, dtype=a.dtype) if rising else a)
        at += 2 + n * w
    return out


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a column, to size partitions by."""
    from pyspark.sql import functions as F

    return int(df.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).first()[0])


def slices(batches, rows: int = 256, most: int = 1 << 23):
    """Arrow batches cut into parts of at most `rows` rows and about `most` bytes of text, so that Python objects exist for few documents at a time.

    At the end Arrow and the C library give back what they no longer use: workers live on for later tasks.
    """
    import ctypes

    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for col in batch.columns:
            if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
                size += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        upto, i = np.cumsum(size), 0
        while i < batch.num_rows:
            before = int(upto[i] - size[i])
            n = min(rows, max(1, int(np.searchsorted(upto, before + most, side="right")) - i))
            yield batch.slice(i, n)
            i += n
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def skew_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame | None = None, spread: int = 200) -> DataFrame:
    """left joined with right (one row a key) on key; no task gets more than about 1 / spread of the rows of left for being of one key.

    Keys with over 1 / spread of all rows are salted on the left and repeated on the right. So there are fewer than
    `spread` such keys, which bounds the list of them that is broadcast. counts: (key, n) of left, if known. left is read twice.
    """
    from pyspark.sql import functions as F

    counts = written(left.groupBy(key).agg(F.count("*").alias("n"))) if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = written(counts.where((F.col("n") > max(1, total // spread)) & F.col(key).isNotNull()).select(F.col(key).alias("_hot"), F.ceil(F.col("n") * spread / max(1, total)).cast("int").alias("_salts")))
    if hot.isEmpty():
        return left.join(right, key)
    few = F.broadcast(hot)
    one = left.join(few, left[key] == few["_hot"], "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int"))).drop("_hot", "_salts")
    other = right.join(few, right[key] == few["_hot"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_hot", "_salts")
    return one.join(other, [key, "_salt"]).drop("_salt")


def put_set(df: DataFrame, col: str, buckets: int) -> tuple[str, int]:
    """Write the distinct values of a long column as sorted arrays, by equal ranges of the 64-bit space."""
    from pyspark.sql import functions as F

    from meridian.llm.words import U, bucket_of

    folder = shared_dir(df.sparkSession)

    def numbered(batches):
        import pyarrow as pa

        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bucket_of(h, buckets).astype(np.int32))], names=["h", "bucket"])

    def run(key, group):
        import pyarrow as pa

        h = np.unique(group["h"].drop_null().to_numpy().view(np.uint64))
        put_arrays(folder, str(key[0].as_py()), h=h)
        return pa.table({"n": pa.array([len(h)], pa.int64())})

    rows = df.select(F.col(col).alias("h")).where("h IS NOT NULL").mapInArrow(numbered, "h long, bucket int")
    every = df.sparkSession.range(buckets).select(F.lit(None).cast("long").alias("h"), F.col("id").cast("int").alias("bucket"))  # empty buckets get a file too
    rows.union(every).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, "n long").agg(F.sum("n")).first()
    return folder, buckets


def in_set(where: tuple[str, int], h: np.ndarray) -> np.ndarray:
    """Which of the hashes are in a set that put_set wrote; reads it through memory maps."""
    from meridian.llm.words import bucket_of

    folder, buckets = where
    order = np.argsort(h)
    q, out = h[order], np.zeros(len(h), bool)
    bucket = bucket_of(q, buckets)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i, j in zip(cut, [*cut[1:], len(q)]):
        have = get_array(folder, str(bucket[i]), "h")
        if len(have):
            at = np.minimum(np.searchsorted(have, q[i:j]), len(have) - 1)
            out[order[i:j]] = np.asarray(have[at]) == q[i:j]
    return out
