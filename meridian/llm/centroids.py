"""Dimension-sharded Lloyd: tasks over blocks of columns add up exact squared distances, and each block updates its own slice of the centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.shared import fresh, written

BLOCK = 16  #: columns of a block
CHUNK = 2048  #: vectors whose columns lie in one matrix
MOST = 1 << 27  #: greater entries, after scaling, count as this: a squared distance must fit a long


def _batch(names: list[str], rows: list[tuple], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[] for _ in kinds], kinds)], names=names)


def _packed(dim: int, scale: float, block: int, chunk: int):
    """Streams (k, v); yields (chunk, block, keys, m): a chunk's columns of a block as a matrix of int32, its keys beside the first block.

    A chunk is named by its task and its place there, so its blocks can be put together again once they are written.
    """

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                some = batch.slice(i, chunk)
                x = np.asarray(some.column(1).flatten(), np.float64).reshape(-1, dim)
                with np.errstate(over="ignore"):
                    m = np.clip(np.floor(x * scale), -MOST, MOST).astype(np.int32)
                keys = some.column(0)
                for b in range(0, dim, block):
                    part = pa.array([np.ascontiguousarray(m[:, b : b + block]).tobytes()], pa.binary())
                    held = pa.ListArray.from_arrays(pa.array([0, len(keys) if b == 0 else 0], pa.int32()), keys if b == 0 else keys.slice(0, 0))
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([b // block], pa.int32()), held, part], names=["chunk", "block", "keys", "m"])
                at += 1

    return run


def _partials(slices: list[np.ndarray]):
    """Squared distances within a block: (chunk, d), a row of int64 for each vector with an entry for each centroid."""

    def run(batches):
        for batch in batches:
            out = []
            for chunk, b, m in zip(*(batch.column(i).to_pylist() for i in range(3))):
                c = slices[b]
                x = np.frombuffer(m, np.int32).reshape(-1, c.shape[1]).astype(np.int64)
                out.append((chunk, np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1).tobytes()))
            yield _batch(["chunk", "d"], out, [pa.int64(), pa.binary()])

    return run


def _nearest(k: int):
    """The blocks of one chunk added up: (chunk, cluster, distance) as packed bytes; ties go to the smaller number."""

    def run(key, group):
        d = sum(np.frombuffer(x, np.int64).reshape(-1, k) for x in group["d"].to_pylist())
        at = d.argmin(axis=1)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "cluster": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "distance": pa.array([d[np.arange(len(d)), at].tobytes()], pa.binary())})

    return run


def _sums(k: int, block: int, dim: int):
    """Streams (block, m, cluster); yields a task's column sums: (block, cluster, col, n, total)."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        n: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, m, cluster in zip(*(batch.column(i).to_pylist() for i in range(3))):
                of, wide = np.frombuffer(cluster, np.int32), min(block, dim - b * block)
                x = np.frombuffer(m, np.int32).reshape(-1, wide).astype(np.int64)
                if b not in total:
                    total[b], n[b] = np.zeros((k, wide), np.int64), np.zeros(k, np.int64)
                np.add.at(total[b], of, x)
                n[b] += np.bincount(of, minlength=k)
        rows = [(b, c, b * block + j, int(n[b][c]), int(total[b][c, j])) for b in total for c in np.flatnonzero(n[b]) for j in range(total[b].shape[1])]
        yield _batch(["block", "cluster", "col", "n", "total"], rows, [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])

    return run


def lloyd(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, scale: float = 64.0, seed: int = 1, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(key, cluster int, distance long) for each row whose vector has exactly dim entries, none null or non-finite; (cluster, centroid array<bigint>).

    Entries become floor(scale * x). The first centroids are the k vectors with the least SHA-256 of `seed:key`, in that order
    (of equal keys the lesser vector first; null keys come last). Each round assigns every vector to the nearest centroid
    (ties: smaller number) and replaces centroids that have vectors by the exact floor of their means; then vectors are
    assigned once more. Fewer than k vectors make as many centroids; without vectors there are no rows. Repeated rows count as
    often as they are there. Entries beyond MOST after scaling count as MOST.

    A task's work is on matrices of CHUNK vectors by `block` columns. Only the k * dim entries of the centroids reach the driver.
    """
    v = F.col(vector).cast("array<double>")
    good = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).alias("k"), v.alias("v")).where(F.coalesce(good, F.lit(False)))
    kind = rows.schema["k"].dataType.simpleString()
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("k").cast("string")), 256)
    first = rows.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([[min(max(int(np.floor(x * scale)), -MOST), MOST) if abs(x) < 1e300 else int(np.sign(x)) * MOST for x in r["v"]] for r in first], np.int64).reshape(-1, dim)
    k = len(centroids)
    names = (key, *fresh(df.select(key), "cluster", "distance"))
    named = lambda c: df.sparkSession.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cluster int, centroid array<bigint>")
    if not k:
        return df.sparkSession.createDataFrame([], f"k {kind}, cluster int, distance long").toDF(*names), named(centroids)
    cells = written(rows.mapInArrow(_packed(dim, scale, block, CHUNK), f"chunk long, block int, keys array<{kind}>, m binary"))

    def assigned(c: np.ndarray) -> DataFrame:
        slices = [c[:, b : b + block] for b in range(0, dim, block)]
        parts = cells.select("chunk", "block", "m").mapInArrow(_partials(slices), "chunk long, d binary")
        return written(parts.groupBy("chunk").applyInArrow(_nearest(k), "chunk long, cluster binary, distance binary"))

    for _ in range(rounds):
        near = assigned(centroids).select("chunk", "cluster")
        parts = cells.select("chunk", "block", "m").join(near, "chunk").select("block", "m", "cluster").mapInArrow(_sums(k, block, dim), "block int, cluster int, col int, n long, total long")
        whole = parts.groupBy("block", "cluster", "col").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        floor = ((F.col("total") - F.pmod("total", F.col("n").cast("decimal(19,0)"))) / F.col("n")).cast("long")
        moved = whole.select("cluster", "col", floor.alias("x")).collect()  # k * dim rows at most
        centroids = centroids.copy()
        for r in moved:
            centroids[r["cluster"], r["col"]] = r["x"]
    last = assigned(centroids)
    flat = cells.where("block = 0").select("chunk", "keys").join(last, "chunk")

    def rows_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cluster, distance = (pa.array(np.frombuffer(batch.column(j)[i].as_py(), t)) for j, t in ((1, np.int32), (2, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), cluster, distance], names=["k", "cluster", "distance"])

    out = flat.select("keys", "cluster", "distance").mapInArrow(rows_of, f"k {kind}, cluster int, distance long")
    return out.toDF(*names), named(centroids)


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """16 clusters of all embeddings after three rounds, with inertias and digests of the centroids."""
    found, centroids = lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    digests = centroids.select("cluster", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    found = written(found)
    by = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(digests, "cluster")
    by = by.join(found.agg(F.sum("distance").alias("inertia")))  # one row, beside at most 16
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(n: int, last: bool = False) -> str:
    """SQL for one assignment to the centroids c{n}, and for the centroids after it."""
    near = f"a{n} AS (SELECT r, arg_min(j, (d, j)) AS cluster, min(d) AS distance FROM (SELECT r, j, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM vectors, c{n}) GROUP BY r)"
    if last:
        return near
    means = f"m{n} AS (SELECT cluster, list(x ORDER BY i) AS c FROM (SELECT cluster, i, floor_div(sum(x)::BIGINT, count(*)) AS x FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{n} JOIN vectors USING (r)) GROUP BY cluster, i) GROUP BY cluster)".replace("floor_div(sum(x)::BIGINT, count(*))", "((sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*))::BIGINT")
    return f"{near}, {means}, c{n + 1} AS (SELECT j, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m ON o.j = m.cluster)"


OP13_SQL = (
    "WITH vectors AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64), "
    "c0 AS (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS j, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM vectors ORDER BY h, v LIMIT 16)), "
    + ", ".join(_round(n) for n in range(3))
    + f", {_round(3, True)} SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a3 JOIN vectors USING (r) JOIN c3 ON cluster = j"
)
