"""Byte-level BPE: long texts are pre-tokenised as overlapping chunks in parallel, stitched, and encoded in pieces.

Two neighbouring chunks agree on the rest of the text from the first pre-token boundary that both have in their overlap:
the pattern reads left to right and a match depends only on what follows its start. Pieces end at such boundaries. Where
an overlap has none (one pre-token longer than the overlap), the chunks stay one piece. Decoding concatenates the bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.shared import slices, small_batches

CHUNK = 32_768  #: code points; a text of no more is one chunk
OVERLAP = 1_024
LOOK = 3  #: code points after a boundary that the pattern may have looked at


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def id_arrays(enc, texts: list[str]) -> tuple[pa.Array, pa.Array]:
    """Numbers of ids, and the ids of each text as one Arrow list array."""
    ids = [enc.encode_to_numpy(t, disallowed_special=()) for t in texts]
    n = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
    return pa.array(n), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat))


def id_lists(column: pa.ListArray) -> list[list[int]]:
    """The lists of an Arrow column; null is empty. Much faster than to_pylist."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[i:j].tolist() for i, j in zip(at[:-1], at[1:])]


def boundaries(chunk: str, pattern: str, start: int, last: bool) -> list[int]:
    """Places, counted from the text's start, where the chunk's pre-tokens begin; without those that more text could move."""
    import regex

    most = len(chunk) if last else len(chunk) - LOOK
    return [start + m.start() for m in regex.finditer(pattern, chunk) if m.start() <= most]


def stitch(overlaps: list[tuple[int, list[int], list[int]]]) -> list[int]:
    """From (chunk number, its boundaries in the overlap with the next, the next one's there): where pieces begin, after 0."""
    out = []
    for _, left, right in sorted(overlaps):
        common = set(left) & set(right)
        if common:
            out.append(min(common))
    return out


def _rows(batch: pa.RecordBatch, i: int) -> list[str]:
    return ["" if t is None else t for t in batch.column(i).to_pylist()]


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row a row of docs: key, n_tokens, ids (array<int>). Null is the empty text; rows that repeat stay apart.

    A text of one chunk is encoded where it is read. The chunks of longer texts are dealt to all tasks, and so are their
    pieces; only numbers and ids come together again, by text.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = docs.schema["k"].dataType.simpleString()

    def whole(batches):
        enc = encoding(ranks_path, pattern)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *id_arrays(enc, _rows(batch, 1))], names=["k", "n_tokens", "ids"])

    short = docs.where(F.length("t") <= chunk).mapInArrow(whole, f"k {kind}, n_tokens long, ids array<int>")
    long_ = docs.where(F.length("t") > chunk).withColumn("h", F.xxhash64("t"))
    # equal rows (key and text) are cut once and counted
    long_ = long_.groupBy("k", "h").agg(F.first("t").alias("t"), F.count("*").alias("copies"))

    def cut(batches):
        for batch in batches:
            for i, t in enumerate(_rows(batch, 2)):
                k, h = batch.column(0)[i], batch.column(1)[i]
                starts = range(0, len(t), chunk)
                for j, s in enumerate(starts):
                    part = t[s : s + chunk + overlap]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], batch.column(0).type), pa.array([h.as_py()]), pa.array([j], pa.int32()), pa.array([s], pa.int64()), pa.array([s + len(part) >= len(t)]), pa.array([part])], names=["k", "h", "j", "s", "last", "part"])

    chunks = long_.mapInArrow(cut, f"k {kind}, h long, j int, s long, last boolean, part string")
    dealt = chunks.repartition(F.xxhash64("k", "h"), "j")

    def tokenise(batches):
        """The chunk's boundaries in its overlap with the next (side 0, numbered j) and with the one before (side 1, j - 1)."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = boundaries(r["part"], pattern, r["s"], r["last"])
                if r["j"]:
                    out.append((r["k"], r["h"], r["j"] - 1, 1, [x for x in found if r["s"] <= x < r["s"] + overlap]))
                out.append((r["k"], r["h"], r["j"], 0, [x for x in found if x >= r["s"] + chunk]))
            names, kinds = ["k", "h", "j", "side", "found"], [batch.column(0).type, pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)

    marks = dealt.mapInArrow(tokenise, f"k {kind}, h long, j int, side int, found array<long>")
    # the first boundary that both chunks have, by overlap; then the piece starts, by text
    syncs = marks.groupBy("k", "h", "j").agg(F.array_agg(F.when(F.col("side") == 0, F.col("found"))).alias("a"), F.array_agg(F.when(F.col("side") == 1, F.col("found"))).alias("b"))
    syncs = syncs.select("k", "h", F.array_min(F.array_intersect(F.flatten(F.filter("a", lambda x: x.isNotNull())), F.flatten(F.filter("b", lambda x: x.isNotNull())))).alias("sync"))
    cuts = syncs.groupBy("k", "h").agg(F.array_sort(F.array_agg("sync")).alias("cuts"))
    both = long_.alias("l").join(cuts.alias("c"), F.col("l.k").eqNullSafe(F.col("c.k")) & (F.col("l.h") == F.col("c.h"))).select("l.k", "l.h", "t", "cuts")

    def split(batches):
        for batch in batches:
            for r in batch.to_pylist():
                at = [0, *r["cuts"], len(r["t"])]
                for j, (a, b) in enumerate(zip(at, at[1:])):
                    yield pa.RecordBatch.from_arrays([pa.array([r["k"]], batch.column(0).type), pa.array([r["h"]]), pa.array([j], pa.int32()), pa.array([r["t"][a:b]])], names=["k", "h", "j", "piece"])

    pieces = both.mapInArrow(split, f"k {kind}, h long, j int, piece string").repartition(F.xxhash64("k", "h"), "j")

    def encode_pieces(batches):
        enc = encoding(ranks_path, pattern)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], id_arrays(enc, _rows(batch, 3))[1]], names=["k", "h", "j", "ids"])

    coded = pieces.mapInArrow(encode_pieces, f"k {kind}, h long, j int, ids array<int>")
    joined = coded.groupBy("k", "h").agg(F.array_sort(F.array_agg(F.struct("j", "ids"))).alias("parts")).select("k", "h", F.flatten("parts.ids").alias("ids"))
    counted = long_.select("k", "h", "copies").alias("l").join(joined.alias("c"), F.col("l.k").eqNullSafe(F.col("c.k")) & (F.col("l.h") == F.col("c.h")))
    long_out = counted.select("l.k", F.size("ids").cast("long").alias("n_tokens"), "ids", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).drop("_")
    return short.unionByName(long_out).withColumnRenamed("k", key)


def _decoded(batches, ranks_path: str, pattern: str, ids: int):
    """Parts of batches, the id lists of column number `ids`, and the bytes of each list."""
    enc = encoding(ranks_path, pattern)
    for batch in slices(batches):
        lists = id_lists(batch.column(ids))
        yield batch, lists, [enc.decode_bytes(x) for x in lists]


def decode(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """coded with decoded (binary): the bytes of its ids, concatenated; null ids decode to nothing."""
    names = coded.columns

    def run(batches):
        for batch, _, raw in _decoded(batches, ranks_path, pattern, names.index("ids")):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*names, "decoded"])

    return coded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields) + ", decoded binary")


def encoded_digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes).

    One row a row of docs; null is the empty text. Ids are decoded and digested in one pass, so that a task has one Python
    worker for both and the bytes stay in it.
    """
    coded = encode(docs, ranks_path, pattern, key, text)

    def run(batches):
        decimal = [str(i) for i in range(encoding(ranks_path, pattern).n_vocab)].__getitem__
        for batch, lists, raw in _decoded(batches, ranks_path, pattern, 2):
            ids = [hashlib.sha256(",".join(map(decimal, x)).encode()).hexdigest() for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(key, "n_tokens", "ids").mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark, sf_dir: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Every whole text of documents, by the ranks of a public vocabulary file (a parameter; never copied here)."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded_digests(docs, ranks_path or P.path("byte_bpe_multi_50k.tiktoken"), pattern or P.PATTERN)
