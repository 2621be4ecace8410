"""A corpus pipeline: each stage works on all that the one before kept, which is written and read again between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.llm import byte_bpe, importance, line_dedup, mixing, simhash_dedup
from meridian.llm.shared import fresh, written


def quality(spark, docs, sf_dir):
    """Documents that importance resampling keeps; rows equal in doc_id and text stay or go together. An empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    name, = fresh(docs, "_kept")
    kept = importance.resample(docs, labels).where("kept").select(F.col("row_hash").alias(name)).distinct()
    return docs.join(kept, F.xxhash64(docs["doc_id"], docs["text"]) == F.col(name), "left_semi")


def lines(spark, docs, sf_dir):
    """Documents without the lines that others, or they themselves, have before; all documents stay, null texts as null. n_chars follows the text."""
    left = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies: five words a shingle, similarity 0.8 or more; that with the least doc_id."""
    return simhash_dedup.keep_one(docs)


def source_mix(spark, docs, sf_dir):
    """The documents that the mix takes; one that it takes several times is there as often."""
    return mixing.taken_documents(docs)


def tokens(spark, docs, sf_dir):
    """Digests of each document's token ids and of the bytes decoded from them; a null text is empty, a repeated row has a row each."""
    import public_tokenizers as P

    return byte_bpe.encoded_digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("tokens", tokens)]

#: SQL has neither the models nor BPE, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
