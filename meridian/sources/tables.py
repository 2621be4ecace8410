"""Frames of notes, links, attachments, unresolved links, positions and events, read from Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARLY = "1995-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("folder"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, path, basename, tags): a note for each customer, in the folder region/nation, tagged with its market segment."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(_places(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("key"), F.concat("folder", F.lit("/"), "c_name", F.lit(".md")).alias("path"), F.col("c_name").alias("basename"), F.array("c_mktsegment").alias("tags"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(F.broadcast(_places(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("key"), F.concat("folder", F.lit("/"), "s_name", F.lit(".md")).alias("path"), F.col("s_name").alias("basename"), F.array().cast("array<string>").alias("tags"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertex source: (path, basename, tags)."""
    return customers(spark, sf_dir).unionByName(suppliers(spark, sf_dir)).select("path", "basename", "tags")


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, basename): a file for each part; its extension is not md."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"), F.col("p_name").alias("basename"))


def _lines(spark: SparkSession, sf_dir: str, when: Column | None) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    lines = (lines.where(when) if when is not None else lines).select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def links(spark: SparkSession, sf_dir: str, early: bool = False) -> DataFrame:
    """The resolved links (src, dst, w): lines from customer to supplier, returned ones the other way. early: those shipped before EARLY."""
    lines = _lines(spark, sf_dir, F.col("l_shipdate") < F.lit(EARLY).cast("timestamp") if early else None)
    pairs = lines.groupBy("o_custkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("back")).agg(F.count("*").cast("double").alias("w"))
    c, s = customers(spark, sf_dir).select(F.col("key").alias("ck"), F.col("path").alias("cp")), suppliers(spark, sf_dir).select(F.col("key").alias("sk"), F.col("path").alias("sp"))
    named = pairs.join(c, F.col("o_custkey") == F.col("ck")).join(s, F.col("l_suppkey") == F.col("sk"))
    return named.select(F.when(F.col("back"), F.col("sp")).otherwise(F.col("cp")).alias("src"), F.when(F.col("back"), F.col("cp")).otherwise(F.col("sp")).alias("dst"), "w")


def attachment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w): lines from supplier to part."""
    s = suppliers(spark, sf_dir).select(F.col("key").alias("sk"), F.col("path").alias("src"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("w"))
    return lines.join(s, F.col("l_suppkey") == F.col("sk")).select("src", F.concat(F.lit("parts/"), F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("dst"), "w")


def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w): from each page's url path to the targets of its href attributes."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))
    return pages.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, x, y, z, owner, w): unit vectors from the first three entries of each embedding; owner is its label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")), "label")
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return e.where(n > 1e-12).select(F.col("vec_id").cast("int").alias("idx"), *((F.col(c) / n).alias(c) for c in "xyz"), F.col("label").alias("owner"), (F.col("vec_id") % 7 + 1).cast("double").alias("w"))


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, ts, reason): events by user."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_type").alias("reason"))
