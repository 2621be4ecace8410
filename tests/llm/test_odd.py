"""Clashing column names, rows without keys, repeated rows, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from meridian.llm import line_dedup, mixing, url_filter


def test_mix_with_columns_of_its_own_names(spark):
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2], "a", 1, 2, "x", True, 3.0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, digest string, s int, size int, whole string, rest boolean, taken double")
    plain = {r["doc_id"]: r for r in mixing.mix_documents(docs.select("doc_id", "text", "source")).collect()}
    got = mixing.mix_documents(docs).collect()
    assert {r["doc_id"]: (r["size_"], r["taken_"], r["target"]) for r in got} == {i: (r["size"], r["taken"], r["target"]) for i, r in plain.items()}
    assert all(r["size"] == 2 and r["taken"] == 3.0 and r["digest"] == "a" for r in got)
    taken = mixing.taken_documents(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["taken"] // r["size"] for r in plain.values())
    out = mixing.mix(docs.withColumn("sources", F.array("source")), lambda n: {k: v for k, v in n.items()})
    assert out.columns[-3:] == ["size_", "pattern", "taken_"] and all(r["taken_"] == r["size_"] for r in out.collect())


@pytest.mark.parametrize("same", [True, False])
def test_mix_without_keys_comes_near_its_targets(spark, same):
    rows = [(None, "w " * 12 + ("" if same else f"x{i}"), "ab"[i % 2]) for i in range(20)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 13


def test_judge_with_columns_of_its_own_names(spark):
    urls = ["http://a.net/x", "http://example.net/en/1", "https://b.org/fr/2", "ftp://other.com/z", None, "no url", "http://a.net/x"]
    pages = spark.createDataFrame([(i, u, 1, 2, "r", 4, 5, 6.0) for i, u in enumerate(urls)], "page_id long, url string, host int, path int, rule string, label int, verdict int, score double")
    plain = {r["page_id"]: r for r in url_filter.judge(pages.select("page_id", "url")).collect()}
    got = url_filter.judge(pages).select("page_id", "host", "host_", "path_", "rule_", "verdict_", "score").collect()
    assert len(got) == len(urls) and all((r["host_"], r["path_"], r["rule_"], r["verdict_"]) == tuple(plain[r["page_id"]][c] for c in ("host", "path", "rule", "verdict")) and r["host"] == 1 for r in got)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_lines_of_few_features_meet():
    lines = [b"number " * 20 + b"alphabet", b"number " * 20 + b"betagamma", b"000000 " * 14 + b"total", b"000000 " * 14 + b"totals", b"number " * 60 + b"alphabet"]
    key, owner = line_dedup.line_keys(lines, 1)
    of = [set(key[owner == i].tolist()) for i in range(len(lines))]
    assert of[0] & of[1] and of[2] & of[3] and not of[0] & of[4] and not of[0] & of[2]


def test_many_lines_go_at_once(spark):
    rng = random.Random(1)
    common = [" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 9))) for _ in range(8)) for _ in range(30)]
    texts = ["\n".join(common), "\n".join(["own first line of the second text", *common[:10], "", *common[10:], "own last line of it"]), "\n".join(common[5:7]), "", None, "single"]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], "doc_id long, text string, n_removed int, _lines string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {0: (texts[0], 0), 1: ("own first line of the second text\n\nown last line of it", 30), 2: ("", 2), 3: ("", 0), 4: (None, 0), 5: ("single", 0)}


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline
    from meridian.llm import byte_bpe, ibl_sketch, ngram_lm

    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for op in (ngram_lm.op3_lm_scores, byte_bpe.op5_byte_bpe, ibl_sketch.op9_ibl_sketch, corpus_pipeline.run):
        assert op(spark, d).collect() == []


def test_stages_with_columns_of_internal_names(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    rows = [(i, f"plain text number {i % 9} with some more words in it", "en", "s", 5, 1, 2, 3, "", 4) for i in range(12)] + [(None, None, None, None, None, 1, 2, 3, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _kept int, size int, taken int, digest string, _k int")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and 0 < out.count() <= 3 * docs.count(), name
