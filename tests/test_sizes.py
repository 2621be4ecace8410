"""What shows only in large tables or odd values: plans, small limits, zeros."""

import functools
import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meridian.functions import paths as P
from meridian.functions import hashing as H
from meridian.operators import communities, indexing, layout, signatures, traversal
from meridian.sources import tables

DIR = "/root/testdata/sf0.001"


def test_a_view_of_no_width(spark, tmp_path):
    spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 400.0)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    name = "h42_h46_view_scalars"
    want = duckdb.sql(f"WITH events AS (SELECT * FROM '{tmp_path}/events.parquet/*.parquet') {entry.oracle_sql()[name]}")
    got = entry.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    clean = lambda rows: sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)
    assert clean(got) == clean(want.fetchall())


def test_digest_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(signatures, "FAN", 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for n in (0, 1, 3, 4, 20):
        got = signatures.ordered_digest(spark.range(n).repartition(3).selectExpr("id", "'t' || id AS t"), F.col("t"), F.col("id")).collect()
        blocks = [sha("".join(sha(f"=t{i}") for i in range(k, min(n, k + 3)))) for k in range(0, n, 3)]
        assert [r["digest"] for r in got] == [blocks[0] if n and n <= 3 else sha("".join(blocks))], n


@pytest.mark.parametrize("name", ["m3_parsed_edges", "b8_induced_edges", "g9_prune", "c4_e4_dense_index", "c2_d2_attachment_edges", "g2_affected_nodes", "i3_refresh_plan"])
def test_paths_of_links_are_normalised_once(spark, name):
    plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    copies = max(line.count("regexp_replace(") for line in plan.replace("\n" + P.BLANKS, "").split("+- "))
    assert copies <= 10


def test_fast_and_slow_paths_agree(spark):
    ends = [*P.BLANKS, "\\", "/", ".", "a", " ", ""]
    rows = [(a + m + b,) for a in ends for m in ("", "x", "x/y", "x//y", "\\") for b in ends]
    slow = F.regexp_replace(F.regexp_replace(F.regexp_replace(P.trimmed(F.col("p")), r"\\", "/"), "^/+", ""), "/{2,}", "/")
    got = spark.createDataFrame([*rows, (None,)], "p string").where(~P.normal_path(F.col("p")).eqNullSafe(F.when(slow == ".", "").otherwise(slow)))
    assert got.count() == 0


def test_refresh_plan_stores_each_link_once(spark, monkeypatch):
    stored = []
    keep = traversal.checkpointed
    monkeypatch.setattr(traversal, "checkpointed", lambda df: stored.append(df.count()) or keep(df))
    n = spark.createDataFrame([(x, True) for x in "abcd"], "id string, existing boolean")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("d", "d")], "src_id string, dst_id string")
    got = traversal.refresh_plan(n, e, n.where("id = 'a'").select("id"), 2).collect()
    assert {r["id"]: r["hop"] for r in got} == {"a": 0, "b": 1, "c": 2, "d": None} and stored[0] == 4


@pytest.mark.parametrize("few", [0, 3, 16])
def test_sets_in_sets_of_all_sizes(spark, monkeypatch, few):
    monkeypatch.setattr(communities, "FEW", few)
    r = random.Random(few)
    sets = {f"s{i:03d}": frozenset(r.choices(range(9), k=r.choice((1, 1, 2, 3, 4, 6, 9)))) for i in range(90)}
    score = {s: r.choice((0.1, 0.2, 0.27, 0.3)) for s in sets}
    m = spark.createDataFrame([(s, x) for s, of in sets.items() for x in (*of, min(of))], "set string, id long")
    scored = spark.createDataFrame([(s, score[s], len(of)) for s, of in sets.items()], "set string, score double, n long")
    for strict in (True, False):
        want = sorted((a, b) for a in sets for b in sets if a != b and (sets[a] < sets[b] if strict else sets[a] <= sets[b]))
        assert sorted(map(tuple, communities.contained(m, strict).collect())) == want
    kept = {s for s in sets if not any(sets[s] < sets[b] and score[b] + 0.06 >= score[s] for b in sets)}
    assert {x["set"] for x in communities.without_incomplete(scored, m).collect()} == kept
    whole = set()
    for p in sets:
        used, k = set(), 0
        for c in sorted((c for c in sets if sets[c] < sets[p] and score[c] + 0.12 >= score[p]), key=lambda c: (-score[c], -len(sets[c]), c)):
            if not used & sets[c]:
                used, k = used | sets[c], k + 1
        if not (k >= 2 and len(used) >= 0.82 * len(sets[p])):
            whole.add(p)
    assert {x["set"] for x in communities.without_splittable(scored, m).collect()} == whole


def test_equal_sets_are_compared_once(spark):
    m = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(k, x) for k in range(100, 130) for x in (0, 1, 2)], "set long, id long")
    of, pairs = communities._kinds(m)
    assert sorted(map(tuple, pairs.collect())) == [(0, 100), (1, 100)] and of.count() == 90 and communities.contained(m).count() == 60 * 30


@pytest.mark.parametrize("reach", [0, 12, 100])
def test_set_metrics_by_lists_and_bitmaps(spark, monkeypatch, reach):
    monkeypatch.setattr(communities, "REACH", reach)
    want = duckdb.sql(f"SELECT * FROM ({_over(DIR)} {entry.oracle_sql()['d15_set_metrics'].removeprefix('WITH')})")
    got = entry.queries()["d15_set_metrics"](spark, DIR).select(*want.columns).collect()
    clean = lambda rows: sorted(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows)
    assert clean(got) == clean(want.fetchall())


def _over(folder):
    return "WITH " + ", ".join(f"{t} AS (SELECT * FROM '{folder}/{t}.parquet')" for t in ("region", "nation", "customer", "supplier", "orders", "lineitem")) + ","


def test_moves_store_links_by_ordinal(spark, monkeypatch):
    stored = []
    keep = communities.checkpointed
    monkeypatch.setattr(communities, "checkpointed", lambda df: stored.append(df.schema) or keep(df))
    n = spark.createDataFrame([(x,) for x in "abc"], "id string")
    arcs = communities.arcs_of(spark.createDataFrame([("a", "b", 9.0), ("b", "c", 9.0)], "src_id string, dst_id string, weight double"))
    labels, _ = communities.move_labels(n, arcs, 0.5, rounds=1)
    assert labels.schema["label"].dataType.simpleString() == "string" and labels.count() == 3
    assert all(s["id"].dataType.simpleString() == "bigint" for s in stored if "other" in s.names)


def test_repulsion_stores_no_pairs(spark):
    p = tables.positions(spark, DIR)
    q = entry.queries()["k10_repulsion"](spark, DIR)
    assert q._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    at = indexing.dense_index(p.withColumnRenamed("idx", "vec"), "vec").select("idx", "x", "y", "z")
    n = at.count()
    spots, got = {r["idx"]: (r["x"], r["y"], r["z"]) for r in at.collect()}, layout.local_repulsion(at, n, 0.2, samples=3)

    def mix(x):
        x = (x ^ x >> 16) * H.MIX_A & H.MASK
        x = (x ^ x >> 15) * H.MIX_B & H.MASK
        return x ^ x >> 15

    def picked(i, s):
        b = functools.reduce(lambda h, v: mix(h ^ v), (0, i, s, 0x9E6), mix(7)) % (n - 1)
        return b + (b >= i)

    pairs = {tuple(sorted((i, picked(i, s)))) for i in spots for s in range(3)}
    pairs |= {(a, b) for a in spots for b in spots if a < b and math.dist(spots[a], spots[b]) <= 2 * math.sin(0.1)}
    rows = spark.createDataFrame([(a, b, *spots[a], *spots[b]) for a, b in pairs], "a int, b int, ax double, ay double, az double, bx double, by double, bz double")
    want = {r["idx"]: r for r in layout.repulsion(rows, n).collect()}
    got = got.collect()
    assert {r["idx"] for r in got} == set(want)
    assert all(r[c] == pytest.approx(want[r["idx"]][c], abs=1e-9) for r in got for c in ("fx", "fy", "fz"))
