"""Prefix trie, tensored MinHash and dimension-sharded Lloyd against brute force, with nulls, repeats, ties, long texts and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import centroids, minhash_dedup, prefix_trie
from test_near import WORDS, edited, least_reachable, shingle_set

TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_trie(turns, splice):
    own = defaultdict(list)
    for c, o, r, x in turns:
        if c is not None:
            own[c].append(((o is not None, o or 0), r or "", x or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if splice else 0
        paths[c] = own.get(c - c % 5, [])[:h] + ts[h:] if splice else ts
    members = defaultdict(list)
    for c, ts in paths.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, ms in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(ms) - 1) * len(node[-1][1].encode()) if node else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(ms), len(n), min(members[n[:-1]]) if n else -1, len(ms), kids[n], leaves[n], saved[n], sha([c for c in ms if len(paths[c]) == len(n)])) for n, ms in members.items())


def some_turns():
    rng = random.Random(5)
    hot = ("system", "Be brief.")
    turns = [(0, None, None, None), (0, None, None, None), (0, 1, "user", "é" * 300), (None, 1, "user", "nobody's"), (3, 0, "user", "x" * 100_000), (4, 2, "b", "2"), (4, 2, "a", "1"), (4, 2, "b", "1")]
    for c in range(5, 120):
        if c % 10 == 0:
            continue  # their turns are asked for, but they do not exist
        start = [hot] * rng.randrange(2) + [("user", rng.choice("abc"))] * rng.randrange(3)
        turns += [(c, i, r, x) for i, (r, x) in enumerate(start + [(rng.choice(["user", None]), rng.choice(["same", "other", "", None])) for _ in range(rng.randrange(1, 12))])]
    turns += [(c, i, "user", f"copied {i}") for c in range(200, 230) for i in range(1 + c % 20)]  # logged turn by turn
    rng.shuffle(turns)
    return turns


@pytest.mark.parametrize("splice,share", [(True, 10), (False, 10_000)])
def test_trie_equals_brute_force(spark, splice, share):
    turns = some_turns()
    df = spark.createDataFrame([(*t, 1, 2) for t in turns], "conv_id long, turn long, role string, text string, k int, depth int").repartition(7)
    c = F.col("c")
    cols = (c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9) if splice else None
    got = prefix_trie.prefix_trie(df, splice=cols, share=share).select(*TRIE).fillna(-1, ["parent_conv_id"]).collect()
    assert sorted(map(tuple, got)) == brute_trie(turns, splice)


def test_a_conversation_over_many_tasks_and_common_names(spark, monkeypatch):
    """With one base of 1, prefixes with the same turns in another order have one name: another base is taken."""
    turns = [(1, i, "user", str(i % 3)) for i in range(900)] + [(2, i, "user", str(i % 3)) for i in range(700)] + [(3, 0, "user", "1"), (3, 1, "user", "0"), (3, 2, "user", "2")]
    monkeypatch.setattr(prefix_trie, "BASES", ((1, 1), *prefix_trie.BASES[:1]))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
        got = prefix_trie.prefix_trie(df).select(*TRIE).fillna(-1, ["parent_conv_id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got)) == brute_trie(turns, False)
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []


def test_trie_query(spark, tmp_path):
    turns = some_turns()
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.op11_prefix_trie(spark, str(tmp_path)).select(*TRIE).fillna(-1, ["parent_conv_id"]).collect()
    assert sorted(map(tuple, got)) == brute_trie(turns, True)


def test_slots_are_perfect_and_strangers_have_none():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, (5000, 2), np.uint64), axis=0)
    table = prefix_trie.PerfectHash(keys)
    assert sorted(table.slots(keys)) == list(range(len(keys))) and (table.slots(keys + np.uint64(1)) == -1).all()
    assert len(prefix_trie.PerfectHash(keys[:0]).slots(keys[:3])) == 3
    with pytest.raises(ValueError):
        prefix_trie.PerfectHash(keys[[0, 1, 0]])


def near_texts():
    rng = random.Random(11)
    texts = [None, "", " \t\n", "One", "one", "one two three", "ONE  two three", "one two three four", "Été été", "été Été"]
    for n in (5, 8, 11, 12, 24, 60, 200, 900):
        base = " ".join(rng.choice(WORDS) for _ in range(n))
        texts += [base, base.upper()] + [edited(rng, base, k) for k in (1, 1, 2, max(1, n // 60), max(1, n // 40), max(2, n // 20))]
    texts += [" ".join(WORDS[:40] + [x]) for x in WORDS[41:60]]  # a template with one word of its own
    return texts + ["word " * 60_000 + "end"]


def test_near_sets_equal_brute_force(spark):
    texts = dict(enumerate(near_texts()))
    sets = {k: shingle_set(t) for k, t in texts.items()}
    linked = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    want = {k: (len(sets[k]), c, k == c) for k, c in least_reachable(list(texts), linked).items()}
    df = spark.createDataFrame([(k, t, 0, 0, "") for k, t in texts.items()], "doc_id long, text string, sig int, size int, Kept string")
    got = {r[0]: tuple(r)[1:] for r in minhash_dedup.near_sets(df).collect()}
    assert got == want


def test_near_sets_query_with_odd_keys(spark, tmp_path):
    long = " ".join(WORDS[:30])
    rows = [(None, long), (7, long), (7, long), (9, long + " x"), (None, "alone with no key at all here"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = minhash_dedup.op12_minhash_dedup(spark, str(tmp_path)).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == [("3", 0, 3, True), ("7", 26, 7, True), ("7", 26, 7, True), ("9", 27, 7, False), ("None", 3, None, True), ("None", 26, 7, False)]
    empty = spark.createDataFrame(rows, "doc_id long, text string").limit(0)
    assert minhash_dedup.near_sets(empty).collect() == []


def brute_lloyd(rows, dim, k, rounds):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    d = lambda v, x: sum((a - b) ** 2 for a, b in zip(v, x))
    for r in range(rounds + 1):
        near = [min(range(len(c)), key=lambda j: (d(v, c[j]), j)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), n in zip(kept, near) if n == j]
                c[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else c[j]
    return sorted((str(i), j, d(v, c[j])) for (i, v), j in zip(kept, near)), c


@pytest.mark.parametrize("block,k", [(5, 3), (64, 400)])
def test_lloyd_equals_brute_force(spark, block, k):
    rng = random.Random(3)
    vec = lambda n: [rng.uniform(-0.3, 0.3) for _ in range(n)]
    rows = [(i, vec(20)) for i in range(150)] + [(7, vec(20)), (None, vec(20)), (500, [0.5] * 20), (501, [0.5] * 20)] + [(600 + i, [0.25] * 20) for i in range(60)]
    rows += [(900, None), (901, []), (902, vec(19)), (903, [None] + vec(19)), (904, [float("nan")] + vec(19)), (905, [float("-inf")] + vec(19)), (906, [1000.5] + vec(19))]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, chunk int").repartition(5)
    found, named = centroids.lloyd(df, dim=20, k=k, block=block)
    want, c = brute_lloyd(rows, 20, k, 3)
    assert sorted((str(r[0]), r[1], r[2]) for r in found.collect()) == want
    assert [r["centroid"] for r in named.orderBy("cluster").collect()] == c
    assert centroids.lloyd(df.limit(0), dim=20)[0].collect() == []


def test_clustering_query_counts_its_inertia(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(64)]) for i in range(90)] + [(90, [0.0] * 63)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.op13_centroid_clustering(spark, str(tmp_path)).collect()
    want, c = brute_lloyd(rows, 64, 16, 3)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == want
    assert {r["inertia"] for r in got} == {sum(x[2] for x in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(x[2] for x in want if x[1] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()
