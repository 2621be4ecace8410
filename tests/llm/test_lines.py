"""Line dedup as a whole, and as a stage, against all pairs of lines by edit similarity."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from meridian.llm import components, line_dedup

DIR = "/root/testdata/sf0.001"


def brute(texts, min_words):
    """By (text number, line number): whether the line goes, by all pairs of normal forms; a bound from counts of characters spares most of them."""
    places = {}
    for d, t in enumerate(texts):
        for i, line in enumerate((t or "").split("\n")):
            form = line_dedup.normal(line.encode()).decode()
            if len(form.split(" ")) >= min_words and form:
                places.setdefault(form, []).append((d, i))
    forms = sorted(places)
    size, counts = np.array([len(f) for f in forms]), np.zeros((len(forms), 64), np.int32)
    for k, f in enumerate(forms):
        np.add.at(counts[k], [ord(c) % 64 for c in f], 1)
    up = list(range(len(forms)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k in range(len(forms)):
        most = np.maximum(size[k], size[:k])
        apart = np.maximum(np.abs(size[:k] - size[k]), np.abs(counts[:k] - counts[k]).sum(axis=1) / 2)
        for j in np.flatnonzero(apart <= 0.2 * most + 1e-9):
            if root(j) != root(k) and 1 - line_dedup.levenshtein(forms[j], forms[k]) / most[j] >= 0.8 - 1e-12:
                up[max(root(j), root(k))] = min(root(j), root(k))
    groups = {}
    for k, f in enumerate(forms):
        groups.setdefault(root(k), []).extend(places[f])
    return {p for ps in groups.values() for p in sorted(ps)[1:]}


@pytest.mark.parametrize("min_words", [1])
def test_lines_that_go_equal_all_pairs(spark, min_words):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet' ORDER BY doc_id").fetchall()
    gone = brute([t for _, t in rows], min_words)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=min_words).collect()}
    removed = sum(r["n_removed"] for r in got.values())
    assert 0.95 * len(gone) <= removed <= len(gone)
    whole = 0
    for d, (i, t) in enumerate(rows):
        mine = [n for n in range(len((t or "").split("\n"))) if (d, n) in gone]
        assert got[i]["n_removed"] <= len(mine)
        if got[i]["n_removed"] == len(mine):
            whole += 1
            if t is not None:
                assert got[i]["text"] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in set(mine))
    assert whole >= 0.95 * len(rows)


def test_query_gives_digests_of_what_is_left(spark, tmp_path):
    texts = ["one line of some words\nsecond", "One line of some words!\nthird", None, "second"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["n_bytes"], r["kept_sha256"]) for r in line_dedup.op4_line_dedup(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {0: (0, 29, sha(texts[0])), 1: (1, 5, sha("third")), 2: (0, None, None), 3: (1, 0, sha(""))}


def test_distances_side_by_side_equal_one_by_one():
    rng, a, b = random.Random(3), [], []
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for letters in ("ab", "abcdefgh ", "abcdefghijklm nopqrs\0", "aé漢b", "".join(map(chr, range(200, 600)))):
        for n in (0, 1, 5, 63, 64, 65, 130, 300):
            for _ in range(30):
                x = some(n, letters)
                y = list(x)
                for _ in range(int(n * rng.random() * 0.3)):
                    i = rng.randrange(len(y) + 1)
                    y[i : i + rng.randrange(3)] = some(rng.randrange(4), letters)
                a.append(x)
                b.append("".join(y) if rng.random() < 0.9 else some(n, letters))
    for least in (0.6, 0.8, 0.95):
        want = [line_dedup.levenshtein(x, y) <= int((1 - least) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b)]
        assert line_dedup.all_edit_similar(a, b, least).tolist() == want and 300 < sum(want) < len(want)


def test_rows_that_the_shown_ones_connect_are_not_compared_again(spark):
    """Two shards of the same rows: 1 links with 2 to 40, which link with all others; the others do not link with each other."""
    asked = []

    def decided(pairs):
        asked.append(sorted(map(tuple, pairs.select("a", "b").collect())))
        return pairs.where("a = 1 AND b <= 40 OR a BETWEEN 2 AND 40 AND b > 40").select("a", "b")

    shards = spark.sql("SELECT s, id AS sig, 10 AS size, 0L AS fp FROM range(1, 61) CROSS JOIN (SELECT explode(array(7L, 8L)) AS s)")
    links = components.linked_in_shards(shards, decided, 0.8, 3, 1024)
    assert {r["component"] for r in components.components(links).collect()} == {1}
    assert all(len(x) == len(set(x)) for x in asked) and sum(map(len, asked[2:])) == 0


@pytest.mark.parametrize("block", [256, 40, 2])
def test_lines_of_one_passage_are_compared_beside_each_other(spark, monkeypatch, block):
    """Lines that share a long passage, most too different to link: no table of their pairs is made, and the links are those of all pairs that meet."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage = some(70)
    heads = [some(rng.randrange(8, 40)) for _ in range(110)]
    heads += [" ".join([*h.split()[:-2], word(), word()]) for h in heads[:20]]
    docs = spark.createDataFrame([(i, f"{h} {passage}") for i, h in enumerate(heads)], "doc_id long, text string")
    plain, asked = components.linked_in_shards, []

    def links(shards, decided, *args, beside=None, **kwargs):
        def counted(pairs):
            asked[-1].append(pairs.count())
            return decided(pairs)

        asked.append([])
        return plain(shards, counted, *args, **kwargs, **({} if len(asked) == 2 else {"beside": beside}))

    monkeypatch.setattr(line_dedup, "linked_in_shards", links)
    monkeypatch.setattr(components, "BLOCK", block)
    ours, by_pairs = (sorted(map(tuple, line_dedup.dedup_lines(docs).collect())) for _ in range(2))
    assert ours == by_pairs and 20 <= sum(r[-1] for r in ours) < len(heads)
    assert sum(asked[0]) <= 25 * len(heads) and sum(asked[0]) < sum(asked[1])
    if block == 256:
        assert len(asked[0]) == 1 and sum(asked[0]) <= 10 * len(heads)


def test_a_set_of_lines_comes_once_whatever_its_keys(monkeypatch):
    import pyarrow as pa

    from meridian.llm.shared import pack

    monkeypatch.setattr(line_dedup, "CHUNK", 2)
    members = {1: [7, 8, 9], 2: [7, 8, 9], 3: [7, 8], 4: [5], 5: [2**63 + 1, 3]}
    key, sig = (np.array(x, np.uint64) for x in zip(*((k, s) for k, ms in members.items() for s in sorted(ms))))
    sets = line_dedup._meetings((0,), pa.table({"packed": [pack(key, sig)]}))
    got = {}
    for batch in line_dedup._sets(iter((sets.to_batches() * 2))):
        for s, n, least, x in zip(*(c.to_pylist() for c in batch.columns)):
            got.setdefault((s, n, least), []).append(x)
    assert sorted((n, least, sorted(x)) for (_, n, least), x in got.items()) == [(2, 1 - 2**63, [1 - 2**63, 3]), (2, 7, [7, 8]), (3, 7, [7, 8, 9])]


def test_lines_of_a_text_are_normal_as_each_by_itself():
    rng = random.Random(1)
    for _ in range(500):
        t = bytes(rng.choice(b" \n\t\r.,aZ9\xc3\xa9  \n") for _ in range(rng.randrange(40)))
        assert line_dedup.normal_lines(t) == [line_dedup.normal(x) for x in t.split(b"\n")]
