"""Near copies, fingerprints and fuzzy lines against brute force."""

import random
import re

import xxhash

from meridian.llm import line_dedup, simhash_dedup

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti") for b in ("n", "r", "s", "l", "nda", "rio", "stem", "lk")]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text, width=5):
    w = words(text)
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def least_reachable(keys, linked):
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in keys}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[rng.choice(WORDS)], [], [w[i], rng.choice(WORDS)]])
    return " ".join(w)


def some_texts():
    rng = random.Random(4)
    texts = [None, "", " \t\n", "One", "one", "one two three", "ONE  two three"]
    for n in (4, 5, 8, 9, 24, 60, 200, 900):
        base = " ".join(rng.choice(WORDS) for _ in range(n))
        texts += [base] + [edited(rng, base, k) for k in (1, 1, 2, max(1, n // 60), max(1, n // 40), max(2, n // 20))]
    texts += [" ".join(WORDS[:23] + [x]) for x in WORDS[30:60]]  # a template with one word of its own
    return texts


def test_near_copies_equal_brute_force_whatever_the_limit(spark):
    texts = dict(enumerate(some_texts()))
    sets = {k: shingle_set(t) for k, t in texts.items()}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return len(x & y) >= 0.8 * len(x | y) - 1e-9

    want = least_reachable(list(texts), linked)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for limit in (1, 1024):
        assert {r[0]: r[1] for r in simhash_dedup.near_copies(docs, limit=limit).collect()} == want
    kept = simhash_dedup.keep_one(docs.selectExpr("*", "1 AS k", "2 AS _k", "3 AS sig"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == ["doc_id", "text", "k", "_k", "sig"]
    assert simhash_dedup.keep_one(docs.limit(0)).count() == 0


def test_fingerprints_and_components_equal_brute_force(spark):
    texts = dict(enumerate(some_texts()))

    def fingerprint(text):
        w = words(text)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {k: fingerprint(t) for k, t in texts.items()}
    want = least_reachable(list(texts), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash_dedup.near_duplicates(docs).collect()}
    assert got == {k: (fp[k], want[k]) for k in texts}
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def lines_that_meet(forms):
    out = [set() for _ in forms]
    for k, i in zip(*(x.tolist() for x in line_dedup.line_keys(forms, 1))):
        out[i].add(k)
    return out


def test_recall_of_lines_of_documents(spark):
    """Of all pairs of lines of the smallest documents with edit similarity 0.8 or more, at least 0.9 meet."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    forms = sorted({line_dedup.normal(x) for t in texts if t for x in t.encode().split(b"\n")} - {b""}, key=len)
    plain, meet = [x.decode("utf-8", "replace") for x in forms], lines_that_meet(forms)
    bag = [line_dedup.np.bincount(line_dedup.np.frombuffer(x, line_dedup.np.uint8), minlength=256) for x in forms]
    pairs = found = 0
    for i in range(len(forms)):
        for j in range(i):
            if len(plain[j]) < 0.8 * len(plain[i]) - 1e-9 or abs(bag[i] - bag[j]).sum() > 1.6 * len(forms[i]):
                continue
            if abs(bag[i] - bag[j]).sum() <= 0.45 * len(forms[i]) and line_dedup.edit_similar(plain[i], plain[j]):
                pairs, found = pairs + 1, found + bool(meet[i] & meet[j])
    assert pairs > 20 and found >= 0.9 * pairs


def test_recall_of_lines_by_edit():
    """One word replaced, dropped or added, or one letter: at least 0.93 of the similar pairs meet, at any length."""
    rng = random.Random(7)
    for n in (4, 5, 8, 10, 12, 16, 20, 30, 40, 60, 80):
        meet = similar = 0
        for _ in range(150):
            w = [rng.choice(WORDS) + rng.choice(["", "", "t", "ing", "eru"]) for _ in range(n)]
            v, i = list(w), rng.randrange(n)
            v[i : i + 1] = rng.choice([[rng.choice(WORDS)], [], [w[i], rng.choice(WORDS)], [w[i][:-1] + "x"]])
            a, b = " ".join(w), " ".join(v)
            if a != b and line_dedup.edit_similar(a, b):
                x, y = lines_that_meet([a.encode(), b.encode()])
                similar, meet = similar + 1, meet + bool(x & y)
        assert meet >= 0.93 * similar, n


def test_lines_of_one_template_and_hot_lines(spark):
    """Many variants of a line, met in one large shard, leave one; a line in many documents stays once; short ones too if asked."""
    base = " ".join(WORDS[:30])
    variants = [" ".join(WORDS[:29] + [w]) for w in WORDS]
    rows = [(i, f"{v}\nmenu\n{'own words of ' + ' '.join(WORDS[i:i + 9][::-1])}") for i, v in enumerate([base, *variants])] + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, base), (1003, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _key", "2 AS _lines", "3 AS n_removed", "4 AS h")
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, min_words=1).collect()}
    assert out[0]["text"] == rows[0][1] and all(base[:50] not in out[i]["text"] and "menu" not in out[i]["text"] for i in range(1, len(variants) + 1))
    assert out[1000]["text"] is None and out[1001]["text"] == "" and out[1002]["text"] == "\n\n" and out[1003]["text"] == "" and out[0]["h"] == 4
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert "menu" in kept[5]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
