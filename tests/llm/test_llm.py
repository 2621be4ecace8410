"""Small brute-force checks of the training-data operators, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import byte_bpe, hamming, ibl_sketch, importance, line_dedup, media, mixing, ngram_lm, simhash_dedup, suffix_dedup, url_filter, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source=None):
    rows = [(i, t, "en", (source or {}).get(i, "s0"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


TEXTS = ["the cat sat", "", None, "The  CAT\tsat", "x" * 3000 + " " + "y z " * 500, "a b c d e f g", "é ü ñ 中文 😀 words", "one"]


def test_word_hashes_follow_the_words():
    h, _ = words.word_hashes("The cat\vthe  CAT dog".encode())
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    long = ("ab " * 900_000).encode()
    got = list(words.docs_hashes([b"ab", long, b""]))
    assert sum(len(x[1]) for x in got) == 900_001 and len({int(v) for x in got for v in x[1]}) == 1


def test_scores_match_brute_force_over_many_buckets(spark):
    texts = ["a b a c", "b a b", "c", "", None, "a b c a b", "d d d a"]
    d = docs(spark, texts)
    model = ngram_lm.fit(d, buckets=5)
    got = {r.doc_id: r for r in ngram_lm.score(d, model).collect()}
    seq = {i: (t or "").split() + ["</s>"] for i, t in enumerate(texts)}
    c = collections.Counter(w for s in seq.values() for w in s)
    pairs = collections.Counter(p for s in seq.values() for p in zip(["<s>", *s], s))
    cont = collections.Counter(b for _, b in pairs)
    n = lambda counts: tuple(sum(v == k for v in counts.values()) for k in (1, 2, 3, 4))
    d2, d1 = ngram_lm.discounts(n(pairs)), ngram_lm.discounts(n(cont))
    every = len(pairs)
    g1 = sum(d1[min(v, 3)] for v in cont.values()) / every

    def p(v, w):
        low = max(cont[w] - d1[min(cont[w], 3)], 0) / every + g1 / (len(c) + 1)
        total = sum(k for (a, _), k in pairs.items() if a == v)
        return max(pairs[v, w] - d2[min(pairs[v, w], 3)], 0) / total + sum(d2[min(k, 3)] for (a, _), k in pairs.items() if a == v) / total * low

    for i, s in seq.items():
        assert got[i].n_tokens == len(s) == got[i].n_known
        assert math.isclose(got[i].score, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *s], s)), rel_tol=1e-9)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (sum(c.values()) + len(c) + 1)) for w in s), rel_tol=1e-9)
    assert math.isclose(sum(p("a", w) for w in c) + g1 / (len(c) + 1) * sum(d2[min(k, 3)] for (a, _), k in pairs.items() if a == "a") / sum(k for (a, _), k in pairs.items() if a == "a"), 1, rel_tol=1e-9)


def test_flow_of_overlapping_sources_is_cheapest():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 25, "b": 15}, 3)
    sent = {p: sum(f.values()) for p, f in flow.items()}
    assert sum(f.get("a", 0) for f in flow.values()) == 25 and sum(f.get("b", 0) for f in flow.values()) == 15
    cost = sum(sum(max(0, min(n, (r + 1) * c) - r * c) * r for r in range(3)) for c, n in ((10, sent["a",]), (10, sent["a", "b"]), (5, sent["b",])))
    assert cost == 15  # 25 words cost nothing and 15 are repeated once
    assert mixing.water_fill([10, 100], [1, 1], 110, 3) == [30.0, 80.0]


def test_mix_comes_near_its_targets(spark):
    texts = ["w " * (1 + i % 7) for i in range(300)] + [None, ""]
    d = docs(spark, texts, {i: "s%d" % (i % 3) for i in range(300)})
    got = mixing.mix_documents(d).collect()
    by = collections.defaultdict(int)
    for r in got:
        by[r.source] += r.taken
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
    assert all(abs(by[r.source] - r.target) <= 7 for r in got)
    assert sorted(got) == sorted(mixing.mix_documents(d).collect())
    assert mixing.mix_documents(d.limit(0)).count() == 0


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def test_chunks_encode_as_the_whole(spark, ranks):
    enc = byte_bpe.encoding(*ranks)
    texts = [*TEXTS, "it's we're " * 40, "word" * 60, " " * 90 + "end", "a" * 500 + " 12'll " + "'" * 70 + "s", "\n \t mixed　" * 30]
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs(spark, texts), *ranks, chunk=40, overlap=12).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]) == enc.encode_ordinary(t or "")
    back = byte_bpe.encoded_digests(docs(spark, TEXTS), *ranks).collect()
    assert all(r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest() for r in back) and len(back) == len(TEXTS)


def test_url_rules_and_method(spark):
    urls = ["http://A.net/x", "https://x.example.net/en/1", "http://q.example.com/de/9?z", "//none", None, "ftp://b.org/fr/", "http://net", "http://good.org/fr/abc", "http://w.net/spam", "http://c.example.com/fr/7#h"]
    p = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int").withColumnRenamed("host", "extra")
    got = {r.page_id: r for r in url_filter.judge(p).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.net", "/x", "net/", "block")
    assert got[1].rule == "example.net/en/" and got[2].verdict == "block" and got[3].host == "" == got[4].host and got[5].rule == "org/fr/" and got[6].rule is None
    assert all(r.verdict in ("allow", "block") for r in got.values()) and url_filter.judge(p.limit(0)).count() == 0


def test_media_round_trip(spark):
    got = {r.doc_id: r for r in media.with_media(docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        assert bytes(got[i].payload) == raw + b" " * (len(got[i].payload) - len(raw)) and len(got[i].payload) % 192 == 0 and len(got[i].payload) > 0
        assert list(got[i].codes) == sorted(got[i].codes)
    assert got[1].codes == got[2].codes


def components(n, linked):
    up = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    return up


@pytest.mark.parametrize("limit", [4096, 3])
def test_hamming_links_connect_what_is_near(spark, limit):
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 1 << 63, 12)]
    values = sorted({b ^ sum(1 << int(k) for k in r.integers(0, 64, n)) for b in base for n in (0, 1, 2, 3, 4)})
    f = spark.createDataFrame([(hamming.signed(v), i) for i, v in enumerate(values)], "fp long, id long")
    from meridian.llm.components import components as linked

    got = dict(enumerate(range(len(values)))) | {x.id: x.component for x in linked(hamming.links(f, 2, 3, limit=limit)).collect()}
    assert [got[i] for i in range(len(values))] == components(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 2)


def test_near_duplicates_and_the_one_that_stays(spark):
    long = " ".join(f"w{i}" for i in range(200))
    texts = [long, long.replace("w7 ", "x7 "), "quite another text", long, None, "", "short"]
    d = docs(spark, texts)
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(d).collect()}
    assert got[3] == got[0] == 0 and got[4] == got[5] == 4 and got[2] == 2
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(d).collect()) == [0, 2, 4, 6]
    assert simhash_dedup.keep_one(d.union(d)).count() == 4 and simhash_dedup.keep_one(d.limit(0)).count() == 0
    assert {r.doc_id for r in simhash_dedup.near_copies(d, limit=1).where("component_id = 0").collect()} == {0, 1, 3}


def test_a_large_shard_of_short_texts_stays_whole(spark):
    start = " ".join(f"word{i}" for i in range(23))
    d = docs(spark, [f"{start} id{i}" for i in range(3000)] + [f"quite another {i} {i * 7} text of some words" for i in range(50)])
    assert simhash_dedup.near_copies(d, limit=100).where("component_id = 0").count() == 3000
    assert simhash_dedup.keep_one(d, similar=0.9).count() == 51


def test_copies_are_those_of_all_their_shingles(spark):
    r = np.random.default_rng(3)
    texts = []
    for k, n in enumerate((8, 24, 120, 300, 300, 500)):
        base = [f"w{k}x{i}" for i in range(n)]
        for _ in range(20):
            edited = list(base)
            for i in r.integers(0, n, max(1, n // int(r.integers(30, 70)))):
                edited[i] = f"e{r.integers(1 << 40)}"
            texts.append(" ".join([*edited, *["tail"] * int(r.integers(0, 2))]))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    want = components(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert len(set(want)) > 20
    got = {x.doc_id: x.component_id for x in simhash_dedup.near_copies(docs(spark, texts), limit=7).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_fuzzy_lines(spark):
    line = "this line of text is long enough to be compared with others of its kind today"
    texts = [f"{line}\nkept as it is", f"first here now and only here\n{line.replace('long', 'lang')}!", line.upper(), None, "short\nshort", f"{line}\n{line}"]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[1].text == "first here now and only here" and got[2].text == "" and got[3].text is None
    assert got[4].text == texts[4] and got[5].text == "" and got[5].n_removed == 2
    assert line_dedup.dedup_lines(docs(spark, []) if False else docs(spark, ["a"]).limit(0)).count() == 0
    assert line_dedup.levenshtein("kitten", "sitting") == 3 and line_dedup.levenshtein("", "abc") == 3 and not line_dedup.edit_similar("abcdefghij", "abcdeXYZij")


@pytest.mark.parametrize("n", [5, 6, 10, 20, 40, 80])
def test_lines_with_an_edited_word_meet(n):
    r = np.random.default_rng(n)
    word = lambda: "".join(r.choice(list("abcdefghijklmno"), int(r.integers(3, 9))))
    lines, pairs = [], 0
    for k in range(300):
        a = [word() for _ in range(n)]
        b = list(a)
        for i in r.choice(n, max(1, n // 10), replace=False):
            b[i] = word()
        if line_dedup.edit_similar(" ".join(a), " ".join(b)):
            lines += [" ".join(a).encode(), " ".join(b).encode()]
            pairs += 1
    keys, of = line_dedup.line_keys(lines, 5)
    under = [set() for _ in lines]
    for key, i in zip(keys.tolist(), of.tolist()):
        under[i].add(key)
    assert pairs > 50 and sum(bool(under[2 * i] & under[2 * i + 1]) for i in range(pairs)) >= 0.98 * pairs
    assert sum(bool(under[2 * i] & under[2 * i + 2]) for i in range(pairs - 1)) == 0


def test_many_lines_of_one_fingerprint_end(spark):
    names = ["".join(chr(97 + i // 17**k % 17) for k in range(3)) for i in range(4500)]
    d = docs(spark, ["\n".join("same " * 8 + x for x in names[i : i + 90]) for i in range(0, 4500, 90)])
    assert line_dedup.dedup_lines(d).agg(F.sum("n_removed")).first()[0] == 4499


def test_sketch_recovers_likeness(spark):
    texts = ["\n".join(f"p{i}" for i in range(a, b)) for a, b in ((0, 300), (100, 420), (0, 3), (0, 0), (5, 6))] + [None]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in ibl_sketch.compare(ibl_sketch.with_edits(d.union(d.where("doc_id = 2"))), "doc_id", "n_chars", "edited").collect()}
    sets = [set((t or "").split("\n")) - {""} for t in texts]
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert got[i].edited == edited
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert math.isclose(got[i].near_next, like(sets[i], sets[(i + 1) % len(texts)])) and math.isclose(got[i].near_edited, like(sets[i], set(edited.split("\n")) - {""}))
    assert got[3].fingerprint == got[5].fingerprint


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeated_strings_go(spark, hot):
    r = np.random.default_rng(2)
    word = lambda n: "".join(r.choice(list("abcdé "), n))
    a, b = word(90), word(70)
    texts = [word(50) + a + word(20), a + b, word(30) + b + a[:60], None, "", "ab" * 60, word(200), "q" * 45, word(10) + a + word(5)]
    n, raw = 40, [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(docs(spark, texts), length=n, gram=24, hot=hot).collect()}
    for k, t in enumerate(raw):
        gone = {j for i in range(len(t) - n + 1) if seen[t[i : i + n]] > 1 for j in range(i, i + n)}
        assert bytes(got[k].kept) == bytes(c for j, c in enumerate(t) if j not in gone)
        assert got[k].n_removed == len(gone) and got[k].n_spans == sum(j - 1 not in gone for j in gone)
    assert suffix_dedup.remove_repeats(docs(spark, texts).limit(0)).count() == 0


def test_resampling_keeps_what_looks_like_the_target(spark):
    good = [f"Words of plain prose number {i} follow each other here, and end." for i in range(60)]
    bad = [f"BUY!! NOW!! {i}!! CHEAP!! CLICK!!" for i in range(20)]
    d = docs(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in importance.resample(d, labels, share=0.75).collect()}
    assert sum(got[i].kept for i in range(60)) >= 59 and not any(got[i].kept for i in range(60, 80)) and got[80].n_features == 0
    assert importance.resample(d, labels.limit(0)).where("NOT kept").count() == 0 and importance.resample(d.limit(0), labels).count() == 0
    assert importance.kth_highest(spark.createDataFrame([(v,) for v in (-5, 3, 3, 9)], "v long"), "v", 2) == 3


def test_pipeline_runs_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [*TEXTS, *(f"plain text number {i} with some more words in it" for i in range(12))]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and set(out[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
