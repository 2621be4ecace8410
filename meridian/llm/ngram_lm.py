"""Language-model scoring: interpolated modified Kneser-Ney bigrams, counted in Spark, read through memory maps.

Counting has three shuffles, all of packed blocks of (hash, count) arrays that each task has already summed:
words, bigrams (dealt by their first word, and the bigrams of very frequent words also by the second), and what
each word needs to know of its bigrams (as context: tokens and types by count; as successor: distinct contexts).
Each reducing task writes its range as sorted hash arrays into the shared folder. Scoring tasks memory-map these
and look up sorted blocks of queries, so their memory does not grow with the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.shared import get_array, pack, put_arrays, shared_dir, small_batches, text_bytes, unpack
from meridian.llm.words import U, bucket_of, docs_hashes, encoded, pair, summed

START, END = U(1), U(2)  #: stand for the start of a text and its end token
KEEP = 3_000_000  #: entries that a counting task holds before it sends them on
BLOCK = "bucket int, payload binary"


@dataclass(frozen=True)
class NgramModel:
    """Where the arrays are, and the totals over the training texts."""

    folder: str
    buckets: int
    hot: tuple[int, ...]
    tokens: int
    vocabulary: int
    by_count: tuple[int, ...]  #: bigrams seen 1, 2, 3, 4 times
    by_contexts: tuple[int, ...]  #: words with 1, 2, 3, 4 distinct contexts, then the sum of all
    context_types: tuple[int, ...]  #: words with 1, 2, 3 or more distinct contexts


def discounts(n: tuple[int, ...]) -> np.ndarray:
    """D(0) = 0, D(1), D(2), D(3 or more) from the numbers of n-grams seen 1 to 4 times; 0.5 each where one of them is 0."""
    if min(n[:4]) == 0:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), i) for i in (1, 2, 3)])


def _sequences(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """docs_hashes with the end token after each text: block start, tokens, the token before each, tokens in each text."""
    for at, h, n in docs_hashes(texts):
        tokens = np.insert(h, np.cumsum(n), END)
        before = np.concatenate(([START], tokens[:-1]))
        before[np.cumsum(n + 1)[:-1]] = START
        yield at, tokens, before, n + 1


def _blocks(bucket: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    """Rows of BLOCK from arrays whose bucket rises."""
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*cut[1:], len(bucket)]
    return pa.record_batch({"bucket": pa.array(bucket[cut].astype(np.int32)), "payload": pa.array([pack(*(a[i:j] for a in arrays)) for i, j in zip(cut, ends)], pa.binary())})


def _count_words(buckets: int):
    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for _, tokens, _, _ in _sequences(encoded(batch.column(0))):
                held.append(summed(tokens, np.ones(len(tokens), np.uint64)))
                if sum(len(x[0]) for x in held) > KEEP:
                    held = [summed(*map(np.concatenate, zip(*held)))]
                    if len(held[0][0]) > KEEP // 2:
                        yield _blocks(bucket_of(held[0][0], buckets), *held.pop())
        if held:
            h, c = summed(*map(np.concatenate, zip(*held)))
            yield _blocks(bucket_of(h, buckets), h, c)

    return run


def _join_words(folder: str):
    def run(key, group):
        h, c = summed(*map(np.concatenate, zip(*(unpack(x) for x in group["payload"].to_pylist()))))
        put_arrays(f"{folder}/count", str(key[0].as_py()), h=h, c=c)
        top = np.argsort(c)[-64:]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "tokens": [int(c.sum())], "words": [len(h)], "top": pa.array([h[top].view(np.int64).tolist()], pa.list_(pa.int64())), "top_count": pa.array([c[top].astype(np.int64).tolist()], pa.list_(pa.int64()))})

    return run


def _deal(v: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a bigram: its first word's, but for a hot first word that of the pair."""
    b = bucket_of(v, buckets)
    if len(hot):
        is_hot = np.isin(v, hot)
        b[is_hot] = bucket_of(pair(v[is_hot], w[is_hot]), buckets)
    return b


def _count_bigrams(buckets: int, hot: tuple[int, ...]):
    def run(batches):
        heavy = np.array(hot, np.uint64)
        held: list[list[np.ndarray]] = []

        def merged():
            v, w, c = map(np.concatenate, zip(*held))
            order = np.argsort(pair(v, w))
            v, w, c = v[order], w[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
            return [v[first], w[first], np.add.reduceat(c, first)]

        def sent(v, w, c):
            b = _deal(v, w, heavy, buckets)
            order = np.lexsort((v, b))
            return _blocks(b[order], v[order], w[order], c[order])

        for batch in batches:
            for _, tokens, before, _ in _sequences(encoded(batch.column(0))):
                held.append([before, tokens >> U(16), np.ones(len(tokens), np.uint32)])
                if sum(len(x[0]) for x in held) > KEEP:
                    held = [merged()]
                    if len(held[0][0]) > KEEP * 2 // 3:
                        yield sent(*held.pop())
        if held:
            yield sent(*merged())

    return run


def _join_bigrams(folder: str, buckets: int):
    """Writes the bucket's bigrams; sends on, to the bucket of each word, what it has as a context and as a successor."""

    def run(key, group):
        v, w, c = map(np.concatenate, zip(*(unpack(x) for x in group["payload"].to_pylist())))
        g = pair(v, w)
        order = np.argsort(g)
        g, v, w, c = g[order], v[order], w[order], c[order].astype(np.uint64)
        if len(g):
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            g, v, w, c = g[first], v[first], w[first], np.add.reduceat(c, first)
        big = c >= 255
        put_arrays(f"{folder}/pairs", str(key[0].as_py()), g=g, c=np.where(big, 255, c).astype(np.uint8), big_g=g[big], big_c=c[big])
        one = np.ones(len(v), np.uint64)
        ctx = summed(v, c, *((c == i).astype(np.uint64) for i in (1, 2)), (c >= 3).astype(np.uint64))
        suc = summed(w << U(16), one)
        parts = [("c", _blocks(bucket_of(ctx[0], buckets), *ctx)), ("w", _blocks(bucket_of(suc[0], buckets), *suc))]
        n = np.array([np.count_nonzero(c == i) for i in (1, 2, 3, 4)], np.uint64)
        rows = [(k, b, p) for k, x in parts for b, p in zip(x["bucket"].to_pylist(), x["payload"].to_pylist())] + [("n", key[0].as_py(), pack(n))]
        kinds, bs, ps = zip(*rows)
        return pa.table({"kind": pa.array(kinds, pa.string()), "bucket": pa.array(bs, pa.int32()), "payload": pa.array(ps, pa.binary())})

    return run


def _join_facts(folder: str):
    """Writes the bucket's words with all their counts; returns sums over them."""

    def run(key, group):
        name = str(key[0].as_py())
        by = {k: [unpack(p) for kind, p in zip(group["kind"].to_pylist(), group["payload"].to_pylist()) if kind == k] for k in "cwn"}
        n = sum((x[0] for x in by["n"]), np.zeros(4, np.uint64))
        facts = np.zeros((0, 4), np.uint64)
        h = np.zeros(0, np.uint64)
        if by["c"]:
            h, *sums = summed(*map(np.concatenate, zip(*by["c"])))
            facts = np.stack(sums, 1)
        words, count = get_array(f"{folder}/count", name, "h"), get_array(f"{folder}/count", name, "c")
        every = np.union1d(words, h)  # the start of a text is a context but not a word
        table = np.zeros((len(every), 6), np.uint64)
        table[np.searchsorted(every, words), 0] = count
        table[np.searchsorted(every, h), 2:6] = facts
        if by["w"]:
            w, a = summed(*map(np.concatenate, zip(*by["w"])))
            at = np.minimum(np.searchsorted(w, every >> U(16) << U(16)), len(w) - 1)
            found = (w[at] == every >> U(16) << U(16)) & (table[:, 0] > 0)
            table[found, 1] = a[at[found]]
        put_arrays(f"{folder}/words", name, h=every, facts=table)
        a = table[table[:, 0] > 0, 1]
        out = [*n.tolist(), *(int(np.count_nonzero(a == i)) for i in (1, 2, 3, 4)), int(a.sum()), int(np.count_nonzero(a >= 3))]
        return pa.table({"sums": pa.array([[int(x) for x in out]], pa.list_(pa.int64()))})

    return run


def fit(docs: DataFrame, text: str = "text", bytes_per_bucket: int = 16 << 20, buckets: int | None = None) -> NgramModel:
    """Count the texts of docs (null: empty). The driver receives one row of totals from each bucket."""
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    folder = shared_dir(spark)
    texts = docs.select(F.col(text).alias("text"))
    buckets = buckets or max(1, -(-text_bytes(texts) // bytes_per_bucket))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))  # empty buckets get files too
    none = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint32)]
    blocks = texts.mapInArrow(_count_words(buckets), BLOCK).union(every.withColumn("payload", F.lit(pack(*none[:2])))).repartition(buckets, "bucket")
    seen = blocks.groupBy("bucket").applyInArrow(_join_words(folder), "bucket int, tokens long, words long, top array<long>, top_count array<long>").collect()
    tokens, vocabulary = sum(r.tokens for r in seen), sum(r.words for r in seen)
    limit = max(1, tokens // (4 * buckets))
    hot = tuple(sorted({int(np.int64(h).view(np.uint64)) for r in seen for h, c in zip(r.top, r.top_count) if c > limit} | {int(START)})) if buckets > 1 else ()
    pairs = texts.mapInArrow(_count_bigrams(buckets, hot), BLOCK).union(every.withColumn("payload", F.lit(pack(*none)))).repartition(buckets, "bucket")
    facts = pairs.groupBy("bucket").applyInArrow(_join_bigrams(folder, buckets), "kind string, " + BLOCK)
    sums = facts.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_join_facts(folder), "sums array<long>").collect()
    s = [sum(r.sums[i] for r in sums) for i in range(10)]
    return NgramModel(folder, buckets, hot, tokens, vocabulary, tuple(s[:4]), (*s[4:8], s[8]), (s[4], s[5], s[9]))


def _find(folder: str, kind: str, key: str, q: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[str, np.ndarray, np.ndarray]]]:
    """For sorted (bucket, q): which are found, and by bucket the queries' numbers and their places in its arrays."""
    found, parts = np.zeros(len(q), bool), []
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i, j in zip(cut, [*cut[1:], len(q)]):
        name = str(bucket[i])
        have = get_array(f"{folder}/{kind}", name, key)
        if not len(have):
            continue
        at = np.minimum(np.searchsorted(have, q[i:j]), len(have) - 1)
        hit = np.asarray(have[at]) == q[i:j]
        found[i:j] = hit
        parts.append((name, np.arange(i, j)[hit], at[hit]))
    return found, parts


def _facts(m: NgramModel, h: np.ndarray) -> np.ndarray:
    """The six counts of each of the sorted words h; zeros for unknown ones."""
    out = np.zeros((len(h), 6))
    for name, rows, at in _find(m.folder, "words", "h", h, bucket_of(h, m.buckets))[1]:
        out[rows] = get_array(f"{m.folder}/words", name, "facts")[at]
    return out


def _pair_counts(m: NgramModel, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    g, b = pair(v, w), _deal(v, w, np.array(m.hot, np.uint64), m.buckets)
    order = np.lexsort((g, b))
    gs, out = g[order], np.zeros(len(g))
    for name, rows, at in _find(m.folder, "pairs", "g", gs, b[order])[1]:
        c = get_array(f"{m.folder}/pairs", name, "c")[at].astype(float)
        big = np.flatnonzero(c == 255)
        if len(big):
            where = np.searchsorted(get_array(f"{m.folder}/pairs", name, "big_g"), gs[rows[big]])
            c[big] = get_array(f"{m.folder}/pairs", name, "big_c")[where]
        out[order[rows]] = c
    return out


def token_scores(m: NgramModel, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: whether it is known, its add-one unigram log10 probability, and the model's log10 probability after `before`."""
    words, back = np.unique(np.concatenate((tokens, before)), return_inverse=True)
    count, contexts, total, n1, n2, n3 = _facts(m, words).T
    d1, d2 = discounts(m.by_contexts), discounts(m.by_count)
    every = max(m.by_contexts[4], 1)
    gamma1 = sum(d1[i + 1] * m.context_types[i] for i in range(3)) / every if m.by_contexts[4] else 1.0
    lower = np.maximum(contexts - d1[np.minimum(contexts, 3).astype(int)], 0) / every + gamma1 / (m.vocabulary + 1)
    gamma2 = np.where(total > 0, (d2[1] * n1 + d2[2] * n2 + d2[3] * n3) / np.maximum(total, 1), 1.0)
    base = np.log10((count + 1) / (m.tokens + m.vocabulary + 1))
    at_w, at_v = back[: len(tokens)], back[len(tokens) :]
    code = at_v.astype(np.int64) * len(words) + at_w
    codes, again = np.unique(code, return_inverse=True)
    iv, iw = codes // len(words), codes % len(words)
    c = _pair_counts(m, words[iv], words[iw] >> U(16))
    p = np.maximum(c - d2[np.minimum(c, 3).astype(int)], 0) / np.maximum(total[iv], 1) + gamma2[iv] * lower[iw]
    return count[at_w] > 0, base[at_w], np.log10(p)[again]


def score(docs: DataFrame, model: NgramModel, key: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """One row a document: key, further columns, n_tokens, n_known, base_score, score, perplexity.

    Null and empty texts have one token, the end. Rows that repeat are scored each.
    """
    keep = docs.select(F.col(key), *more)
    held, width = keep.columns, len(keep.columns)

    def run(batches):
        for batch in batches:
            got = []
            for _, tokens, before, n in _sequences(encoded(batch.column(width))):
                known, base, p = token_scores(model, tokens, before)
                cut = np.concatenate(([0], np.cumsum(n)[:-1]))
                got.append((n, np.add.reduceat(known.astype(np.int64), cut), np.add.reduceat(base, cut), np.add.reduceat(p, cut)))
            n, known, base, p = map(np.concatenate, zip(*got)) if got else [np.zeros(0)] * 4
            cols = [pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(p), pa.array(10 ** (-p / np.maximum(n, 1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *cols], names=[*held, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields), "n_tokens long, n_known long, base_score double, score double, perplexity double"])
    return docs.select(F.col(key), *more, F.col(text)).mapInArrow(run, schema)


def op3_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, scored by the model of those whose crc32(doc_id) mod 7 is not 2 (a null id counts as '')."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    model = fit(docs.where(~held_out))
    scored = score(docs, model, "doc_id", "text", held_out.alias("held_out"))
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
