"""Suffix-array dedup: bytes go that lie in a string of LENGTH bytes which starts anywhere else too.

A sort of all suffixes would move LENGTH bytes for each byte of text. So texts are first thinned without loss: of the GRAM-byte
strings in a string of LENGTH bytes, the one with the least hash is its anchor, and equal strings have equal anchors.
An anchor whose gram occurs once has no repeats around it. One whose gram always comes with the same surroundings
(the strings that it anchors, as one span) repeats as a whole. Only where the surroundings differ are suffixes sorted: cut
to LENGTH bytes, range-partitioned by sampled splitters, sorted in their bucket by multikey quicksort, equal neighbours
marked. Splitters are compared with the gram, or with the whole of a string that is dealt by itself (as those of grams with many
surroundings are), so equal strings never fall on two sides of a boundary, and long common heads do not share one bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.shared import get_array, pack, put_arrays, shared_dir, slices, small_batches, text_bytes, unpack, written
from meridian.llm.words import _INV, U, bucket_of, mix, powers, rolling

LENGTH, GRAM = 200, 128
SPAN = 1 << 19  #: window starts that are worked on at once
SAMPLE = 20_000  #: heads that splitters are drawn from, at most
KEEP = 2_000_000


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours: running minima of blocks from both ends."""
    n = len(v)
    padded = np.concatenate((v, np.full(-n % width, np.iinfo(v.dtype).max, v.dtype))).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).reshape(-1)
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each anchor: first and last start of the strings that it anchors, hash of its gram, hash of the span of those strings, its place."""
    n = len(text) - length + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64),) * 2, *(np.zeros(0, U),) * 2, np.zeros(0, np.int64))
    parts = []
    for at in range(0, n, SPAN):
        a = np.frombuffer(text, np.uint8, min(len(text), at + SPAN + length - 1) - at, at)
        p, inverse = rolling(a), powers(_INV, len(a) + 1)
        h = mix((p[gram:] - p[:-gram]) * inverse[: len(a) - gram + 1])
        place = sliding_min((h & U(~((1 << 20) - 1) & ((1 << 64) - 1))) | np.arange(len(h), dtype=U), length - gram + 1) & U((1 << 20) - 1)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(place)])) - 1
        q = place[first].astype(np.int64)
        span = mix((p[last + length] - p[first]) * inverse[first] + (q - first).astype(U) * U(0x9E3779B97F4A7C15) + (last - first).astype(U))
        parts.append((first + at, last + at, h[q], span, q + at))
    return tuple(map(np.concatenate, zip(*parts)))


HOT = 4096  #: distinct surroundings of a gram beyond which its strings are dealt one by one
SMALL = 24  #: suffixes that multikey quicksort leaves to the built-in sort
RECORD = "kind int, rk long, start long, n int, off int, body binary"


def multikey_quicksort(words: np.ndarray, pos: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """pos in the order of the strings words[pos + offsets[0]], words[pos + offsets[1]], ...

    words[i] are the eight bytes from i on as one number. Three-way partitions by one number at a time.
    """
    out, at, todo, depth = np.empty_like(pos), 0, [(pos, 0)], len(offsets)
    while todo:
        p, d = todo.pop()
        if d == depth or len(p) <= 1:
            out[at : at + len(p)] = p
            at += len(p)
            continue
        if len(p) <= SMALL:
            keys = words[p[:, None] + offsets[d:]].tolist()
            for i in sorted(range(len(p)), key=keys.__getitem__):
                out[at] = p[i]
                at += 1
            continue
        w = words[p + offsets[d]]
        pivot = np.sort(w[:: max(1, len(w) // 9)])[min(4, (len(w) - 1) // max(1, len(w) // 9) // 2)]
        less, more = w < pivot, w > pivot
        todo += [(p[more], d), (p[~(less | more)], d + 1), (p[less], d)]
    return out


def repeats_in(bodies: list[bytes], counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each string of `length` bytes (counts[i] of them in bodies[i], one a byte) occurs twice or more among all."""
    size = -(-length // 8) * 8
    buffer = np.frombuffer(b"".join(bodies) + bytes(size), np.uint8)
    wide = np.lib.stride_tricks.sliding_window_view(buffer, 8)
    words = np.zeros(len(wide), np.uint64)
    for i in range(8):
        words = words << U(8) | wide[:, i].astype(np.uint64)
    begin = np.cumsum([0, *map(len, bodies[:-1])])
    counts = np.asarray(counts, np.int64)
    pos = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    offsets = np.array([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])])
    number = np.empty(len(words), np.int64)
    number[pos] = np.arange(len(pos))
    order = multikey_quicksort(words, pos, offsets)
    same = np.ones(max(0, len(order) - 1), bool)
    for d in offsets:
        w = words[order + d]
        same &= w[1:] == w[:-1]
    hit = np.zeros(len(pos), bool)
    if len(same):
        hit[number[order[1:]]] |= same
        hit[number[order[:-1]]] |= same
    return hit


def _spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Ranges of bytes that strings of `length` bytes with these rising starts cover, as (from, to)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.concatenate(([True], np.diff(starts) > length)))
    return [(int(starts[i]), int(starts[j - 1]) + length) for i, j in zip(cut, [*cut[1:], len(starts)])]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(bucket: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*cut[1:], len(bucket)]
    return pa.record_batch({"bucket": pa.array(bucket[cut].astype(np.int32)), "payload": pa.array([pack(*(a[i:j] for a in arrays)) for i, j in zip(cut, ends)], pa.binary())})


def _distinct(gram: np.ndarray, span: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((span, gram))
    gram, span, count = gram[order], span[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (span[1:] != span[:-1])))) if len(gram) else np.zeros(0, np.int64)
    return gram[first], span[first], np.minimum(np.add.reduceat(count, first), 2).astype(np.uint8) if len(first) else count


def _count_spans(buckets: int, length: int, gram: int):
    def run(batches):
        held, size = [], 0

        def sent():
            g, s, c = _distinct(*map(np.concatenate, zip(*held)))
            b = bucket_of(mix(g ^ s), buckets)
            order = np.argsort(b, kind="stable")
            return _blocks(b[order], g[order], s[order], c[order])

        for batch in slices(batches):
            for t in batch.column(0).cast("binary").to_pylist():
                _, _, g, s, _ = anchors(t or b"", length, gram)
                held.append((g, s, np.ones(len(g), np.uint8)))
                size += len(g)
                if size > KEEP:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    return run


def _join_spans(folder: str, buckets: int):
    """Writes the spans that occur twice; sends on each gram with its number of spans and of occurrences (2: two or more)."""

    def run(key, group):
        name = str(key[0].as_py())
        parts = [unpack(x) for x in group["payload"].to_pylist() if x is not None]
        if not parts:
            put_arrays(f"{folder}/spans", name, h=np.zeros(0, U))
            return pa.table({"bucket": pa.nulls(0, pa.int32()), "payload": pa.nulls(0, pa.binary())})
        g, s, c = _distinct(*map(np.concatenate, zip(*parts)))
        put_arrays(f"{folder}/spans", name, h=np.unique(mix(g ^ s)[c > 1]))
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        spans = np.diff(first, append=len(g)).astype(np.uint32)
        seen = np.minimum(np.add.reduceat(c.astype(np.uint32), first), 2).astype(np.uint8)
        out = _blocks(bucket_of(g[first], buckets), g[first], spans, seen)
        return pa.Table.from_batches([out])

    return run


def _join_grams(folder: str):
    """Writes the grams that occur twice or more, with their numbers of spans."""

    def run(key, group):
        parts = [unpack(x) for x in group["payload"].to_pylist() if x is not None]
        if not parts:
            put_arrays(f"{folder}/grams", str(key[0].as_py()), h=np.zeros(0, U), spans=np.zeros(0, np.uint32))
            return pa.table({"n": pa.array([0], pa.int64())})
        g, spans, seen = map(np.concatenate, zip(*parts))
        order = np.argsort(g)
        g, spans, seen = g[order], spans[order].astype(np.uint64), seen[order].astype(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        spans, seen = np.add.reduceat(spans, first), np.add.reduceat(seen, first)
        put_arrays(f"{folder}/grams", str(key[0].as_py()), h=g[first][seen > 1], spans=np.minimum(spans[seen > 1], 1 << 31).astype(np.uint32))
        return pa.table({"n": pa.array([int((seen > 1).sum())], pa.int64())})

    return run


def _look(folder: str, kind: str, q: np.ndarray, buckets: int, value: str | None) -> np.ndarray:
    """The value stored for each hash (1 where value is None), 0 where it is not stored."""
    order = np.argsort(q)
    h, out = q[order], np.zeros(len(q), np.int64)
    bucket = bucket_of(h, buckets)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i, j in zip(cut, [*cut[1:], len(h)]):
        have = get_array(f"{folder}/{kind}", str(bucket[i]), "h")
        if len(have):
            at = np.minimum(np.searchsorted(have, h[i:j]), len(have) - 1)
            hit = np.asarray(have[at]) == h[i:j]
            out[order[i:j][hit]] = 1 if value is None else get_array(f"{folder}/{kind}", str(bucket[i]), value)[at[hit]]
    return out


def _candidates(folder: str, buckets: int, length: int, gram_size: int, hot: int):
    """Rows of RECORD. kind 0: bytes from start on, n of them, that go. kind 1: a body with n strings to be compared, sorted under
    the suffix that begins at off (-1: under the string itself, of `length` bytes); rk is null if the strings are there for others' sake only."""

    def run(batches):
        given: set[int] = set()

        def sent(rows):
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "rk", "start", "n", "off", "body"])

        def alone(single, rows):
            """Strings of very frequent grams: equal ones in this task are settled here and go on as one."""
            for body, where in single.items():
                rows += [(0, rk, s, length, 0, None) for rk, s in where if rk is not None and len(where) > 1]
                rows.append((1, None, 0, 1, -1, body) if len(where) > 1 else (1, *where[0], 1, -1, body))
            single.clear()

        for batch in slices(batches):
            rks, texts = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).cast("binary").to_pylist()]
            found = [anchors(t, length, gram_size) for t in texts]
            of = np.repeat(np.arange(len(texts)), [len(x[0]) for x in found])
            first, last, gram, span, place = map(np.concatenate, zip(*found))
            spans = _look(folder, "grams", gram, buckets, "spans")
            some = np.flatnonzero(spans > 0)
            of, first, last, gram, span, place, spans = (x[some] for x in (of, first, last, gram, span, place, spans))
            key = mix(gram ^ span)
            twice = (spans == 1) | (_look(folder, "spans", key, buckets, None) > 0)
            rows: list[tuple] = []
            for i in np.unique(of[twice]):
                mine = twice & (of == i)
                whole = _merged([(int(a), int(b) + length) for a, b in zip(first[mine], last[mine])])
                rows += [(0, rks[i], a, b - a, 0, None) for a, b in whole]
            single: dict[bytes, list] = {}
            for i in np.flatnonzero(spans > 1):
                t, a, b = texts[of[i]], int(first[i]), int(last[i])
                if twice[i]:
                    if int(key[i]) in given:
                        continue
                    if len(given) < KEEP:
                        given.add(int(key[i]))
                rk = None if twice[i] else rks[of[i]]
                if spans[i] <= hot:
                    rows.append((1, rk, a, b - a + 1, int(place[i]) - a, t[a : b + length]))
                else:
                    for s in range(a, b + 1):
                        single.setdefault(t[s : s + length], []).append((rk, s))
                    if len(single) > 20_000:
                        alone(single, rows)
                if len(rows) > 20_000:
                    yield sent(rows)
                    rows = []
            alone(single, rows)
            yield sent(rows)

    return run


def _deal(splitters: list[bytes], length: int, gram: int):
    """The bucket of a record: where the leading bytes of its suffix fall among the splitters."""

    def run(batches):
        at = np.array(splitters, f"S{length}")
        for batch in slices(batches, 10_000):
            heads = [b[:length] if o < 0 else b[o : o + gram] for b, o in zip(batch.column(5).to_pylist(), batch.column(4).to_pylist())]
            bucket = np.searchsorted(at, np.array(heads, f"S{length}"), side="right") if heads else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket.astype(np.int32), pa.int32())], names=["kind", "rk", "start", "n", "off", "body", "bucket"])

    return run


def _sort_bucket(length: int):
    def run(key, group):
        n, start, rk = group["n"].to_numpy(), group["start"].to_numpy(), group["rk"].to_pylist()
        hit = repeats_in(group["body"].to_pylist(), n, length)
        out: list[tuple] = []
        for i, to in enumerate(np.cumsum(n)):
            if rk[i] is not None:
                out += [(rk[i], a, b - a) for a, b in _spans_of(start[i] + np.flatnonzero(hit[to - n[i] : to]), length)]
        cols = list(zip(*out)) or [()] * 3
        return pa.table({"rk": pa.array(cols[0], pa.int64()), "start": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int32())})

    return run


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, bytes_per_bucket: int = 16 << 20, hot: int = HOT) -> DataFrame:
    """(rk, start, n): ranges of a text's bytes, by xxhash64(key, text), that lie in a string of `length` bytes that starts anywhere else too."""
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    d = docs.select(F.xxhash64(key, text).alias("rk"), F.col(text).alias("t"))
    folder, buckets = shared_dir(spark), max(1, -(-text_bytes(docs, text) // bytes_per_bucket))
    block = "bucket int, payload binary"
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(None).cast("binary").alias("payload"))  # empty buckets get files too
    spans = d.select("t").mapInArrow(_count_spans(buckets, length, gram), block).union(every).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_join_spans(folder, buckets), block)
    spans.union(every).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_join_grams(folder), "n long").agg(F.sum("n")).first()
    found = written(d.mapInArrow(_candidates(folder, buckets, length, gram, hot), RECORD))
    settled = found.where("kind = 0").select("rk", "start", "n")
    # bodies that stand for others come from many tasks: one of each is enough
    open_ = found.where("kind = 1 AND rk IS NOT NULL").unionByName(found.where("kind = 1 AND rk IS NULL").dropDuplicates(["body"]))
    open_ = written(open_)
    size = open_.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("bytes")).first()
    if not size["rows"]:
        return settled
    parts = max(-(-size["bytes"] // (bytes_per_bucket // 4)), min(size["rows"] // 500, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    head = F.expr(f"CASE WHEN off < 0 THEN substring(body, 1, {length}) ELSE substring(body, off + 1, {gram}) END")
    sample = open_.sample(min(1.0, SAMPLE / size["rows"]), seed=1).select(head.alias("head")).limit(2 * SAMPLE).collect()
    heads = sorted(bytes(r["head"]) for r in sample)
    splitters = sorted({heads[len(heads) * i // parts] for i in range(1, parts)}) if heads else []
    dealt = open_.mapInArrow(_deal(splitters, length, gram), RECORD + ", bucket int").repartition(len(splitters) + 1, "bucket")
    return settled.union(dealt.groupBy("bucket").applyInArrow(_sort_bucket(length), "rk long, start long, n int"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, **options) -> DataFrame:
    """key, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: the remaining bytes) of each row.

    Null is the empty text. Rows that repeat each count as a place of their own: their strings start elsewhere too.
    Strings are judged on the input, in UTF-8, within a document or across documents but never over their ends.
    """
    ranges = repeated_ranges(docs, key, text, length, gram, **options).groupBy("rk").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    rows = docs.select(F.xxhash64(key, text).alias("_rk"), F.col(key).alias("k"), F.col(text).alias("t"))
    joined = rows.join(ranges, F.col("_rk") == F.col("rk"), "left").select("k", "t", "ranges")

    def run(batches):
        for batch in slices(batches):
            out = []
            for t, found in zip(batch.column(1).cast("binary").to_pylist(), batch.column(2).to_pylist()):
                t = t or b""
                gone = _merged([(r["start"], r["start"] + r["n"]) for r in found or ()])
                kept, at = [], 0
                for a, b in gone:
                    kept.append(t[at:a])
                    at = b
                kept.append(t[at:])
                out.append((len(t), sum(b - a for a, b in gone), len(gone), b"".join(kept)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=["k", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("k", key)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
