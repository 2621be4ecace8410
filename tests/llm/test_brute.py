"""Queries and operators against brute force on small fixtures: resampling, media, suffix dedup, the language model's folds."""

import hashlib
import math
import random
import wave
import zlib
from collections import Counter
from io import BytesIO

import numpy as np

from meridian.llm import importance, media, ngram_lm, suffix_dedup

TEXTS = [None, "", "A short one.", "x" * 600, "plain words that come and go " * 40, "Été à la mer " * 20, "plain words that come and go " * 40]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def features(text):
    out = Counter()
    for _, _, buckets, of in importance._features([(text or "").encode()]):
        out.update(buckets.tolist())
    return out


def test_log_weights_and_kept_set_equal_their_definition(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "Beta", "gamma", "12", "delta!"]) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in importance.resample(frame(spark, texts).repartition(20), labels).collect()}
    good = [i for i in range(0, len(texts), 2) if i % 3 and i % 7]
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(features(t))
        if i in good:
            target.update(features(t))
    n, m, b = sum(target.values()), sum(raw.values()), importance.BUCKETS
    for i, t in enumerate(texts):
        want = sum(c * math.log((target[k] + 1) / (n + b) / ((raw[k] + 1) / (m + b))) for k, c in features(t).items())
        assert abs(got[i]["log_weight"] - want) < 1e-6 * max(1, abs(want)) and got[i]["n_features"] == sum(features(t).values())
    share = sum(i % 3 > 0 for i in range(0, len(texts), 2)) / len(range(0, len(texts), 2))
    k = math.ceil(share * len(texts))
    ranked = sorted((r["gumbel_key"] for r in got.values()), reverse=True)
    assert all(r["kept"] == (r["gumbel_key"] >= ranked[k - 1] - 2e-6) for r in got.values())
    assert importance.resample(frame(spark).limit(0), labels).count() == 0


def brute_codes(payload):
    size = max(256, -(-len(payload) // 128) * 128)
    x = np.concatenate((np.frombuffer(payload, np.uint8), np.full(size - len(payload), 128, np.uint8))).astype(float) - 128
    peaks = []
    for t, at in enumerate(range(0, size - 255, 128)):
        m = np.round(np.abs(np.fft.rfft(x[at : at + 256] * np.hanning(256))), 3)
        local = [f for f in range(1, 128) if m[f] > m[f - 1] and m[f] >= m[f + 1] and m[f] > 0]
        peaks += [(t, f) for f in sorted(local, key=lambda f: (-m[f], f))[:2]]
    return sorted(t << 24 | f << 16 | g << 8 | (u - t) for t, f in peaks for u, g in peaks if 0 < u - t <= 3)


def test_media_columns_equal_brute_force(spark):
    rows = media.with_media(frame(spark).selectExpr("*", "1 AS k", "2 AS media", "3 AS codes")).collect()
    for r in rows:
        text = (TEXTS[r["doc_id"]] or "").encode()
        payload = text + b" " * (max(1, -(-len(text) // 192)) * 192 - len(text))
        with wave.open(BytesIO(bytes(r["media"]))) as f:
            assert f.readframes(f.getnframes()) == payload == bytes(r["payload"])
        assert r["n_bytes"] == len(text) and sorted(r["codes"]) == brute_codes(payload)
    assert media.with_media(frame(spark).limit(0)).count() == 0


def test_media_query_and_the_last_bytes_count(spark, tmp_path):
    a = "".join(random.Random(1).choices("abcdefgh ", k=576))
    frame(spark, [a, a[:512] + a[:64], a]).write.parquet(f"{tmp_path}/documents.parquet")
    one, other, again = media.op7_media_columns(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert one["feature"] != other["feature"] and one["feature"] == again["feature"]
    assert one["payload_sha256"] == hashlib.sha256(a.encode()).hexdigest() and one["tail_crc32"] == zlib.crc32(a[-16:].encode())


def test_suffix_dedup_with_a_common_head_equals_brute_force(spark, tmp_path):
    """A passage in every document with other text after it: all suffixes in it have long common heads."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(70))
    texts = [" ".join(word() for _ in range(rng.randrange(30))) + passage + " ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += [None, "", texts[3], texts[3], "ab" * 300, passage[:199], passage[5:205]]
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + 200] for x in data for i in range(len(x) - 199))
    want = {}
    for k, x in enumerate(data):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        want[k] = (len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == want
    for hot in (0, 1 << 30):
        rows = suffix_dedup.remove_repeats(frame(spark, texts), hot=hot, bytes_per_bucket=4096).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows} == {k: v[:3] for k, v in want.items()}


def test_language_model_query_holds_out_a_fold(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", "unheard"] + [" ".join(["The", "cat", "sat", "on", "a", "mat", "at", "home"][: rng.randrange(3, 9)]) for _ in range(60)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in ngram_lm.op3_lm_scores(spark, str(tmp_path)).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    tokens = {i: [*(t or "").lower().split(), None] for i, t in enumerate(texts)}
    count = Counter(x for i, ts in tokens.items() if not out[i] for x in ts)
    n, v = sum(count.values()), len(count)
    for i, r in rows.items():
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens[i])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(tokens[i]), sum(count[x] > 0 for x in tokens[i]), n)
        assert abs(r["base_score"] - base) < 1e-9 and r["score"] < 0
    held = [r for i, r in rows.items() if out[i] and texts[i] and texts[i] != "unheard"]
    assert len(rows) == len(texts) and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
