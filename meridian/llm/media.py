"""Media columns: lossless 8-bit WAV payloads, short-time Fourier transforms, and spectral-peak pair fingerprints.

A fingerprint is an array of codes in time order: frame of the first peak, its frequency, the second peak's
frequency and the frames between, packed into one 64-bit number each (time-coded pairs).
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.shared import slices, small_batches

RATE, UNIT = 8000, 192
WINDOW, HOP, PEAKS, AHEAD, BLOCK = 256, 128, 2, 3, 4096


def to_payload(text: bytes, unit: int = UNIT) -> bytes:
    """text, followed by spaces up to a positive multiple of unit."""
    n = max(1, -(-len(text) // unit)) * unit
    return text + b" " * (n - len(text))


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def stft_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequencies of each frame's strongest PEAKS local maxima, in time order; frames go through in blocks."""
    whole = max(WINDOW, -(-len(samples) // HOP) * HOP)  # silence up to a whole number of steps: every sample lies in a frame
    if whole > len(samples):
        samples = np.concatenate((samples, np.full(whole - len(samples), 128, np.uint8)))
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    taper = np.hanning(WINDOW)
    at, freq = [], []
    for i in range(0, len(frames), BLOCK):
        x = np.abs(np.fft.rfft((frames[i : i + BLOCK].astype(np.float64) - 128.0) * taper, axis=1))
        x = np.round(x, 3)
        inner = np.where((x[:, 1:-1] > x[:, :-2]) & (x[:, 1:-1] >= x[:, 2:]), x[:, 1:-1], 0.0)
        top = np.argsort(-inner, axis=1, kind="stable")[:, :PEAKS]
        strong = np.take_along_axis(inner, top, 1) > 0
        rows, cols = np.nonzero(strong)
        at.append(rows + i)
        freq.append(top[rows, cols] + 1)
    return np.concatenate(at), np.concatenate(freq)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Codes frame << 24 | first frequency << 16 | second frequency << 8 | frames between, for each peak and those up to AHEAD after it."""
    t, f = stft_peaks(samples)
    codes = []
    for step in range(1, (AHEAD + 1) * PEAKS):
        dt = t[step:] - t[:-step]
        ok = (dt > 0) & (dt <= AHEAD)
        codes.append((t[:-step][ok] << 24) | (f[:-step][ok] << 16) | (f[step:][ok] << 8) | dt[ok])
    return np.sort(np.concatenate(codes)).astype(np.int64)


def with_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media (the WAV file), payload (its samples, read back), codes (array<long>) of each row.

    Null is the empty text; equal texts have equal values, repeats included; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches):
        for part in slices(batches):
            texts = [b"" if x is None else x for x in part.column(1).cast("binary").to_pylist()]
            media = [write_wav(to_payload(x)) for x in texts]
            payload = [read_wav(x) for x in media]
            codes = [fingerprint(np.frombuffer(x, np.uint8)) for x in payload]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary()), pa.array(payload, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], names=["k", "n_bytes", "media", "payload", "codes"])

    kind = d.schema["k"].dataType.simpleString()
    return d.mapInArrow(run, f"k {kind}, n_bytes long, media binary, payload binary, codes array<long>").withColumnRenamed("k", key)


def op7_media_columns(spark, sf_dir: str) -> DataFrame:
    """Digests of the media columns of every whole text of documents; feature: number of codes and sha256 of their bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batches):
        for batch in slices(batches):
            media, payload = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            codes = [batch.column(4)[i].values.to_numpy(zero_copy_only=False) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(x) for x in payload], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in payload]), pa.array([zlib.crc32(x[-16:]) for x in payload], pa.int64()),
                pa.array([len(x) for x in media], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in media]), pa.array([f"{len(c)}:{hashlib.sha256(c.astype('<i8').tobytes()).hexdigest()}" for c in codes]),
            ], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return with_media(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
