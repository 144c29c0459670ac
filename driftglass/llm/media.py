"""Media columns: lossless 8-bit WAV storage, short-time Fourier transforms, spectral-peak pair fingerprints.

Two operators that chain: ``store_wav`` turns a text column into a binary WAV column, ``fingerprint_wav`` reads that
column back with the wave module and describes it by pairs of spectral peaks, each stored as one time-coded long
(pair hash in the upper 32 bits, frame number in the lower 32).

Defined cases: a null text counts as empty; an empty text is stored as one block of filler; equal texts give equal
values; silence (all samples equal) has no peaks and so an empty array; a null media value gives nulls. Columns that
the operator adds replace columns of the same name in the input; repeated rows each get their row; an empty table gives none; of equally loud bins the
lowest is the peak. Very long texts are analysed in runs of ``RUN`` frames and rows go in slices, so memory beyond the longest text is bounded.
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
from pyspark.sql import types as T

from driftglass.llm.common import slices

BLOCK = 576  # payloads are padded to a multiple of this many samples
FILLER = 255
RATE = 8000
WINDOW = 576
HOP = 288
RUN = 4096  # frames analysed at a time
BANDS = ((2, 20), (20, 60), (60, 130), (130, 288))  # frequency bins, one peak each
REACH = 3  # a peak is paired with peaks of its own frame and up to so many frames later


def pad_payload(data: bytes) -> bytes:
    """Fill up with bytes 255 to a positive multiple of BLOCK."""
    return data + bytes([FILLER]) * ((-len(data)) % BLOCK if data else BLOCK)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peak_pairs(payload: bytes) -> np.ndarray:
    """Time-coded pair hashes of 8-bit samples: hash << 32 | frame, in order of frame."""
    samples = np.frombuffer(payload, np.uint8)
    frames = (len(samples) - WINDOW) // HOP + 1
    if frames < 1:
        return np.empty(0, np.int64)
    taper = np.hanning(WINDOW).astype(np.float32)
    peaks = np.empty((frames, len(BANDS)), np.int64)
    loud = np.empty((frames, len(BANDS)), bool)
    for at in range(0, frames, RUN):
        n = min(RUN, frames - at)
        part = samples[at * HOP : (at + n - 1) * HOP + WINDOW].astype(np.float32) - 128
        view = np.lib.stride_tricks.sliding_window_view(part, WINDOW)[::HOP]
        view = view - view.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(view * taper, axis=1))
        for b, (low, high) in enumerate(BANDS):
            band = power[:, low:high]
            best = band.argmax(axis=1)
            peaks[at : at + n, b] = best + low
            top = band[np.arange(n), best]
            loud[at : at + n, b] = (top > 1.5 * band.mean(axis=1)) & (top > 1.0)
    codes = []
    for b in range(len(BANDS)):
        other = (b + 1) % len(BANDS)
        for dt in range(min(REACH + 1, frames)):
            t = np.flatnonzero(loud[: frames - dt, b] & loud[dt:, other])
            pair = (peaks[t, b] << 18) | (peaks[t + dt, other] << 6) | (dt << 2) | b
            codes.append((pair << 32) | t)
    found = np.concatenate(codes) if codes else np.empty(0, np.int64)
    return found[np.lexsort((found >> 32, found & 0xFFFFFFFF))]


def store_wav(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_bytes`` (of the UTF-8 text) and ``media``: the padded text as the samples of a WAV file."""
    schema = T.StructType([*df.drop("n_bytes", "media").schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text)):
            rows = [x.encode() if x else b"" for x in batch.column(text).to_pylist()]
            own = {n: batch.column(n) for n in batch.schema.names if n not in ("n_bytes", "media")}
            own["n_bytes"] = pa.array([len(x) for x in rows], pa.int64())
            own["media"] = pa.array([to_wav(pad_payload(x)) for x in rows], pa.binary())
            yield pa.RecordBatch.from_pydict(own)

    return df.mapInArrow(run, schema)


def fingerprint_wav(df: DataFrame, media: str = "media") -> DataFrame:
    """Replace the media column by what is read back: sizes, digests and ``codes``, the time-coded fingerprint array."""
    added = {
        "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(),
        "media_bytes": T.LongType(), "media_sha256": T.StringType(), "codes": T.ArrayType(T.LongType()),
    }
    kept = df.drop(media, *added)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in added.items())])

    def describe(stored: bytes | None) -> tuple:
        if stored is None:
            return (None,) * len(added)
        payload = from_wav(stored)
        tail = zlib.crc32(payload[-32:])
        return len(payload), hashlib.sha256(payload).hexdigest(), tail, len(stored), hashlib.sha256(stored).hexdigest(), peak_pairs(payload)

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, media)):
            rows = [describe(x.as_py()) for x in batch.column(media)]
            own = {n: batch.column(n) for n in names}
            for i, (n, kind) in enumerate(zip(added, kinds, strict=True)):
                own[n] = pa.array([r[i] for r in rows], kind)
            yield pa.RecordBatch.from_pydict(own)

    return df.mapInArrow(run, schema)


def media_features(docs: DataFrame) -> DataFrame:
    """The operator over a table of texts: ``doc_id`` with sizes, digests and a digest of the fingerprint array."""
    stored = store_wav(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "media")
    read = fingerprint_wav(stored)
    feature = F.concat_ws(":", F.size("codes").cast("string"), F.lower(F.hex(F.xxhash64("codes"))))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
