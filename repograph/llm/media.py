"""Media columns: payloads as WAV samples, and spectral-peak fingerprints.

A payload is stored as unsigned 8-bit mono samples and read back by the wave
module. Its short-time Fourier transform (Hann frames, one each HOP samples) gives
for each frame its strongest bins; each peak is paired with the others of its frame and
with all those of the frames that start one and two frame lengths later. A pair (bin,
later bin, distance in frame lengths) is stored with the hop it starts at, as two arrays:
times and codes. Pairs within a frame give payloads shorter than two frames theirs.

Defined cases: a null text is empty and becomes one block of zero bytes, which
has no peak (the transform's mean is removed); equal payloads give equal media and
fingerprints; an empty table gives an empty result; other columns are ignored. A
payload above 4 GB minus the header doesn't fit the format and raises.
"""

from __future__ import annotations

import io
import wave

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import bounded, slices

RATE = 8000
UNIT = 64
FRAME = 512
HOP = FRAME // 8
PEAKS = 2
REACH = 2
#: Frames transformed at once, so that a long payload needs little memory.
FRAMES_AT_ONCE = 2048


def padded(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of UNIT."""
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data + bytes(size - len(data))


def store(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return r.readframes(r.getnframes())


def fingerprint(samples: bytes):
    """(times, codes) of the spectral-peak pairs, numpy arrays in time order."""
    import numpy as np

    x = np.frombuffer(samples, dtype=np.uint8)
    frames = -(-len(x) // HOP)
    window = np.hanning(FRAME).astype(np.float32)
    bins, loud = np.zeros((frames, PEAKS), np.int64), np.zeros((frames, PEAKS), bool)
    for begin in range(0, frames, FRAMES_AT_ONCE):
        size = (min(FRAMES_AT_ONCE, frames - begin) - 1) * HOP + FRAME
        part = x[begin * HOP : begin * HOP + size].astype(np.float32)
        part = np.lib.stride_tricks.sliding_window_view(np.pad(part, (0, size - len(part))), FRAME)[::HOP]
        part = (part - part.mean(1, keepdims=True)) * window
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32)[:, 1:]
        rows = np.arange(len(power))
        for p in range(PEAKS):
            best = power.argmax(1)
            value = power[rows, best]
            bins[begin : begin + len(power), p] = best + 1
            loud[begin : begin + len(power), p] = value > 1e-3
            for d in (-1, 0, 1):  # a peak's neighbours aren't peaks
                power[rows, np.clip(best + d, 0, power.shape[1] - 1)] = 0
    times, found = [], []
    for gap in range(REACH + 1):
        ahead = gap * FRAME // HOP
        for p in range(PEAKS):
            for q in range(PEAKS) if gap else range(p + 1, PEAKS):
                t = np.flatnonzero(loud[: max(0, frames - ahead), p] & loud[ahead:, q])
                times.append(t)
                found.append((bins[t, p] << 12) | (bins[t + ahead, q] << 3) | gap)
    times, found = np.concatenate(times), np.concatenate(found)
    order = np.lexsort((found, times))
    return times[order], found[order]


def _media(with_bytes: bool):
    def run(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        for b in slices(batches):
            out: dict = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "times", "codes", "media")}
            for text in b.column(1).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                media = store(padded(data))
                back = load(media)
                times, found = fingerprint(back)
                for k, v in (
                    ("n_bytes", len(data)), ("payload_bytes", len(back)), ("payload_sha256", hashlib.sha256(back).hexdigest()),
                    ("tail_crc32", zlib.crc32(back[-UNIT:])), ("media_bytes", len(media)), ("media_sha256", hashlib.sha256(media).hexdigest()),
                    ("times", times), ("codes", found), ("media", media),
                ):
                    if k != "media" or with_bytes:
                        out[k].append(v)
            kinds = {"times": pa.list_(pa.int64()), "codes": pa.list_(pa.int64()), "payload_sha256": pa.string(), "media_sha256": pa.string(), "media": pa.binary()}
            names = [k for k in out if k != "media" or with_bytes]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[k], kinds.get(k, pa.int64())) for k in names)], names=["doc_id", *names])

    return run


def media(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """One row per document: sizes and digests of payload and media as read back, the fingerprint's
    times and codes, and the media itself if with_bytes."""
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        " media_sha256 string, times array<long>, codes array<long>" + ", media binary" * with_bytes
    )
    return rows.mapInArrow(_media(with_bytes), schema)


def feature():
    """The columns times and codes as text: time:code in hex, comma-joined."""
    said = F.transform(F.arrays_zip("times", "codes"), lambda p: F.concat_ws(":", F.hex(p["times"]), F.hex(p["codes"])))
    return F.lower(F.array_join(said, ","))
