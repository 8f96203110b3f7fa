"""Media columns: sounds kept as WAV, and fingerprints of pairs of spectral peaks.

Bytes are stored as 8-bit mono samples by the wave module and read back by it. The short-time Fourier
transform of the samples is cut into four bands; the largest bin of a band in a frame is a peak if no
frame within REACH of it has a larger one there. Each peak is paired with the next FAN peaks; a pair is
a code of both frequencies and their distance in time, kept with the time of its first peak.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlane.llm.common import kept_names, slices

RATE, FRAME, HOP = 8000, 256, 128
BANDS, REACH, FAN, FARTHEST = 4, 2, 3, 63
#: A payload fills whole units of so many bytes.
UNIT = 192
#: Bytes, and frames, handled at once.
BLOCK, FRAMES = 1 << 20, 4096


def payload_of(text: str | None) -> bytes:
    """UTF-8, filled with blanks up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a mono 8-bit sound."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono sound of 8-bit samples")
        return w.readframes(w.getnframes())


def band_peaks(samples: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each frame of all sounds: the bin and the strength of the largest bin of each band; and the number of frames of each sound."""
    frames = np.array([max(1, -(-(len(s) - FRAME) // HOP) + 1) for s in samples])
    room = (frames - 1) * HOP + FRAME
    begin = np.cumsum(room) - room
    x = np.zeros(int(room.sum()), np.float32)
    for s, b in zip(samples, begin.tolist(), strict=True):
        x[b : b + len(s)] = np.frombuffer(s, np.uint8)
        x[b : b + len(s)] -= 128
    at = np.repeat(begin - (np.cumsum(frames) - frames) * HOP, frames) + np.arange(frames.sum()) * HOP
    window = np.hanning(FRAME).astype(np.float32)
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)
    width = FRAME // 2 // BANDS
    bins, strength = np.empty((len(at), BANDS), np.int64), np.empty((len(at), BANDS), np.float32)
    for k in range(0, len(at), FRAMES):
        z = np.fft.rfft(view[at[k : k + FRAMES]] * window)[:, 1:]
        power = (z.real**2 + z.imag**2).astype(np.float32).reshape(-1, BANDS, width)
        best = power.argmax(axis=2)
        bins[k : k + FRAMES] = best + np.arange(BANDS) * width
        strength[k : k + FRAMES] = np.take_along_axis(power, best[:, :, None], 2)[:, :, 0]
    return bins, strength, frames


def fingerprints(samples: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(times, codes) of each sound's pairs of peaks, by time, then frequency."""
    bins, strength, frames = band_peaks(samples)
    of = np.repeat(np.arange(len(frames)), frames)
    peak = np.ones(strength.shape, bool)
    for d in range(1, REACH + 1):
        same = of[d:] == of[:-d]
        peak[:-d] &= (strength[:-d] >= strength[d:]) | ~same[:, None]
        peak[d:] &= (strength[d:] > strength[:-d]) | ~same[:, None]
    peak &= strength > 0
    frame, band = np.nonzero(peak)
    freq, time, sound = bins[frame, band], frame - (np.cumsum(frames) - frames)[of[frame]], of[frame]
    times, codes, owners = [], [], []
    for k in range(1, FAN + 1):
        gap = time[k:] - time[:-k]
        near = (sound[k:] == sound[:-k]) & (gap <= FARTHEST)
        times.append(time[:-k][near])
        codes.append((freq[:-k] << 13 | freq[k:] << 6 | gap)[near])
        owners.append(sound[:-k][near])
    time, code, owner = (np.concatenate(x) for x in (times, codes, owners))
    order = np.lexsort((code, time, owner))
    time, code, owner = time[order].astype(np.int32), code[order].astype(np.int32), owner[order]
    at = np.searchsorted(owner, np.arange(len(samples) + 1))
    return [(time[a:b], code[a:b]) for a, b in zip(at, at[1:], strict=False)]


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and media: each row's whole text (null: empty) as a sound.

    Equal texts are equal sounds, an empty text one of UNIT blanks; repeated rows are stored each. A text
    of any length is stored whole: memory is a block of texts, or one text that is longer. An empty table
    gives an empty result. A kept column named media comes out as kept_media; others are not read.
    """
    own = kept_names(keep, ("media",))
    fields = [T.StructField(n, df.schema[c].dataType) for c, n in zip(keep, own, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for begin, end in slices(texts, BLOCK):
                sounds = pa.array([to_wav(payload_of(t)) for t in texts[begin:end]], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(begin, end - begin) for k in range(len(keep))), sounds], [*own, "media"])

    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, own, strict=True)], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, T.StructType([*fields, T.StructField("media", T.BinaryType())]))


def analyse(df: DataFrame, media: str = "media") -> DataFrame:
    """All columns, and of each row's sound: samples (binary), peak_times and peak_codes (arrays, by time, then frequency).

    A null media has nulls; one that isn't a mono sound of 8-bit samples is an error. A sound without
    peaks (silence) has empty arrays; of equal peaks in a band the first in time and frequency counts.
    Repeated rows are analysed each; an empty table gives an empty result. Columns named like a result
    are replaced by it.
    """
    results = ("samples", "peak_times", "peak_codes")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c == media or c not in results])
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("samples", T.BinaryType()), T.StructField("peak_times", T.ArrayType(T.IntegerType())), T.StructField("peak_codes", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sounds = batch.column(names.index(media)).to_pylist()
            for begin, end in slices(sounds, BLOCK):
                read = [None if m is None else from_wav(m) for m in sounds[begin:end]]
                full = [i for i, s in enumerate(read) if s is not None]
                times: list = [None] * len(read)
                codes: list = [None] * len(read)
                if full:
                    for i, (t, c) in zip(full, fingerprints([read[i] for i in full]), strict=True):
                        times[i], codes[i] = t, c
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(begin, end - begin) for k in range(len(names))), pa.array(read, pa.binary()), pa.array(times, kind), pa.array(codes, kind)], [*names, "samples", "peak_times", "peak_codes"])

    return df.mapInArrow(run, schema)
