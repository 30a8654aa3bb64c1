"""Audio columns: chroma fingerprints and alignment of recordings.

A recording's spectrum is folded into twelve pitch classes for each frame. Rectangle filters over a
window of frames, summed from an integral image, compare parts of that picture; each gives two
Gray-coded bits, sixteen of them a 32-bit integer for each frame. Recordings that share integers are
candidates; each offset at which they do is an alignment, and the share of differing bits along it
decides. Recordings with equal fingerprints are one class, searched once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

RATE = 4096
FRAME, HOP = 1024, 128
SPAN = 12
#: Bounds of the four classes of a filter's log ratio; parts that are silent alike, at 0, lie within one.
BOUNDS = (-0.5, 0.2, 0.7)
PITCH = 220.0


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono PCM with a RIFF header."""
    data = np.clip(np.round(samples * 32767), -32768, 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(data)) + data


def samples_of(media: bytes | None) -> np.ndarray:
    """Samples of a 16-bit mono PCM file; none where it is null, cut short or of another kind."""
    if media is None or len(media) < 44 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return np.zeros(0, np.float32)
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt " and (int.from_bytes(media[at + 8 : at + 10], "little"), int.from_bytes(media[at + 22 : at + 24], "little")) != (1, 16):
            return np.zeros(0, np.float32)
        if name == b"data":
            body = media[at + 8 : at + 8 + size]
            return np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.float32) / 32768
        at += 8 + size + size % 2
    return np.zeros(0, np.float32)


def _fold() -> np.ndarray:
    """Weights from spectrum bins to pitch classes, for 150 to 1900 Hz."""
    frequency = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(frequency), 12), np.float32)
    for k, f in enumerate(frequency):
        if 150 <= f <= 1900:
            out[k, int(round(12 * np.log2(f / PITCH))) % 12] = 1.0
    return out


_FOLD, _WINDOW = _fold(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12, each frame of unit sum; zeros in silence."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    power = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32) ** 2
    energy = np.sqrt(power @ _FOLD)
    total = energy.sum(axis=1, keepdims=True)
    return np.where(total > 1e-3, energy / np.maximum(total, 1e-9), 0).astype(np.float32)


def _rectangles() -> list[list[tuple[int, int, int, int, int]]]:
    """Sixteen filters as signed rectangles ``(sign, frame from, frame to, pitch from, pitch to)``.

    By turns: early against late frames, and low against high pitches, in bands of the octave.
    """
    out = []
    for k in range(16):
        low = (k * 5) % 12
        high = low + 2 + k % 3
        rows = range(low, high)
        if k % 2:
            half = len(rows) // 2 or 1
            out.append([(1, 0, SPAN, low, low + half), (-1, 0, SPAN, low + half, low + 2 * half)])
        else:
            out.append([(1, 0, SPAN // 2, low, high), (-1, SPAN // 2, SPAN, low, high)])
    return out


RECTANGLES = _rectangles()


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each window of ``SPAN`` frames; none where there are fewer frames."""
    picture = chroma(samples)
    n = len(picture) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.int32)
    octave = np.concatenate([picture, picture], axis=1)  # pitch classes wrap round
    integral = np.zeros((len(picture) + 1, octave.shape[1] + 1))
    integral[1:, 1:] = octave.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    start = np.arange(n)
    bits = np.zeros(n, np.uint32)
    for parts in RECTANGLES:
        sums = {1: np.full(n, 1e-2), -1: np.full(n, 1e-2)}
        for sign, a, b, low, high in parts:
            sums[sign] = sums[sign] + integral[start + b, high] - integral[start + a, high] - integral[start + b, low] + integral[start + a, low]
        ratio = np.log(np.maximum(sums[1], 1e-6) / np.maximum(sums[-1], 1e-6))
        level = np.digitize(ratio, BOUNDS).astype(np.uint32)
        bits = (bits << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return bits.view(np.int32)


def _mapped(df: DataFrame, columns: list[str], make: Callable[..., object], made: str, kind: str, rows: int = 200) -> DataFrame:
    """``rec_id`` and ``made``, of type ``kind``: ``make`` of the other ``columns`` of each row. Few rows at a time, as media are
    large; ids pass as they are, null or not."""
    arrow = {"binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                values = [make(*v) for v in zip(*[part.column(c).to_pylist() for c in columns])]
                yield pa.RecordBatch.from_arrays([part.column("rec_id").cast(pa.int64()), pa.array(values, arrow)], ["rec_id", made])

    return df.select("rec_id", *[c for c in columns if c != "rec_id"]).mapInArrow(run, f"rec_id long, {made} {kind}")


def melodies(vectors: DataFrame, note: int = 256) -> DataFrame:
    """``rec_id, media``: a recording for each row of ``vectors`` (vec_id, embedding), a note for each value.

    The table has no audio of its own; a value's size gives the pitch, so equal vectors sound alike.
    Null vectors give null media, null values a rest.
    """
    time = np.arange(note) / RATE

    def make(v: list | None) -> bytes | None:
        if v is None:
            return None
        values = np.array([np.nan if x is None else x for x in v], dtype=np.float64)
        pitch = np.floor(np.nan_to_num(values) * 97.0) % 12
        tone = np.sin(2 * np.pi * PITCH * 2.0 ** (pitch[:, None] / 12) * time[None, :] * 2) * np.where(np.isnan(values), 0, 0.5)[:, None]
        return wav(tone.ravel())

    return _mapped(vectors.select(F.col("vec_id").alias("rec_id"), "embedding"), ["embedding"], make, "media", "binary")


def excerpts(recordings: DataFrame, share: float = 0.6, gain: float = 0.5) -> DataFrame:
    """A quieter part of each recording, from an odd place on and with a little noise: what a search is given.

    Place and noise follow from the id, negative and null ones too. Null media stay null.
    """

    def make(rec_id: int | None, media: bytes | None) -> bytes | None:
        if media is None:
            return None
        s = samples_of(media)
        seed = rec_id if rec_id is not None and rec_id >= 0 else zlib.crc32(str(rec_id).encode())
        a = seed * 37 % max(1, int(len(s) * (1 - share)))
        part = s[a : a + int(len(s) * share)] * gain
        return wav(part + np.random.default_rng(seed).normal(0, 0.01, len(part)))

    return _mapped(recordings, ["rec_id", "media"], make, "media", "binary")


def fingerprints(recordings: DataFrame) -> DataFrame:
    """``rec_id, codes`` of each row of ``recordings`` (rec_id, media); no codes for null, broken or short media."""
    return _mapped(recordings, ["media"], lambda m: fingerprint(samples_of(m)), "codes", "array<int>")


def classes(prints: DataFrame) -> DataFrame:
    """``class_id, codes, n_members``: one row for each distinct fingerprint, by its smallest id."""
    return prints.filter("rec_id is not null").filter(F.size("codes") > 0).groupBy("codes").agg(F.min("rec_id").alias("class_id"), F.count(F.lit(1)).alias("n_members"))


#: Parts into which the recordings that hold a code are dealt.
PARTS = 8

#: Pairs of frames of a query and a recording that are compared at a time.
BLOCK_FRAMES = 1_000_000


def align(ask: np.ndarray, codes: np.ndarray, most_errors: float, least_frames: int) -> tuple[int, int, float] | None:
    """``offset, n_frames, bit_error_rate`` of the best alignment, or None if none passes.

    Every offset at which some frame of both has the same integer is checked, whichever of its repeats that is.
    """
    voted = np.zeros(len(ask) + len(codes), bool)
    rows = max(1, BLOCK_FRAMES // max(1, len(codes)))
    for a in range(0, len(ask), rows):
        i, j = np.nonzero(ask[a : a + rows, None] == codes[None, :])
        voted[j - i - a + len(ask)] = True
    best = None
    for offset in (np.flatnonzero(voted) - len(ask)).tolist():
        skip_ask, skip_rec = max(-offset, 0), max(offset, 0)
        n = min(len(ask) - skip_ask, len(codes) - skip_rec)
        if n < least_frames:
            continue
        errors = int(np.bitwise_count((ask[skip_ask : skip_ask + n] ^ codes[skip_rec : skip_rec + n]).view(np.uint32)).sum())
        rate = errors / (32.0 * n)
        if rate <= most_errors and (best is None or (rate, -n, offset) < best):
            best = rate, -n, offset
    return best and (best[2], -best[1], best[0])


def search(queries: DataFrame, recordings: DataFrame, scratch: Scratch, most_errors: float = 0.25, least_frames: int = 20) -> DataFrame:
    """``query_id, match_id, n_members, offset, n_frames, bit_error_rate``: every class of ``recordings`` that an
    alignment with a query (rec_id, media) brings within ``most_errors`` over ``least_frames`` frames.

    ``match_id`` is the smallest id of the class, ``n_members`` its size, ``offset`` the frame of it at which the
    query begins. Queries with equal fingerprints are aligned once. Every offset at which
    a pair shares an integer is rated; the one of the fewest errors a frame is taken, of equals the longest, then the
    smallest. Null or broken media neither search nor match, and rows without an id
    take no part; rows that repeat an id count as often in ``n_members``; very long media are one row, compared in
    blocks of frames; other columns are left alone; empty tables give an empty result.
    """
    index = scratch.keep(classes(fingerprints(recordings)), "index")
    asked = scratch.keep(fingerprints(queries.filter("rec_id is not null")), "asked")
    asked_classes = scratch.keep(classes(asked).select(F.col("class_id").alias("ask"), F.col("codes").alias("ask_codes")), "ask")
    # a pair meets once for each code they share, however often it is repeated; its offsets are found from the whole of both
    held = lambda df, key, name: df.select(key, F.explode(F.array_distinct(name)).alias("code"))
    # the queries are a stated set; a code of many recordings, such as that of silence, is dealt in parts
    left = held(asked_classes, "ask", "ask_codes").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    right = held(index, "class_id", "codes").withColumn("part", F.pmod(F.xxhash64("class_id"), F.lit(PARTS)).cast("int"))
    met = left.join(right, ["code", "part"]).select("ask", "class_id").distinct()
    pairs = met.join(asked_classes, "ask").join(index, "class_id").select("ask", "class_id", "n_members", "ask_codes", "codes")

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for ask, class_id, n_members, ask_codes, codes in frame.itertuples(index=False):
                best = align(np.asarray(ask_codes, np.int32), np.asarray(codes, np.int32), most_errors, least_frames)
                if best is not None:
                    found.append((ask, class_id, n_members, *best))
            yield pd.DataFrame(found, columns=["ask", "class_id", "n_members", "offset", "n_frames", "bit_error_rate"])

    rated = pairs.mapInPandas(rate, "ask long, class_id long, n_members long, offset int, n_frames int, bit_error_rate double")
    member = asked.join(asked_classes, F.col("codes") == F.col("ask_codes")).select(F.col("rec_id").alias("query_id"), F.col("ask").alias("asked"))
    return rated.join(member, F.col("ask") == F.col("asked")).select("query_id", F.col("class_id").alias("match_id"), "n_members", "offset", "n_frames", "bit_error_rate")
