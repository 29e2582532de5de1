"""Chroma audio fingerprints of media columns, and the alignment of recordings.

1. A recording (WAV, PCM of 8 or 16 bits, any number of channels) is mixed to mono and
   cut into Hann-windowed frames of FRAME samples every HOP. Spectral energy between
   MIN_HZ and MAX_HZ falls into 12 pitch classes; frames are smoothed over time and
   scaled to unit length. A frame under SILENCE is silent and all zero.
2. An integral image over (frame, pitch class) gives any rectangle's sum from four
   values. Sixteen filters of six kinds compare rectangles as log((1 + a) / (1 + b)), are
   cut at three thresholds, and give two bits each (Gray-coded): a 32-bit integer for each
   position of a window of WIDTH frames.
3. Two recordings align at the offset that most pairs of equal integers agree on. That must
   be MIN_VOTES pairs at least; the share of differing bits over the overlap must be at
   most MAX_ERROR, and the overlap at least MIN_OVERLAP positions.

Every recording is a query. Candidates share a run of two successive different integers,
silent positions left aside; all of them are compared, and every link is counted; linked recordings are a class.

Rows: a null, empty, broken or too short recording has an empty fingerprint and aligns
with none; a recording without id has a fingerprint and is compared with none. Rows that
share an id are one recording in the search.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import graph

FRAME = 4096
HOP = 1365
MIN_HZ, MAX_HZ = 28.0, 3520.0
SILENCE = 1e-3
WIDTH = 16
MAX_ERROR = 0.25
MIN_OVERLAP = 16
MIN_VOTES = 4
RATE = 11025

#: kind, first pitch class, pitch classes, frames, thresholds
FILTERS = [
    (0, 0, 3, 16, (0.02, 0.09, 0.22)), (0, 3, 3, 16, (0.02, 0.09, 0.22)), (0, 6, 3, 16, (0.02, 0.09, 0.22)), (0, 9, 3, 16, (0.02, 0.09, 0.22)),
    (1, 0, 4, 16, (-0.12, 0.0, 0.12)), (1, 4, 4, 16, (-0.12, 0.0, 0.12)), (1, 8, 4, 16, (-0.12, 0.0, 0.12)), (1, 2, 8, 12, (-0.12, 0.0, 0.12)),
    (2, 0, 4, 16, (-0.1, 0.0, 0.1)), (2, 4, 4, 16, (-0.1, 0.0, 0.1)), (2, 8, 4, 16, (-0.1, 0.0, 0.1)), (3, 0, 6, 16, (-0.1, 0.0, 0.1)),
    (3, 6, 6, 16, (-0.1, 0.0, 0.1)), (4, 0, 9, 16, (-0.12, 0.0, 0.12)), (4, 3, 9, 12, (-0.12, 0.0, 0.12)), (5, 0, 12, 15, (-0.1, 0.0, 0.1)),
]
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and the rate; none of a file that can't be read."""
    none = np.zeros(0, np.float32), RATE
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return none
    at, kind = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(data):
            kind = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and kind:
            tag, channels, rate, _, _, bits = kind
            if tag != 1 or bits not in (8, 16) or not channels or not rate:
                return none
            body = data[at + 8 : at + 8 + size]
            body = body[: len(body) // (channels * bits // 8) * (channels * bits // 8)]
            x = np.frombuffer(body, "<i2").astype(np.float32) / 32768 if bits == 16 else (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
            return x.reshape(-1, channels).mean(1), rate
        at += 8 + size + (size & 1)
    return none


def write_wav(x: np.ndarray, rate: int = RATE) -> bytes:
    body = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


_tables: dict[int, np.ndarray] = {}


def _classes(rate: int) -> np.ndarray:
    if rate not in _tables:
        hz = np.fft.rfftfreq(FRAME, 1 / rate)
        ok = np.flatnonzero((hz >= MIN_HZ) & (hz <= MAX_HZ))
        m = np.zeros((len(hz), 12), np.float32)
        m[ok, np.round(12 * np.log2(hz[ok] / 440.0)).astype(int) % 12] = 1
        _tables[rate] = m
    return _tables[rate]


_hann = np.hanning(FRAME).astype(np.float32)


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Frames of 12 pitch classes."""
    n = (len(x) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[:: HOP][:n] * _hann
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    c = (power @ _classes(rate)).astype(float)
    padded = np.pad(c, ((2, 2), (0, 0)), mode="edge")
    c = 0.25 * padded[:-4] + 0.75 * padded[1:-3] + padded[2:-2] + 0.75 * padded[3:-1] + 0.25 * padded[4:]
    norm = np.sqrt((c * c).sum(1, keepdims=True))
    return np.where(norm > SILENCE, c / np.where(norm > SILENCE, norm, 1), 0)


def integers(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed integers of frames, and which positions are silent."""
    n = len(c) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)

    def area(t: int, y: int, w: int, h: int) -> np.ndarray:
        a, b = image[t : t + n], image[t + w : t + w + n]
        return b[:, y + h] - b[:, y] - a[:, y + h] + a[:, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w, cuts in FILTERS:
        whole = area(0, y, w, h)
        if kind == 0:
            part = whole
            value = np.log((1 + part) / (1 + area(0, 0, w, 12) - part))
            value = 1 / (1 + np.exp(-value))
        else:
            if kind == 1:
                part = area(0, y + h // 2, w, h - h // 2)
            elif kind == 2:
                part = area(w // 2, y, w - w // 2, h)
            elif kind == 3:
                part = area(0, y + h // 2, w // 2, h - h // 2) + area(w // 2, y, w - w // 2, h // 2)
            elif kind == 4:
                part = area(0, y + h // 3, w, h // 3)
            else:
                part = area(w // 3, y, w // 3, h)
            value = np.log((1 + part) / (1 + whole - part))
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted(cuts, value, "right")]
    return out, area(0, 0, WIDTH, 12) <= 0


def fingerprint_wav(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    return integers(chroma(*read_wav(data)))


def band_keys(codes: np.ndarray, silent: np.ndarray) -> np.ndarray:
    """Keys of successive different integers, each once."""
    codes = codes[~silent]
    if len(codes) < 2:
        return np.zeros(0, np.int64)
    runs = codes[np.append(True, codes[1:] != codes[:-1])].astype(np.uint64)
    return np.unique(C.mix64((runs[:-1] << np.uint64(32)) | runs[1:]).view(np.int64))


def fingerprint(media: DataFrame, rec_id: str, audio: str, load: Callable | None = None) -> DataFrame:
    """(rec_id, fingerprint, bands). audio is a column of WAV files, or of anything that
    load turns into one; the files are made and read a row at a time."""
    kind = media.schema[audio].dataType.simpleString()
    rows = media.select(F.col(f"`{rec_id}`").alias("rec_id"), F.col(f"`{audio}`").alias("audio"))

    def run(batches):
        for batch in batches:
            prints, bands = [], []
            for cell in batch.column(1).to_pylist():
                codes, silent = fingerprint_wav(load(cell) if load else cell)
                prints.append(codes.view(np.int32))
                bands.append(band_keys(codes, silent))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.list_(pa.int32())), pa.array(bands, pa.list_(pa.int64()))], names=["rec_id", "fingerprint", "bands"])

    assert load or kind == "binary", "audio is a column of WAV files"
    return rows.mapInArrow(run, C.schema_of(rows, ["rec_id"], "fingerprint array<int>, bands array<bigint>"))


def align(x: np.ndarray, y: np.ndarray) -> tuple[int, float, int]:
    """Offset of y in x, share of differing bits there, and how many positions overlap."""
    x, y = np.asarray(x, np.int32), np.asarray(y, np.int32)
    order = np.argsort(y, kind="stable")
    lo, hi = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    n = hi - lo
    if not n.sum():
        return 0, 1.0, 0
    i = np.repeat(np.arange(len(x)), n)
    at = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    votes = np.bincount(i - order[at] + len(y) - 1)
    if votes.max() < MIN_VOTES:
        return 0, 1.0, 0

    def at_offset(offset: int) -> tuple[int, float, int]:
        a, b = max(offset, 0), max(-offset, 0)
        both = min(len(x) - a, len(y) - b)
        bits = np.bitwise_count((x[a : a + both] ^ y[b : b + both]).view(np.uint32)).sum()
        return offset, float(bits) / (32 * both), both

    # of offsets with equal votes the one with the least error, so that both directions agree
    tied = (np.flatnonzero(votes == votes.max()) - (len(y) - 1)).tolist()
    return min(map(at_offset, tied), key=lambda g: (g[1], abs(g[0]), g[0]))


def aligned(pairs: DataFrame, max_error: float = MAX_ERROR, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """(a, b, offset, bit_error) of the pairs (a, b, x, y) of fingerprints that align."""

    def run(batches):
        for batch in batches:
            got = [align(np.array(x, np.int32), np.array(y, np.int32)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            ok = np.array([e <= max_error and n >= min_overlap for _, e, n in got], bool)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.float64())], names=["a", "b", "offset", "bit_error"])
            yield out.filter(pa.array(ok))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, C.schema_of(pairs, ["a", "b"], "offset int, bit_error double"))


def _links(prints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs (a, b, offset, bit_error) of different fingerprints that align, in both
    directions, and (a, a) of one that several recordings have; (doc_id, rec_id): whose
    fingerprint each recording has; (doc_id, n): how many have it."""
    named = prints.filter("rec_id IS NOT NULL AND size(fingerprint) > 0")
    own, _path = C.written(named.groupBy("rec_id").agg(F.min_by(F.struct("fingerprint", "bands"), F.struct("fingerprint", "bands")).alias("f")).select("rec_id", "f.*"), "prints")
    # equal fingerprints are one in the search
    first, _path = C.written(own.groupBy("fingerprint", "bands").agg(F.min("rec_id").alias("doc_id"), F.count("*").alias("n")), "prints")
    member, _path = C.written(own.join(first.drop("n"), ["fingerprint", "bands"]).select("doc_id", "rec_id"), "members")
    some = first.select("doc_id", "fingerprint")
    bands = first.select("doc_id", F.explode("bands").alias("band"))
    pairs = bands.select(F.col("doc_id").alias("a"), "band").join(bands.select(F.col("doc_id").alias("b"), "band"), "band").filter("a < b").select("a", "b").distinct()
    pairs = pairs.unionByName(first.filter("n > 1").select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")))
    left = some.select(F.col("doc_id").alias("a"), F.col("fingerprint").alias("x"))
    right = some.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("y"))
    near, _path = C.written(aligned(pairs.join(left, "a").join(right, "b")), "pairs")
    both = near.unionByName(near.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("offset")).alias("offset"), "bit_error"))
    return both, member, first.select("doc_id", "n")


def aligned_pairs(prints: DataFrame) -> DataFrame:
    """(rec_id, match_id, offset, bit_error): for each recording every other one that it
    aligns with, and its offset there; each pair stands in both directions."""
    both, member, _ = _links(prints)
    of_a = member.select(F.col("doc_id").alias("a"), F.col("rec_id").alias("match_id"))
    of_b = member.select(F.col("doc_id").alias("b"), "rec_id")
    return both.join(of_a, "a").join(of_b, "b").filter("rec_id <> match_id").select("rec_id", "match_id", "offset", "bit_error")


def classes(prints: DataFrame) -> DataFrame:
    """(rec_id, class_id, n_links): for each recording that aligns with others, how many they
    are, and the least id of all that are linked with it, directly or by way of others. Links
    are counted between different fingerprints, so copies aren't paired."""
    both, member, size = _links(prints)
    links = both.join(size.withColumnRenamed("doc_id", "b"), "b").groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n") - 1).otherwise(F.col("n"))).alias("n_links"))
    group = graph.components(both.select("a", "b")).select(F.col("b").alias("doc_id"), F.col("a").alias("least"))
    of = links.withColumnRenamed("a", "doc_id").join(group, "doc_id", "left").withColumn("class_id", F.coalesce("least", "doc_id"))
    return member.join(of, "doc_id").select("rec_id", "class_id", "n_links")


def recordings_alike(prints: DataFrame) -> DataFrame:
    """(rec_id, match_id, offset, bit_error): for each recording that aligns with lesser
    ones, the least of them."""
    least = aligned_pairs(prints).filter("match_id < rec_id").groupBy("rec_id").agg(F.min(F.struct("match_id", "offset", "bit_error")).alias("m"))
    return least.select("rec_id", "m.*")


def melody(vector: list | None, rate: int = RATE) -> bytes | None:
    """A WAV file that plays a vector: each value is a note of an eighth of a second over
    three octaves, with an octave above it. A missing value is a rest."""
    if not vector:
        return None
    v = np.array([np.nan if x is None else x for x in vector], float)
    scale = np.sqrt(np.nanmean(v * v)) if np.isfinite(v).any() else 1.0
    step = np.clip(np.round(v / (scale or 1.0) * 6), -18, 17)
    note = rate // 8
    hz = np.repeat(np.where(np.isnan(v), 0, 440.0 * 2 ** (np.nan_to_num(step) / 12)), note)
    phase = 2 * np.pi * np.cumsum(hz) / rate
    return write_wav(np.where(hz > 0, 0.5 * np.sin(phase) + 0.25 * np.sin(2 * phase), 0), rate)


def op1_chroma_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The fingerprint of every vector of embeddings played as a recording (there is no
    table of recordings), the class it belongs to and how many recordings it aligns with."""
    media = C.read(spark, sf_dir, "embeddings").repartition(C.n_parts(spark) * 2)
    prints, _path = C.written(fingerprint(media, "vec_id", "embedding", melody), "prints")
    found, _path = C.written(classes(prints), "alike")
    out = prints.withColumnRenamed("rec_id", "vec_id").drop("bands").join(C.sized(found.withColumnRenamed("rec_id", "vec_id")), "vec_id", "left")
    return out.withColumn("class_id", F.coalesce("class_id", "vec_id")).withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("bigint")))
