"""Near-duplicates by MinHash, verified by odd sketches.

A document's shingles are its distinct words and word pairs. K MinHash samples are cut
into bands; documents that agree on a whole band are candidates. The same samples are
folded into a bitmap: each pair (sample number, sample) flips one bit, so a bit holds a
parity. The XOR of two bitmaps is the bitmap of the samples in which the documents
differ, and its population count p gives
J = 1 + n / (4 K) * ln(1 - 2 p / n), which is most precise at high similarities.

Texts with equal samples are one document for all that follows. Groups are the connected
components of all pairs that share a band and that their sketches verify; no such pair is
lost, but pairs inside a component aren't all compared (see buckets), so that a crowd of n
copies costs n comparisons, not n squared. The least doc_id of a group stays.

Rows: a document without a word (null, empty or only punctuation) is compared with none,
nor is a row without doc_id; such rows stay. Rows that share a doc_id are one document.
Ids may be of any type that has an order. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .buckets import groups, labelled

SAMPLES = 128
BANDS = 32
BITS = 1024
THRESHOLD = 0.6

_rng = np.random.Generator(np.random.PCG64(20240607))
_A = (_rng.integers(0, 2**32, SAMPLES, dtype=np.uint64) | 1).astype(np.uint32)
_B = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_EMPTY = np.uint32(0xFFFFFFFF)


def shingles(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of each text's words and word pairs, and where each text's begin."""
    h, row, starts = C.words(flat, at)
    with np.errstate(over="ignore"):
        one = (C.mix64(h) >> np.uint64(32)).astype(np.uint32)
        two = (C.mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(32)).astype(np.uint32)
    same = row[:-1] == row[1:]
    n_words = np.diff(starts)
    n_pairs = np.maximum(n_words - 1, 0)
    begin = np.concatenate([[0], np.cumsum(n_words + n_pairs)])
    out = np.empty(int(begin[-1]), np.uint32)
    nth = np.arange(len(h)) - starts[row]
    out[begin[row] + nth] = one
    left = row[:-1][same]
    out[begin[left] + n_words[left] + nth[:-1][same]] = two[same]
    return out, begin


def minhash(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SAMPLES minima for each text; a text without values has the largest."""
    n = len(begin) - 1
    out = np.full((n, SAMPLES), _EMPTY, np.uint32)
    full = np.flatnonzero(np.diff(begin))
    block, first = 1 << 16, 0
    while first < len(full):
        last = max(first + 1, int(np.searchsorted(begin[full + 1], begin[full[first]] + block, "right")))
        rows = full[first:last]
        lo, hi = begin[rows[0]], begin[rows[-1] + 1]
        x, cuts = values[lo:hi], begin[rows] - lo
        got = np.empty((SAMPLES, len(rows)), np.uint32)
        y = np.empty_like(x)
        for i in range(SAMPLES):
            np.multiply(x, _A[i], out=y)
            np.add(y, _B[i], out=y)
            np.minimum.reduceat(y, cuts, out=got[i])
        out[rows] = got.T
        first = last
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    parts = samples.reshape(len(samples), BANDS, SAMPLES // BANDS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(parts.shape[2]):
            key = C.mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bitmaps of BITS parities, as 64-bit words."""
    n = len(samples)
    bit = C.mix32(samples ^ (np.arange(SAMPLES, dtype=np.uint32) * np.uint32(0x9E3779B9))[None, :]) & np.uint32(BITS - 1)
    count = np.bincount((np.arange(n)[:, None] * BITS + bit).ravel(), minlength=n * BITS)
    return np.packbits((count & 1).astype(np.uint8).reshape(n, BITS), axis=1).view(np.int64)


def estimate(p: np.ndarray | float) -> np.ndarray:
    """Similarity for a population count of the XOR."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * np.asarray(p, float) / BITS, 1e-9))


def most_bits(threshold: float) -> int:
    """The largest population count whose estimate reaches the threshold."""
    return int(np.flatnonzero(estimate(np.arange(BITS // 2)) >= threshold)[-1])


def sign(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bands, sketch) of every row that has a doc_id and a word."""

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole, "text"):
                flat, at = C.flat_text(batch.column(1))
                values, begin = shingles(flat, at)
                keep = np.flatnonzero(np.diff(begin))
                samples = minhash(values, begin)[keep]
                n = len(keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(keep)),
                        C.list_array(band_keys(samples).ravel(), np.full(n, BANDS), pa.int64()),
                        C.list_array(odd_sketch(samples).ravel(), np.full(n, BITS // 64), pa.int64()),
                    ],
                    names=["doc_id", "bands", "sketch"],
                )

    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, C.schema_of(rows, ["doc_id"], "bands array<bigint>, sketch array<bigint>"))


def differing_bits(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b)), F.lit(0), lambda acc, v: acc + F.bit_count(v))


def verified(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(b, a): each document that isn't the least of its group, and that least one; groups
    join pairs that share a band and whose sketches reach the threshold."""
    limit = most_bits(threshold)
    sketches = signed.select("doc_id", "sketch")

    def check(pairs: DataFrame) -> DataFrame:
        left = sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x"))
        right = sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y"))
        return pairs.join(left, "a").join(right, "b").filter(differing_bits("x", "y") <= limit).select("a", "b")

    return groups(signed.select("doc_id", F.explode("bands").alias("band")), check)


def duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of): each document that isn't the least of its group, and that one."""
    signed, _path = C.written(sign(df, doc_id, text), "signed")
    # equal bands come from equal samples, hence from equal sketches
    first, _path = C.written(signed.groupBy("bands", "sketch").agg(F.min("doc_id").alias("doc_id")), "first")
    equal = signed.select("doc_id", "bands").join(first.select(F.col("doc_id").alias("a"), "bands"), "bands").select("a", F.col("doc_id").alias("b"))
    near, _path = C.written(verified(first, threshold), "near")
    copies = labelled(equal.filter("a <> b"), near, "a").select(F.col("b").alias("doc_id"), F.col("label").alias("duplicate_of"))
    return copies.unionByName(near.select(F.col("b").alias("doc_id"), F.col("a").alias("duplicate_of")))


def without_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without the documents that repeat another; all columns stay. Rows that share a
    doc_id are one document: the one of them with the least text stays (the first in the
    order of their columns as JSON, should the texts tie)."""
    gone = duplicates(df, doc_id, text, threshold).select(F.col("doc_id").alias("__gone")).distinct()
    gone, _path = C.written(gone, "gone")
    kept = df.join(C.sized(gone), F.col(f"`{doc_id}`") == F.col("__gone"), "left_anti")
    again = df.groupBy(F.col(f"`{doc_id}`").alias("__again")).count().filter("count > 1 AND __again IS NOT NULL").select("__again")
    again, _path = C.written(again, "again")
    if again.isEmpty():
        return kept
    key = F.col(f"`{doc_id}`") == F.col("__again")
    order = Window.partitionBy(f"`{doc_id}`").orderBy(F.col(f"`{text}`"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    one = kept.join(again, key, "left_semi").withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")
    return kept.join(again, key, "left_anti").unionByName(one)


def op8_minhash_odd_sketch(spark, sf_dir: str) -> DataFrame:
    """Every document that repeats another, with the document of its group that stays."""
    return duplicates(C.read(spark, sf_dir, "documents"))
