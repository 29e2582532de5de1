"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a Python worker holds decoded at a time.
SLICE_BYTES = 2 << 20

#: Bytes of rows that Spark sends a Python worker at once: a task's whole split otherwise, twice over
#: where the lowered text goes along, in the executor's direct memory and again in the worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a local session
    that names none (as in tests) a temporary folder that goes at exit. A cluster must
    name one, as its executors can't read a folder of the driver's machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        path = tempfile.mkdtemp(prefix="nodepool-")
        atexit.register(shutil.rmtree, path, True)
        spark.sparkContext.setCheckpointDir(path)
        _own_dirs[app] = path
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str, row_group: int = 128 << 20) -> tuple[DataFrame, str]:
    """Cuts lineage: df as a Parquet table in the shared folder, and its path.
    The table survives the loss of executors and is read column by column, in tasks of
    whole row groups (of row_group bytes)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", row_group).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bound_batches(spark: SparkSession) -> str:
    """Has the session send rows to Python in batches of BATCH_BYTES, if not in smaller ones
    already; what was set before."""
    own = spark.conf.get(_BATCH)
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return own


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """bound_batches for what runs within, not for what is only planned there."""
    own = bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, own)


def trim() -> None:
    """Gives memory that this process has freed back to the system; else a worker that is
    used again, or the driver, keeps the most that it ever took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


#: Up to this many narrow rows are broadcast; beyond it a join shuffles.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is counted to have at most `most` rows (a key and a
    value or two each), else df, for Spark to join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def flat_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and where each begins (one more
    entry for the end). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Cuts a batch into runs of rows whose texts take about `most` bytes together;
    one row that is longer stays whole."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    sizes = np.asarray(texts.fill_null("").cast(pa.large_string()).buffers()[1] and
                       np.diff(flat_text(texts)[1]), np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def mix32(x: np.ndarray) -> np.ndarray:
    """Finaliser of murmur3 over uint32."""
    x = x.astype(np.uint32, copy=True)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.where(_WORD, np.arange(256) + 1, 0).astype(np.uint64)
_FOLD[65:91] += 32
_P64 = 0x9E3779B97F4A7C15
_INVERSE = pow(_P64, -1, 1 << 64)


def words(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splits texts into words with array operations only. A word is a run of ASCII
    letters, digits and non-ASCII bytes; ASCII case is folded. Gives each word's 64-bit
    hash, the text it stands in, and where each text's words begin."""
    n_texts = len(at) - 1
    is_word = _WORD[flat]
    start = is_word.copy()
    start[1:] &= ~is_word[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    start[heads] = is_word[heads]
    begin = np.flatnonzero(start)
    starts = np.searchsorted(begin, at)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts
    # each byte times the power of its place; a word's sum is brought back to its start
    up, down = _powers(len(flat))
    part = _FOLD[flat]
    part *= up[: len(flat)]
    hashes = np.add.reduceat(part, begin)
    hashes *= down[begin]
    return mix64(hashes), np.repeat(np.arange(n_texts), np.diff(starts)), starts


_power_cache: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_power_cache[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_P64, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _power_cache[k] = np.multiply.accumulate(p)
    return _power_cache


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType, null: pa.Array | None = None) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind), mask=null)


def with_columns(df: DataFrame, run: Callable, extra: str, inputs: dict[str, Column] | None = None) -> DataFrame:
    """df and the columns `extra` (DDL), which run makes of batches of Arrow. A batch has
    df's columns, as c0, c1 and so on, then `inputs`; run gives df's columns and its own.
    df's columns may have any names, nested ones too, and stand more than once."""
    names, own = df.columns, [f"c{i}" for i in range(len(df.columns))]
    more = df.sparkSession.createDataFrame([], extra).schema.fields
    schema = StructType([StructField(c, f.dataType) for c, f in zip(own, df.schema.fields)] + more)
    rows = df.select("*", *[x.alias(f"__in_{c}") for c, x in (inputs or {}).items()]).toDF(*own, *(inputs or {}))
    return rows.mapInArrow(run, schema).toDF(*names, *[f.name for f in more])


def schema_of(rows: DataFrame, ids: list[str], more: str) -> StructType:
    """The columns ids of rows, of whatever type they are, and further fields (DDL)."""
    return StructType([rows.schema[c] for c in ids] + rows.sparkSession.createDataFrame([], more).schema.fields)


def batch_of(batch: pa.RecordBatch, n: int, *made: pa.Array) -> pa.RecordBatch:
    """The batch's first n columns, and what was made; names don't matter but differ."""
    columns = [*batch.columns[:n], *made]
    return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["F", "os"]
