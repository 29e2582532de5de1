"""Token ids as Parquet: list columns with chosen encodings, row groups and page indexes.

The table is sorted by doc_id within range partitions, so that row groups and pages have
disjoint ranges of doc_id; their column indexes let a reader skip to the pages it needs,
and metadata columns are read without the tokens. Token ids are dictionary-encoded (their
frequencies are skewed; the dictionary of a 50k vocabulary takes 200 kB) or, for
uniform ids, delta-packed; doc_id, n_tokens and n_bytes are always delta-packed.
Spark's own writer makes the files, so a task that fails and runs again leaves no half
file behind.

Rows: a null text has null token_ids and 0 tokens; an empty text an empty list. Rows
without doc_id come first. Rows that repeat are written as often as they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import common as C

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 512
DICTIONARY_BYTES = 1 << 20
ENCODINGS = ("dictionary", "delta")


def write_tokens(df: DataFrame, path: str, encoding: str = "dictionary", row_group: int = ROW_GROUP_BYTES, page: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Writes df, which has doc_id and token_ids, as it is ordered and partitioned."""
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding is one of {ENCODINGS}")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",  # integers outside a dictionary are then delta-packed
        "parquet.block.size": row_group,
        "parquet.page.size": page,
        "parquet.page.row.count.limit": page_rows,
        "parquet.dictionary.page.size": DICTIONARY_BYTES,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#token_ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.column.statistics.enabled#token_ids.list.element": "false",
    }
    df.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def tokenise(docs: DataFrame, text: str = "text", vocab_path: str = bpe.DEFAULT_VOCAB, partitions: int | None = None) -> DataFrame:
    """docs with token_ids, n_tokens and n_bytes in place of the text, ordered by doc_id.
    The texts are ordered before they are encoded, so nothing is encoded twice."""
    parts = partitions or C.n_parts(docs.sparkSession)
    rows = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return bpe.encode(rows, text, vocab_path, check=False, queue=False).drop(text, "round_trip")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, tokens: bool = True) -> DataFrame:
    """The table, or the documents from low to high (both included; the bound reaches the
    row groups' and pages' indexes), with their tokens or only the other columns."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.filter(F.col("doc_id") >= low)
    if high is not None:
        df = df.filter(F.col("doc_id") <= high)
    return df if tokens else df.drop("token_ids")


def op5_token_parquet(spark, sf_dir: str) -> DataFrame:
    """Every document's token ids, written in the format above and read again."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    path = C.new_path(spark, "tokens")
    write_tokens(tokenise(docs), path)
    return read_tokens(spark, path)
