"""Streams: an index that follows its nodes, windows that spill, and edges that decay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery


def index_stream(nodes: DataFrame, path: str, checkpoint: str, tagger) -> StreamingQuery:
    """Appends each micro-batch's nodes (pool, id, content_text) to the index table at path,
    a folder a batch, so that a batch that runs again replaces its own rows. read_index
    reads it; counts are those of what has arrived."""

    def put(batch: DataFrame, number: int) -> None:
        docs = batch.select("pool", "id", tagger.keywords(F.col("content_text")).alias("terms")).withColumn("doc_len", F.size("terms").cast("bigint"))
        docs.filter("doc_len > 0").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return nodes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, path: str):
    """The index of all batches; of a node that came more than once, the latest counts."""
    from ..operators.bm25 import Index

    docs = spark.read.option("basePath", path).parquet(path)
    last = docs.groupBy("pool", "id").agg(F.max_by(F.struct("terms", "doc_len"), "batch").alias("d"))
    return Index(last.select("pool", "id", "d.terms", "d.doc_len"))


class WindowState(StatefulProcessor):
    """The last `size` turns of each session; those that leave are emitted."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn bigint, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.turns.get()]
        for frame in rows:
            held += list(frame[["turn", "text"]].itertuples(index=False, name=None))
        held.sort(key=lambda r: r[0])
        gone, held = held[: -self.size or None] if len(held) > self.size else [], held[-self.size :]
        self.turns.put([(int(t), x) for t, x in held])
        yield pd.DataFrame({"conv_id": [key[0]] * len(gone), "turn": [int(t) for t, _ in gone], "text": [x for _, x in gone]}, columns=["conv_id", "turn", "text"]).astype({"conv_id": "int64", "turn": "int64", "text": object})

    def close(self) -> None:
        pass


def spilled(turns: DataFrame, size: int) -> DataFrame:
    """The stream of turns (conv_id, turn, text) that leave their session's window."""
    return turns.groupBy("conv_id").transformWithStateInPandas(
        WindowState(size), outputStructType="conv_id bigint, turn bigint, text string", outputMode="Append", timeMode="None"
    )


def edge_lifetimes(edges: DataFrame, decay: str, late: str) -> DataFrame:
    """Spans (owner, other, began, ended, n) of a stream of edges (owner, other, ts): each
    observation keeps its edge alive for `decay`; `late` is how late one may come."""
    spans = edges.withWatermark("ts", late).groupBy("owner", "other", F.session_window("ts", decay).alias("w")).agg(F.count("*").alias("n"))
    return spans.select("owner", "other", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs sink on every micro-batch of what has arrived, then ends."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
