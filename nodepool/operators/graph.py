"""Edges between nodes, as a log of half-edges that decay when read.

Each link appends two rows: one owned by each end. The state of a half-edge follows from its
rows: it is permanent once any of them has no time, else it has the time that was
written last. With decay_ms an edge whose time is further back than that is not seen; a link
after that begins a new lifetime, which also sets its place in the order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import numbered, parted, written

EDGES = "edge_seq bigint, owner string, direction string, other string, observed_at bigint"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EDGES)


def links(pairs: DataFrame) -> DataFrame:
    """Half-edges of links (edge_seq, from_id, to_id, observed_at), without links of a node to itself."""
    return pairs.filter("from_id <> to_id").selectExpr(
        "edge_seq", "inline(array(struct(from_id AS owner, 'to' AS direction, to_id AS other), struct(to_id AS owner, 'from' AS direction, from_id AS other)))", "observed_at"
    ).select("edge_seq", "owner", "direction", "other", "observed_at")


def existing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links both of whose ends are nodes."""
    ids = nodes.select("id").distinct()
    return pairs.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*pairs.columns)


def compact(log: DataFrame) -> DataFrame:
    """One row for each half-edge: its last state, and where it was first written."""
    return log.groupBy("owner", "direction", "other").agg(
        F.min("edge_seq").alias("edge_seq"),
        F.when(F.max(F.col("observed_at").isNull()), None).otherwise(F.max_by("observed_at", "edge_seq")).alias("observed_at"),
    ).select("edge_seq", "owner", "direction", "other", "observed_at")


@dataclass(frozen=True)
class DecayGraph:
    """decay_ms None: edges never go."""

    decay_ms: int | None = None

    def alive(self, edges: DataFrame, now: int) -> DataFrame:
        if self.decay_ms is None:
            return edges
        return edges.filter(F.col("observed_at").isNull() | (F.lit(now) - F.col("observed_at") <= self.decay_ms))

    def current(self, log: DataFrame, now: int) -> DataFrame:
        """Half-edges alive at now, with the place where their current lifetime began."""
        if self.decay_ms is None:
            return compact(log)
        w = Window.partitionBy("owner", "direction", "other").orderBy("edge_seq")
        gap = F.col("observed_at") - F.lag("observed_at").over(w) > self.decay_ms
        life = F.sum(F.when(F.coalesce(gap, F.lit(False)), 1).otherwise(0)).over(w)
        # one row for each lifetime, then the last one: an edge's history is never one value
        lives = log.withColumn("life", life).groupBy("owner", "direction", "other", "life").agg(
            F.min("edge_seq").alias("edge_seq"), F.max("edge_seq").alias("until"), F.max(F.col("observed_at").isNull()).alias("always"), F.max_by("observed_at", "edge_seq").alias("observed_at")
        )
        state = lives.groupBy("owner", "direction", "other").agg(
            F.max_by("edge_seq", "life").alias("edge_seq"), F.when(F.max("always"), None).otherwise(F.max_by("observed_at", "until")).alias("observed_at")
        )
        return self.alive(state.select("edge_seq", "owner", "direction", "other", "observed_at"), now)

    def link(self, log: DataFrame, pairs: DataFrame) -> DataFrame:
        return log.unionByName(links(pairs))

    def sweep(self, log: DataFrame, now: int, owners: DataFrame | None = None) -> DataFrame:
        """The log without the rows of edges that have expired: compaction for good. Of
        owners (id) only, where they are given."""
        if owners is None:
            return self.current(log, now)
        log = written(log, "edges")  # read twice, and counted
        log = parted(log, log.count(), "owner")
        touched = owners.select(F.col("id").alias("owner")).distinct()
        return log.join(touched, "owner", "left_anti").select(*log.columns).unionByName(self.current(log.join(touched, "owner", "left_semi").select(*log.columns), now))

    def neighbors(self, log: DataFrame, now: int, nodes: DataFrame | None = None) -> DataFrame:
        """(node_id, ord, id, observed_at, direction): edges out first, then edges in, each
        in the order they were made. An edge to a node that is gone is listed, unless nodes
        are given."""
        seen = self.current(log, now)
        if nodes is not None:
            seen = seen.join(nodes.select(F.col("id").alias("other")).distinct(), "other", "left_semi")
        order = Window.partitionBy("owner").orderBy(F.col("direction") != "to", "edge_seq", "other")
        return seen.select(F.col("owner").alias("node_id"), F.row_number().over(order).alias("ord"), F.col("other").alias("id"), "observed_at", "direction")


def search_links(ranked: DataFrame, askers: DataFrame, now: int, first_seq: int) -> DataFrame:
    """Links (edge_seq, from_id, to_id, observed_at) that a search writes: from its asker to each hit, in
    their order. Nothing in a ranking reads them."""
    hits = numbered(ranked.join(askers, "query_id").filter("asker_id IS NOT NULL"), [F.col("query_id"), F.col("rank"), F.col("id")], "edge_seq", first_seq + 1)
    return hits.select("edge_seq", F.col("asker_id").alias("from_id"), F.col("id").alias("to_id"), F.lit(now).cast("bigint").alias("observed_at"))


def lifetimes(log: DataFrame, decay_ms: int) -> DataFrame:
    """(owner, direction, other, began, ended, n): spans in which an edge, refreshed in time
    each time, was seen. The bound counts as in time. Permanent rows have no lifetime."""
    key = ["owner", "direction", "other"]
    w = Window.partitionBy(*key).orderBy("observed_at", "edge_seq")
    new = F.coalesce(F.col("observed_at") - F.lag("observed_at").over(w) > decay_ms, F.lit(True))
    spans = log.filter("observed_at IS NOT NULL").withColumn("span", F.sum(new.cast("int")).over(w))
    return spans.groupBy(*key, "span").agg(F.min("observed_at").alias("began"), (F.max("observed_at") + decay_ms).alias("ended"), F.count("*").alias("n")).drop("span")
