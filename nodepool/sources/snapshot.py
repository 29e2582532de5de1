"""Snapshots of pools: as one JSON object, or as a Parquet table by pool.

A node of the JSON form has id, pool, content, tags, graph and metadata. Pools come in the
order they were made and nodes in the order they were put in. Edges are part of the nodes'
graph; one that never was linked has an empty graph.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph as G
from ..operators import nodes as N
from .shared import written


def node_json(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """(pool, seq, node): each node as JSON text, put together from its parts as they are."""
    half = F.to_json(F.struct(F.col("other").alias("id"), F.col("observed_at").alias("observedAt")))
    sides = G.compact(log).groupBy("owner").pivot("direction", ["to", "from"]).agg(F.array_sort(F.collect_list(F.struct("edge_seq", half.alias("e")))))
    say = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(c, F.array().cast("array<struct<edge_seq:bigint,e:string>>")), lambda x: x["e"]), ","), F.lit("]"))
    graph = F.when(F.col("owner").isNull(), F.lit("{}")).otherwise(F.concat(F.lit('{"to":'), say(F.col("to")), F.lit(',"from":'), say(F.col("from")), F.lit("}")))
    tags = F.when(F.col("tags_json") != "{}", F.col("tags_json")).when(F.col("keywords").isNotNull(), F.to_json(F.struct("keywords"))).otherwise(F.lit("{}"))
    times = F.create_map(F.lit("createdAt"), F.col("created_at").cast("string"), F.lit("updatedAt"), F.col("updated_at").cast("string"))
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    parts = [
        F.lit('{"id":'), quoted("id"), F.lit(',"pool":'), quoted("pool"), F.lit(',"content":'), F.coalesce("content_json", F.lit("null")),
        F.lit(',"tags":'), tags, F.lit(',"graph":'), graph, F.lit(',"metadata":'), F.to_json(F.map_concat(times, "extra")), F.lit("}"),
    ]
    return nodes.join(sides, nodes["id"] == sides["owner"], "left").select("pool", "seq", F.concat(*parts).alias("node"))


def _nodes_of(nodes: DataFrame, log: DataFrame) -> list[dict]:
    out = []
    for r in node_json(nodes, log).orderBy("seq").collect():
        node = json.loads(r.node)
        node["metadata"] |= {k: int(node["metadata"][k]) for k in ("createdAt", "updatedAt")}
        out.append(node)
    return out


def pool_to_object(pool) -> dict:
    return {"name": pool.name, "nodes": _nodes_of(pool.nodes, pool.edges.log)}


def memory_to_object(memory) -> dict:
    return {"defaultPool": memory.default_pool, "pools": [pool_to_object(memory.pool(n)) for n in memory.pools()]}


def load_pool(pool, state: dict) -> None:
    """Replaces the pool's nodes by those of a snapshot, in its order. Tags that it has are
    kept; content without any is tagged."""
    given = state.get("nodes") or []
    pool.clear()
    made = N.create(N.from_objects(pool.spark, given), pool.name, pool.config.now(), 0, pool.config.tagger)
    pool.nodes, pool._next = written(made, "loaded"), len(given)
    halves = [h for node in given for h in N.graph_of(node["id"], node.get("graph"), pool.edges.next)]
    if halves:
        pool.edges.append(pool.spark.createDataFrame(halves, G.EDGES), max(h[0] for h in halves) - pool.edges.next + 1)


def load_memory(memory, state: dict) -> None:
    """Replaces every pool; the default pool is there even if the snapshot is empty."""
    memory.default_pool = state.get("defaultPool") or memory.default_pool
    memory._pools.clear()
    memory.edges.__init__(memory.spark)
    memory.pool(memory.default_pool)
    for p in state.get("pools") or []:
        load_pool(memory.pool(p["name"]), p)


def write_table(nodes: DataFrame, path: str) -> None:
    """All pools' nodes as Parquet, a folder a pool, so that reading one reads no other."""
    nodes.select(*N.COLUMNS).write.partitionBy("pool").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    rest = N.NODES.fields[1:] + N.NODES.fields[:1]
    return spark.read.schema(type(N.NODES)(rest)).parquet(path).select(*N.COLUMNS)


_PARTS = T.StructType([T.StructField(n, T.StringType()) for n in ("pool", "id", "content_json", "tags_json", "metadata_json")])


def _parts(lines: pd.Series) -> pd.DataFrame:
    rows = [json.loads(x) for x in lines]
    say = lambda v: json.dumps(v, ensure_ascii=False) if v else None
    return pd.DataFrame({
        "pool": [r["pool"] for r in rows],
        "id": [r["id"] for r in rows],
        "content_json": [None if r["content"] is None else json.dumps(r["content"], ensure_ascii=False) for r in rows],
        "tags_json": [say(r.get("tags")) for r in rows],
        "metadata_json": [say(r.get("metadata")) for r in rows],
    })


def read_lines(spark: SparkSession, path: str, tagger, now: int = 0) -> DataFrame:
    """Nodes from files of JSON, a node a line, in the order of files and lines. A line
    without id or content fails."""
    raw = spark.read.text(path).filter("length(trim(value)) > 0").select(F.pandas_udf(_parts, _PARTS)("value").alias("p"), F.monotonically_increasing_id().alias("n"))
    made = N.create(raw.select("n", "p.id", "p.content_json", "p.tags_json", F.to_json(F.map_concat(F.coalesce(F.from_json("p.metadata_json", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("__pool"), F.col("p.pool")))).alias("metadata_json")), "", now, 0, tagger)
    return made.withColumn("pool", F.col("extra")["__pool"]).withColumn("extra", F.map_filter("extra", lambda k, _: k != "__pool"))


def write_lines(nodes: DataFrame, log: DataFrame, path: str) -> None:
    """The same form, a node a line."""
    node_json(nodes, log).orderBy("pool", "seq").select(F.col("node").alias("value")).write.text(path)
