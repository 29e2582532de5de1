"""Nodes: their schema, how inputs become nodes, patches, and identifiers.

Content is kept as JSON text beside its flattened text, because Spark's own JSON types
would lose key order, nulls, and the difference between a string and an object.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.flatten import flatten, flatten_json

NODES = T.StructType([
    T.StructField("pool", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("content_json", T.StringType()),
    T.StructField("content_text", T.StringType()),
    T.StructField("tags_json", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("created_at", T.LongType()),
    T.StructField("updated_at", T.LongType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])
COLUMNS = [f.name for f in NODES.fields]
INPUTS = "n bigint, id string, content_json string, tags_json string, metadata_json string"


def generated_id(pool: str) -> Column:
    """The pool's name and a random UUID; the prefix only decorates."""
    return F.concat(F.lit(f"{pool}-"), F.uuid())


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NODES)


def from_objects(spark: SparkSession, inputs: Iterable[dict]) -> DataFrame:
    """Rows of INPUTS from Python objects {id?, content, tags?, metadata?}. Content may be
    null (a structural node) but not absent. graph, the node's edges, isn't a column of a
    node: see graph_of."""
    rows = []
    for n, given in enumerate(inputs):
        if "content" not in given:
            raise ValueError(f"input {n} has no content; null is content, nothing is not")
        say = lambda k: json.dumps(given[k], ensure_ascii=False) if given.get(k) else None
        rows.append((n, given.get("id"), None if given["content"] is None else json.dumps(given["content"], ensure_ascii=False), say("tags"), say("metadata")))
    return spark.createDataFrame(rows, INPUTS)


def graph_of(node_id: str, graph: dict | None, first_seq: int) -> list[tuple]:
    """Half-edges (graph.EDGES) that a node's graph bucket {to, from} holds, in its order."""
    halves = [(side, e) for side in ("to", "from") for e in (graph or {}).get(side) or []]
    return [(first_seq + k, node_id, side, e["id"], e.get("observedAt")) for k, (side, e) in enumerate(halves)]


def tags_by(tagger, node: dict[str, Column], tags_json: Column) -> tuple[Column, Column]:
    """The tags bucket and the terms that a tagger gives a node whose own bucket is
    tags_json. A node without content gets neither; a bucket that isn't empty wins."""
    own, none = tags_json != "{}", node["content_json"].isNull()
    if not hasattr(tagger, "for_node"):
        return tags_json, F.when(none, None).when(own, keywords_of(tags_json)).otherwise(tagger.keywords(node["content_text"]))
    bucket = F.when(none | own, tags_json).otherwise(F.coalesce(tagger.for_node(node), F.lit("{}")))
    return bucket, F.when(none, None).otherwise(tagger.terms_of(bucket))


def keywords_of(tags_json: Column) -> Column:
    return F.from_json(F.get_json_object(tags_json, "$.keywords"), "array<string>")


def create(inputs: DataFrame, pool: str, now: int, first_seq: int, tagger) -> DataFrame:
    """Nodes from rows of INPUTS, in the order of n. Tags that are given win over the tagger; tags
    without keywords make a node that no search finds. Metadata may set either time."""
    meta = F.from_json("metadata_json", "map<string,string>")
    text = flatten_json(F.col("content_json"))
    ids = F.coalesce("id", generated_id(pool))
    node = {c: F.col(c) for c in ("id", "pool", "content_json", "content_text")}
    tags, terms = tags_by(tagger, node, F.col("tags_json"))
    return inputs.select(
        F.lit(pool).alias("pool"), ids.alias("id"), (F.col("n") + F.lit(first_seq)).alias("seq"), "content_json", text.alias("content_text"),
        F.coalesce("tags_json", F.lit("{}")).alias("tags_json"), meta.alias("meta"),
    ).select(
        "pool", "id", "seq", "content_json", "content_text", tags.alias("tags_json"), terms.alias("keywords"),
        F.coalesce(F.col("meta")["createdAt"].cast("bigint"), F.lit(now)).alias("created_at"),
        F.coalesce(F.col("meta")["updatedAt"].cast("bigint"), F.lit(now)).alias("updated_at"),
        F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("createdAt", "updatedAt")).alias("extra"),
    )


def from_table(df: DataFrame, pool: Column | str, node_id: Column, content: str, order: Column, tagger, now: int = 0, extra: Column | None = None) -> DataFrame:
    """Nodes from a typed table: content is one of its columns, flattened by its type.
    seq is the value of order, which must be unique within a pool; extra is a map of metadata."""
    tags, terms = tags_by(tagger, {c: F.col(c) for c in ("id", "pool", "content_json", "content_text")}, F.lit("{}"))
    tagged = {"tags_json": tags, "keywords": terms}
    kind = df.schema[content].dataType
    text = F.when(F.col(content).isNotNull(), flatten(F.col(content), kind))
    as_json = F.to_json(F.col(content), {"ignoreNullFields": "false"}) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(F.array(F.col(content))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(content)))) - 2)
    return df.select(
        (F.lit(pool) if isinstance(pool, str) else pool).alias("pool"), node_id.cast("string").alias("id"), order.cast("bigint").alias("seq"),
        F.when(F.col(content).isNotNull(), as_json).alias("content_json"), text.alias("content_text"), F.lit(now).cast("bigint").alias("created_at"),
        F.lit(now).cast("bigint").alias("updated_at"), (F.create_map() if extra is None else extra).cast("map<string,string>").alias("extra"),
    ).select(*[tagged.get(c, F.col(c)).alias(c) for c in COLUMNS])


PATCHES = "id string, has_content boolean, content_json string, tags_json string, metadata_json string"


def patches_from(spark: SparkSession, patches: Iterable[tuple[str, dict]]) -> DataFrame:
    rows = []
    for node_id, p in patches:
        say = lambda k: json.dumps(p[k], ensure_ascii=False) if p.get(k) is not None else None
        rows.append((node_id, "content" in p, say("content"), say("tags") if p.get("tags") else ("{}" if "tags" in p else None), say("metadata")))
    return spark.createDataFrame(rows, PATCHES)


def patch(nodes: DataFrame, patches: DataFrame, now: int, tagger) -> DataFrame:
    """Nodes after patches (PATCHES, one row an id). Buckets are replaced whole, metadata is
    merged, updated_at is stamped, pool, id and seq stay. New content without tags is
    tagged anew, as are empty tags; a change of metadata alone leaves tags as they are."""
    p = patches.select(
        F.col("id"), F.coalesce("has_content", F.lit(False)).alias("p_has"), F.col("content_json").alias("p_content"), F.col("tags_json").alias("p_tags"),
        F.from_json("metadata_json", "map<string,string>").alias("p_meta"), F.lit(True).alias("p"),
    )
    j = nodes.join(p, "id", "left")
    has = F.coalesce(F.col("p_has"), F.lit(False))
    tags = F.when(F.col("p_tags").isNotNull(), F.col("p_tags")).when(has, F.lit("{}")).otherwise(F.col("tags_json"))
    content = F.when(has, F.col("p_content")).otherwise(F.col("content_json"))
    text = F.when(has, flatten_json(F.col("p_content"))).otherwise(F.col("content_text"))
    given = F.coalesce(F.col("p_meta"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter("extra", lambda k, _: ~F.map_contains_key(given, k)), F.map_filter(given, lambda k, _: ~k.isin("createdAt", "updatedAt")))
    j = j.select("pool", "id", "seq", content.alias("content_json"), text.alias("content_text"), tags.alias("tags_json"), "keywords",
                 F.when(F.col("p"), F.coalesce(given["createdAt"].cast("bigint"), F.col("created_at"))).otherwise(F.col("created_at")).alias("created_at"),
                 F.when(F.col("p"), F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"), merged.alias("extra"),
                 (F.coalesce(F.col("p"), F.lit(False)) & (has | F.col("p_tags").isNotNull())).alias("changed"))
    bucket, fresh = tags_by(tagger, {c: F.col(c) for c in ("id", "pool", "content_json", "content_text")}, F.col("tags_json"))
    own = {"tags_json": bucket, "keywords": fresh}
    return j.select(*[F.when(F.col("changed"), own[c]).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in COLUMNS])


def with_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id").distinct(), "id", "left_semi").select(*nodes.columns)


def without_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id").distinct(), "id", "left_anti").select(*nodes.columns)


def oldest(nodes: DataFrame, count: float) -> DataFrame:
    """The first nodes in the order they were put in; none for a count under 1 or NaN."""
    return nodes.orderBy("seq").limit(int(count) if count == count and count >= 1 else 0)


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """(id, pools): ids that stand in more than one pool."""
    return nodes.groupBy("id").agg(F.sort_array(F.collect_set("pool")).alias("pools")).filter(F.size("pools") > 1)
