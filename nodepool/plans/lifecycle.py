"""Queries over the life of nodes: create, patch, evict, move, look up, snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nodes as N
from ..operators.engines import KeywordTagger
from ..operators.pool import Memory, Pool, PoolConfig
from ..sources import snapshot
from ..sources.shared import shared_dir
from .documents import table

TAGGER = KeywordTagger()


def turns(spark, sf_dir):
    """A node for each turn of all conversations, in a pool a role; content is a struct."""
    df = table(spark, sf_dir, "conversations").withColumn("content", F.struct("role", "text"))
    return N.from_table(df, F.col("role"), F.concat_ws("-", "conv_id", "turn"), "content", F.col("conv_id") * 1000 + F.col("turn"), TAGGER, 1000)


def _light(df):
    return df.select("pool", "id", "seq")


def q_create(spark, sf_dir):
    """Nodes as they are made: envelope, content as JSON, text, times."""
    return turns(spark, sf_dir).select("pool", "id", "seq", F.get_json_object("content_json", "$.text").alias("text"), F.length("content_text").cast("bigint").alias("n_chars"), F.size("keywords").cast("bigint").alias("n_terms"), "created_at", "updated_at")


def q_create_dup(spark, sf_dir):
    """Ids of a batch (conversations' ids, by user) that another batch already took."""
    pool = Pool(spark, "p").adopt(turns(spark, sf_dir).filter("pool = 'user'"))
    return pool.taken(turns(spark, sf_dir).filter("pool <> 'assistant'"))


def q_pool_create(spark, sf_dir):
    """A pool's create_many over a table of inputs: given tags win, null content is a node,
    times come from the pool's clock or the metadata."""
    t = table(spark, sf_dir, "conversations")
    inputs = t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("n"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("role") != "system", F.to_json(F.struct("text"))).alias("content_json"),
        F.when(F.col("turn") == 0, F.lit('{"keywords":["opening"]}')).alias("tags_json"), F.when(F.col("turn") == 1, F.lit('{"createdAt":"7","by":"x"}')).alias("metadata_json"),
    )
    pool = Pool(spark, "talk", PoolConfig(now=lambda: 50))
    pool.append(inputs)
    return pool.nodes.select("id", "seq", F.array_join("keywords", " ").alias("keywords"), "created_at", "updated_at", F.col("extra")["by"].alias("by"))


def q_update(spark, sf_dir):
    """Every user turn gets new content, and every system turn new metadata only."""
    nodes = turns(spark, sf_dir)
    patches = nodes.filter("pool IN ('user', 'system')").select(
        "id", (F.col("pool") == "user").alias("has_content"), F.when(F.col("pool") == "user", F.concat(F.lit('["changed things",'), F.col("seq").cast("string"), F.lit("]"))).alias("content_json"),
        F.lit(None).cast("string").alias("tags_json"), F.lit('{"source":"patch"}').alias("metadata_json"),
    )
    out = N.patch(nodes, patches, 2000, TAGGER)
    return out.select("pool", "id", "seq", F.when(F.col("pool") == "user", F.col("content_text")).alias("content_text"), F.when(F.col("pool") == "user", F.array_join("keywords", " ")).alias("keywords"),
                      F.coalesce(F.col("extra")["source"], F.lit("")).alias("source"), "created_at", "updated_at")


def q_evict_pred(spark, sf_dir):
    """What stays after documents with poor or toxic labels go."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    extra = F.create_map(*[x for c in ("lang", "source", "quality", "toxic") for x in (F.lit(c), F.col(c).cast("string"))])
    pool = Pool(spark, "documents").adopt(N.from_table(docs, "documents", F.col("doc_id"), "text", F.col("doc_id"), TAGGER, extra=extra))
    gone = pool.evict((F.col("extra")["quality"] == "0") | (F.col("extra")["toxic"] == "1"))
    left = pool.nodes.select("seq", "extra", F.lit(False).alias("gone")).unionByName(gone.select("seq", "extra", F.lit(True).alias("gone")))
    return left.select(F.col("seq").alias("doc_id"), F.col("extra")["lang"].alias("lang"), F.col("extra")["source"].alias("source"), "gone")


def q_evict_ids(spark, sf_dir):
    """Evicted by a list of ids, some of which are of no node; in the pool's order."""
    nodes = turns(spark, sf_dir)
    ids = table(spark, sf_dir, "benchmark").select(F.concat_ws("-", "item_id", F.lit(1)).alias("id")).unionByName(table(spark, sf_dir, "benchmark").select(F.concat_ws("-", "item_id", F.lit("none")).alias("id")))
    return _light(N.with_ids(nodes, ids))


def q_evict_oldest(spark, sf_dir):
    """The 25 oldest nodes of the pool of assistants."""
    return _light(N.oldest(turns(spark, sf_dir).filter("pool = 'assistant'"), 25))


def q_remove(spark, sf_dir):
    """What stays of orders' nodes when those of closed orders are removed."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    pool = Pool(spark, "orders").adopt(N.from_table(orders, "orders", F.col("o_orderkey"), "day", F.col("o_orderkey"), TAGGER))
    pool.remove_many(orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id")))
    return pool.nodes.select("id", F.col("content_text").alias("day"))


def q_get_cross(spark, sf_dir):
    """Ids that stand in several pools, and the first pool that has each (by the pools' order)."""
    memory = _library(spark, sf_dir)
    twice = memory.duplicate_ids()
    first = memory.get_many(twice).select("id", F.col("pool").alias("first_pool"))
    return twice.join(first, "id").select("id", "first_pool", F.size("pools").cast("bigint").alias("n_pools"))


def _library(spark, sf_dir) -> Memory:
    memory = Memory(spark, "documents")
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    memory.pool("documents").adopt(N.from_table(docs, "documents", F.col("doc_id"), "lang", F.col("doc_id"), TAGGER))
    memory.pool("pages").adopt(N.from_table(pages, "pages", F.col("page_id"), "url", F.col("page_id"), TAGGER))
    return memory


def q_drop_pool(spark, sf_dir):
    """Pools, their sizes, and what is left of them when one is dropped and one emptied."""
    memory = _library(spark, sf_dir)
    before = memory.stats().select("pool", "n", F.lit("before").alias("step"))
    memory.pool("empty")
    memory.drop_pool("pages")
    dropped = memory.stats().select("pool", "n", F.lit("dropped").alias("step"))
    size = memory.size
    memory.clear()
    total = spark.createDataFrame([("documents", size, "size")], "pool string, n bigint, step string")
    return before.unionByName(dropped).unionByName(total).unionByName(memory.stats().select("pool", "n", F.lit("cleared").alias("step")))


def q_size(spark, sf_dir):
    """Nodes by pool and in all."""
    memory, nodes = Memory(spark, "user"), turns(spark, sf_dir)
    for role in ("user", "assistant", "system"):
        memory.pool(role).adopt(nodes.filter(F.col("pool") == role))
    return memory.stats().unionByName(spark.createDataFrame([("total", memory.size)], "pool string, n bigint"))


def q_move(spark, sf_dir):
    """All but the last two turns of each conversation move from one pool to another."""
    from ..operators.session import windows

    seen = windows(table(spark, sf_dir, "conversations"), 2)
    memory = Memory(spark, "active")
    memory.pool("active").adopt(turns(spark, sf_dir))
    memory.move(seen.filter("NOT in_window").select(F.concat_ws("-", "conv_id", "turn").alias("id")), "active", "recall")
    return memory.nodes().select("pool", "id", "seq", F.array_join("keywords", " ").alias("keywords"))


def q_snapshot(spark, sf_dir):
    """Nodes written as a table by pool and read again."""
    import uuid

    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.write_table(turns(spark, sf_dir), path)
    back = snapshot.read_table(spark, path)
    return back.select("pool", "id", "seq", F.get_json_object("content_json", "$.text").alias("text"), "created_at")


def q_snapshot_lines(spark, sf_dir):
    """Nodes with their edges as lines of JSON, and nodes read from these again."""
    import uuid

    from ..operators import graph as G

    path, nodes = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}", turns(spark, sf_dir)
    pairs = nodes.filter("pool = 'user'").select(F.col("seq").alias("edge_seq"), F.col("id").alias("from_id"), F.concat(F.split("id", "-")[0], F.lit("-0")).alias("to_id"), F.lit(9).cast("bigint").alias("observed_at"))
    snapshot.write_lines(nodes, G.links(pairs), path)
    back = snapshot.read_lines(spark, path, TAGGER)
    edges = spark.read.text(path).select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.graph.to[0].id").alias("to_id"))
    return back.join(edges, "id").select("pool", "id", F.get_json_object("content_json", "$.text").alias("text"), F.size("keywords").cast("bigint").alias("n_terms"), "created_at", "to_id")


QUERIES = {f.__name__: f for f in (q_create, q_create_dup, q_pool_create, q_update, q_evict_pred, q_evict_ids, q_evict_oldest, q_remove, q_get_cross, q_drop_pool, q_size, q_move, q_snapshot, q_snapshot_lines)}

_T = "turns AS (SELECT role AS pool, concat(conv_id, '-', turn) AS id, conv_id * 1000 + turn AS seq, role, text FROM conversations)"


def _oracle() -> dict[str, str]:
    from . import sql as S

    return {
        "q_create": f"WITH {_T}, {S.terms('turns', 'id', "role || ' ' || text", 'tt')} SELECT t.pool, t.id, t.seq, t.text, CAST(length(role || ' ' || text) AS BIGINT) AS n_chars, CAST(count(tt.term) AS BIGINT) AS n_terms, CAST(1000 AS BIGINT) AS created_at, CAST(1000 AS BIGINT) AS updated_at FROM turns t LEFT JOIN tt USING (id) GROUP BY t.pool, t.id, t.seq, t.text, t.role",
        "q_create_dup": f"WITH {_T} SELECT id FROM turns WHERE pool <> 'assistant' AND id IN (SELECT id FROM turns WHERE pool = 'user')",
        "q_update": f"WITH {_T} SELECT pool, id, seq, CASE WHEN pool = 'user' THEN 'changed things ' || seq END AS content_text, CASE WHEN pool = 'user' THEN 'chang thing' || CASE WHEN length(CAST(seq AS VARCHAR)) >= 3 THEN ' ' || seq ELSE '' END END AS keywords, CASE WHEN pool IN ('user', 'system') THEN 'patch' ELSE '' END AS source, CAST(1000 AS BIGINT) AS created_at, CAST(CASE WHEN pool IN ('user', 'system') THEN 2000 ELSE 1000 END AS BIGINT) AS updated_at FROM turns",
        "q_pool_create": f"WITH t AS (SELECT conv_id, turn, role, concat(conv_id, '-', turn) AS id, text FROM conversations), {S.terms('t', 'id', 'text', 'tt')}, k AS (SELECT id, string_agg(term, ' ' ORDER BY pos) AS words FROM tt GROUP BY id) SELECT t.id, conv_id * 1000 + turn AS seq, CASE WHEN role = 'system' THEN NULL WHEN turn = 0 THEN 'opening' ELSE coalesce(words, '') END AS keywords, CAST(CASE WHEN turn = 1 THEN 7 ELSE 50 END AS BIGINT) AS created_at, CAST(50 AS BIGINT) AS updated_at, CASE WHEN turn = 1 THEN 'x' END AS \"by\" FROM t LEFT JOIN k USING (id)",
        "q_evict_pred": "SELECT d.doc_id, lang, source, coalesce(quality = 0, FALSE) OR coalesce(toxic = 1, FALSE) AS gone FROM documents d LEFT JOIN labels USING (doc_id)",
        "q_drop_pool": "WITH n AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM pages) AS p) SELECT * FROM (SELECT 'documents' AS pool, d AS n, 'before' AS step FROM n UNION ALL SELECT 'pages', p, 'before' FROM n UNION ALL SELECT 'documents', d, 'dropped' FROM n UNION ALL SELECT 'empty', 0, 'dropped' UNION ALL SELECT 'documents', d, 'size' FROM n UNION ALL SELECT 'documents', 0, 'cleared' UNION ALL SELECT 'empty', 0, 'cleared') x",
        "q_snapshot_lines": f"WITH {_T}, {S.terms('turns', 'id', "role || ' ' || text", 'tt')}, k AS (SELECT id, count(*) AS n FROM tt GROUP BY id) SELECT pool, id, text, coalesce(k.n, 0) AS n_terms, CAST(1000 AS BIGINT) AS created_at, CASE WHEN pool = 'user' AND id <> split_part(id, '-', 1) || '-0' THEN split_part(id, '-', 1) || '-0' END AS to_id FROM turns LEFT JOIN k USING (id)",
        "q_evict_ids": f"WITH {_T} SELECT pool, id, seq FROM turns WHERE id IN (SELECT concat(item_id, '-1') FROM benchmark)",
        "q_evict_oldest": f"WITH {_T} SELECT pool, id, seq FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM turns WHERE pool = 'assistant') x WHERE n <= 25",
        "q_remove": "SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus <> 'F'",
        "q_get_cross": "SELECT CAST(doc_id AS VARCHAR) AS id, 'documents' AS first_pool, CAST(2 AS BIGINT) AS n_pools FROM documents WHERE doc_id IN (SELECT page_id FROM pages)",
        "q_size": "SELECT role AS pool, count(*) AS n FROM conversations GROUP BY role UNION ALL SELECT 'total', count(*) FROM conversations",
        "q_move": f"WITH {_T}, {S.terms('turns', 'id', "role || ' ' || text", 'tt')}, k AS (SELECT id, string_agg(term, ' ' ORDER BY pos) AS words FROM tt GROUP BY id), b AS (SELECT *, row_number() OVER (PARTITION BY seq // 1000 ORDER BY seq DESC) <= 2 AS stays FROM turns) SELECT CASE WHEN stays THEN 'active' ELSE 'recall' END AS pool, id, CASE WHEN stays THEN seq ELSE row_number() OVER (PARTITION BY stays ORDER BY seq) - 1 END AS seq, coalesce(words, '') AS keywords FROM b LEFT JOIN k USING (id)",
        "q_snapshot": f"WITH {_T} SELECT pool, id, seq, text, CAST(1000 AS BIGINT) AS created_at FROM turns",
    }


ORACLE_SQL = _oracle()
