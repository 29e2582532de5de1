"""Queries over edges: each user's events link it to the user of the event that follows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.shared import parted
from .documents import NODES, table
from .documents import _pool_of_documents as pool_of_documents
from . import sql as S

DAY = 86_400_000
NOW = 1_706_700_000_000
DECAY = 3 * DAY


def pairs(spark, sf_dir):
    """Links (edge_seq, from_id, to_id, observed_at): in each hour's events, one user to the next. Links of signups are permanent."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    e = parted(e.withColumn("hour", F.expr("ms div 3600000")), e.count(), "hour")
    hour = Window.partitionBy("hour").orderBy("ms", "event_id")
    e = e.withColumn("next_id", F.lead("user_id").over(hour)).filter("next_id IS NOT NULL")
    return e.select(F.col("event_id").alias("edge_seq"), F.col("user_id").cast("string").alias("from_id"), F.col("next_id").cast("string").alias("to_id"), F.when(F.col("event_type") != "signup", F.col("ms")).alias("observed_at"))


def log(spark, sf_dir):
    return G.links(pairs(spark, sf_dir))


def q_link(spark, sf_dir):
    return log(spark, sf_dir)


def q_edge_compact(spark, sf_dir):
    return G.compact(log(spark, sf_dir))


def q_decay(spark, sf_dir):
    """Edges that are still seen at a fixed time, three days after they were last observed."""
    return G.DecayGraph(DECAY).current(log(spark, sf_dir), NOW)


def q_neighbors(spark, sf_dir):
    return G.DecayGraph().neighbors(log(spark, sf_dir), NOW)


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("id"))


def q_dangling(spark, sf_dir):
    """Neighbours that are nodes, and links both of whose ends are, when some nodes are gone."""
    nodes = _customers(spark, sf_dir)
    left = G.DecayGraph().neighbors(log(spark, sf_dir), NOW, nodes).groupBy("node_id").agg(F.count("*").alias("n"))
    both = G.existing(pairs(spark, sf_dir), nodes).groupBy(F.col("from_id").alias("node_id")).agg(F.count("*").alias("n_links"))
    return left.join(both, "node_id", "left").select("node_id", "n", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def q_search_edges(spark, sf_dir):
    """Half-edges that a pool's searches write: every benchmark item asks for the document
    of its number, and is linked to its five hits, both halves each."""
    pool = pool_of_documents(spark, sf_dir, now=lambda: NOW)
    pool.rank_many(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text", F.col("item_id").cast("string").alias("asker_id")), 5)
    return pool.edges.log


def q_sweep(spark, sf_dir):
    """The log after a sweep of the edges that customers own; those of others stay as they are."""
    return G.DecayGraph(DECAY).sweep(log(spark, sf_dir), NOW, _customers(spark, sf_dir))


class CountingGraph:
    """A graph of another kind: it keeps links without their times, and lists the most linked first."""

    def link(self, log, links):
        return log.unionByName(G.links(links).withColumn("observed_at", F.lit(None).cast("bigint")))

    def sweep(self, log, now, owners=None):
        return log

    def neighbors(self, log, now, nodes=None):
        n = log.groupBy("owner", F.col("other").alias("id")).agg(F.count("*").alias("n"))
        order = Window.partitionBy("owner").orderBy(F.desc("n"), "id")
        return n.select(F.col("owner").alias("node_id"), F.row_number().over(order).alias("ord"), "id", F.lit(None).cast("bigint").alias("observed_at"), F.col("n").cast("string").alias("direction"))


def q_custom_graph(spark, sf_dir):
    """A graph hook of one's own, by which a pool writes and reads its edges."""
    graph = CountingGraph()
    return graph.neighbors(graph.link(G.empty(spark), pairs(spark, sf_dir)), NOW)


def q_edge_lifetimes(spark, sf_dir):
    return G.lifetimes(log(spark, sf_dir), DECAY)


QUERIES = {f.__name__: f for f in (q_link, q_edge_compact, q_decay, q_neighbors, q_dangling, q_search_edges, q_edge_lifetimes, q_sweep, q_custom_graph)}

_PAIRS = """e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events),
nx AS (SELECT *, lead(user_id) OVER (PARTITION BY ms // 3600000 ORDER BY ms, event_id) AS next_id FROM e),
pairs AS (SELECT event_id AS edge_seq, CAST(user_id AS VARCHAR) AS from_id, CAST(next_id AS VARCHAR) AS to_id, CASE WHEN event_type <> 'signup' THEN ms END AS observed_at FROM nx WHERE next_id IS NOT NULL),
log AS (SELECT edge_seq, from_id AS owner, 'to' AS direction, to_id AS other, observed_at FROM pairs WHERE from_id <> to_id
        UNION ALL SELECT edge_seq, to_id, 'from', from_id, observed_at FROM pairs WHERE from_id <> to_id),
state AS (SELECT min(edge_seq) AS edge_seq, owner, direction, other, CASE WHEN bool_or(observed_at IS NULL) THEN NULL ELSE arg_max(observed_at, edge_seq) END AS observed_at FROM log GROUP BY owner, direction, other)"""
_NEXT = """SELECT owner AS node_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY direction <> 'to', edge_seq, other) AS INT) AS ord, other AS id, observed_at, direction FROM state"""
_GAPS = f"""spans AS (SELECT *, sum(fresh) OVER (PARTITION BY owner, direction, other ORDER BY edge_seq) AS life FROM
  (SELECT *, CASE WHEN observed_at - lag(observed_at) OVER (PARTITION BY owner, direction, other ORDER BY edge_seq) > {DECAY} THEN 1 ELSE 0 END AS fresh FROM log) x)"""

ORACLE_SQL = {
    "q_link": f"WITH {_PAIRS} SELECT * FROM log",
    "q_edge_compact": f"WITH {_PAIRS} SELECT * FROM state",
    "q_decay": f"""WITH {_PAIRS}, {_GAPS}, lasts AS (SELECT owner, direction, other, max(life) AS life FROM spans GROUP BY owner, direction, other),
firsts AS (SELECT s.owner, s.direction, s.other, min(s.edge_seq) AS first_seq FROM spans s JOIN lasts l ON s.owner = l.owner AND s.direction = l.direction AND s.other = l.other AND s.life = l.life GROUP BY s.owner, s.direction, s.other)
SELECT f.first_seq AS edge_seq, t.owner, t.direction, t.other, t.observed_at FROM state t JOIN firsts f ON t.owner = f.owner AND t.direction = f.direction AND t.other = f.other WHERE t.observed_at IS NULL OR {NOW} - t.observed_at <= {DECAY}""",
    "q_neighbors": f"WITH {_PAIRS} {_NEXT}",
    "q_dangling": f"""WITH {_PAIRS}, c AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal > 0),
a AS (SELECT owner AS node_id, count(*) AS n FROM state WHERE other IN (SELECT id FROM c) GROUP BY owner),
b AS (SELECT from_id AS node_id, count(*) AS n_links FROM pairs WHERE from_id IN (SELECT id FROM c) AND to_id IN (SELECT id FROM c) GROUP BY from_id)
SELECT a.node_id, a.n, coalesce(b.n_links, 0) AS n_links FROM a LEFT JOIN b USING (node_id)""",
    "q_sweep": f"""WITH {_PAIRS}, {_GAPS}, lasts AS (SELECT owner, direction, other, max(life) AS life FROM spans GROUP BY owner, direction, other),
firsts AS (SELECT s.owner, s.direction, s.other, min(s.edge_seq) AS first_seq FROM spans s JOIN lasts l ON s.owner = l.owner AND s.direction = l.direction AND s.other = l.other AND s.life = l.life GROUP BY s.owner, s.direction, s.other),
c AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal > 0)
SELECT f.first_seq AS edge_seq, t.owner, t.direction, t.other, t.observed_at FROM state t JOIN firsts f ON t.owner = f.owner AND t.direction = f.direction AND t.other = f.other WHERE t.owner IN (SELECT id FROM c) AND (t.observed_at IS NULL OR {NOW} - t.observed_at <= {DECAY})
UNION ALL SELECT edge_seq, owner, direction, other, observed_at FROM log WHERE owner NOT IN (SELECT id FROM c)""",
    "q_custom_graph": f"""WITH {_PAIRS}, n AS (SELECT owner, other, count(*) AS n FROM log GROUP BY owner, other)
SELECT owner AS node_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY n DESC, other) AS INT) AS ord, other AS id, CAST(NULL AS BIGINT) AS observed_at, CAST(n AS VARCHAR) AS direction FROM n""",
    "q_search_edges": f"""WITH {NODES}, queries AS (SELECT CAST(item_id AS VARCHAR) AS query_id, 'documents' AS pool, text FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents)), {S.scored('nodes', 'queries')}, {S.ranked('id <> query_id', 5)},
p AS (SELECT row_number() OVER (ORDER BY query_id, rank) AS edge_seq, query_id AS from_id, id AS to_id FROM ranked)
SELECT edge_seq, from_id AS owner, 'to' AS direction, to_id AS other, CAST({NOW} AS BIGINT) AS observed_at FROM p UNION ALL SELECT edge_seq, to_id, 'from', from_id, CAST({NOW} AS BIGINT) FROM p""",
    "q_edge_lifetimes": f"""WITH {_PAIRS}, t AS (SELECT *, CASE WHEN observed_at - lag(observed_at) OVER (PARTITION BY owner, direction, other ORDER BY observed_at, edge_seq) <= {DECAY} THEN 0 ELSE 1 END AS fresh FROM log WHERE observed_at IS NOT NULL),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY owner, direction, other ORDER BY observed_at, edge_seq) AS span FROM t)
SELECT owner, direction, other, min(observed_at) AS began, max(observed_at) + {DECAY} AS ended, count(*) AS n FROM s GROUP BY owner, direction, other, span""",
}
