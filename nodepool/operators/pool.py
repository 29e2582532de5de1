"""Pools of nodes and the memory that holds them.

A pool's state is a DataFrame; an operation replaces it. Every WRITE_EVERY operations it
is written to the shared folder and read back, so that plans stay short.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import numbered, written
from . import graph as G
from . import nodes as N
from .engines import Bm25Engine, KeywordTagger

WRITE_EVERY = 4
#: Changes after which an index that was added to is made anew at the next search.
REINDEX_EVERY = 16
UNSET: Any = object()


@dataclass
class PoolConfig:
    now: Callable[[], int] = lambda: int(time.time() * 1000)
    on_evict: Callable[[DataFrame, Pool], None] | None = None
    tagger: Any = field(default_factory=KeywordTagger)
    engine: Any = field(default_factory=Bm25Engine)
    graph: Any = field(default_factory=G.DecayGraph)


class _Edges:
    """The edge log, which pools of one memory share."""

    def __init__(self, spark: SparkSession) -> None:
        self.log, self.next, self.changes = G.empty(spark), 0, 0

    def set(self, log: DataFrame, n: int) -> None:
        """The log after an operation that made n links."""
        self.log, self.next, self.changes = log, self.next + n, self.changes + 1
        if self.changes % WRITE_EVERY == 0:
            self.log = written(self.log, "edges")

    def append(self, rows: DataFrame, n: int) -> None:
        self.set(self.log.unionByName(rows), n)


class Pool:
    def __init__(self, spark: SparkSession, name: str, config: PoolConfig | None = None, edges: _Edges | None = None) -> None:
        if not isinstance(name, str) or not name:
            raise ValueError("a pool's name is a string that isn't empty")
        self.spark, self.name, self.config = spark, name, config or PoolConfig()
        self.edges = edges or _Edges(spark)
        self.nodes, self._next, self._changes = N.empty(spark), 0, 0
        #: all nodes that may ask or be linked: a memory puts those of its pools here
        self.known: Callable[[], DataFrame] = lambda: self.nodes
        self._index: Any = None
        #: the index as the last search read it
        self._read: Any = None

    def _set(self, nodes: DataFrame, added: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """The pool's new nodes; the index follows by what came and went, where it is kept."""
        self._changes += 1
        self.nodes = written(nodes, "nodes") if self._changes % WRITE_EVERY == 0 else nodes
        if self._index is not None:
            if gone is not None:
                self._index = self._index.remove(gone)
            if added is not None:
                self._index = self._index.add(_terms(added))
            if self._changes % REINDEX_EVERY == 0 or (added is None and gone is None):
                self._index = None

    @property
    def index(self):
        """The pool's index, made at the first search and kept from then on; None where the
        engine has none."""
        if self._index is None and hasattr(self.config.engine, "index"):
            self._index = self.config.engine.index(_terms(self.nodes))
        return self._index

    def _searched(self) -> Any:
        """What a search goes through. An index is sorted once it is read again: to sort all
        postings costs more than one search without."""
        index = self.index
        if index is None:
            return _terms(self.nodes)
        if self._read is index and getattr(index, "by_term", index) is None:
            self._index = index = index.sorted_by_term()
        self._read = index
        return index

    def _ids(self, ids: Iterable[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")

    # life of nodes

    def create(self, content: Any = UNSET, id: str | None = None, tags: dict | None = None, metadata: dict | None = None, graph: dict | None = None) -> DataFrame:  # noqa: A002
        given = {"id": id, "tags": tags, "metadata": metadata, "graph": graph}
        return self.create_many([given if content is UNSET else given | {"content": content}])

    def create_many(self, inputs: Iterable[dict]) -> DataFrame:
        """Adds a batch, or nothing of it: content that is missing, or an id that repeats
        within the batch or the pool, rejects it whole."""
        inputs = list(inputs)
        linked = [k for k, i in enumerate(inputs) if i.get("graph")]
        inputs = [i | {"id": str(uuid.uuid4())} if k in linked and not i.get("id") else i for k, i in enumerate(inputs)]
        made = self.append(N.from_objects(self.spark, inputs), len(inputs))
        for k in linked:
            self._graph(inputs[k]["id"], inputs[k]["graph"])
        return made

    def _graph(self, node_id: str, graph: dict | None, replace: bool = False) -> None:
        """Puts a graph bucket's edges into the log, in place of the node's own with replace."""
        rows = N.graph_of(node_id, graph, self.edges.next)
        log = self.edges.log.filter(F.col("owner") != node_id) if replace else self.edges.log
        self.edges.set(log.unionByName(self.spark.createDataFrame(rows, G.EDGES)), len(rows))

    def append(self, inputs: DataFrame, count: int | None = None) -> DataFrame:
        """As create_many, for a DataFrame of node inputs (nodes.INPUTS); n sets their order."""
        count = inputs.count() if count is None else count
        # random ids must be the same whenever they are read again
        made = written(N.create(inputs, self.name, self.config.now(), self._next, self.config.tagger), "created")
        if bad := [r.id for r in self.taken(made).limit(5).collect()]:
            raise ValueError(f"ids that are already taken: {bad}")
        self._set(self.nodes.unionByName(made), added=made)
        self._next += count
        return made

    def taken(self, batch: DataFrame) -> DataFrame:
        """(id) of a batch that stand in it more than once, or in the pool: what rejects it."""
        twice = batch.groupBy("id").count().filter("count > 1").select("id")
        return twice.unionByName(batch.join(self.nodes, "id", "left_semi").select("id")).distinct()

    def adopt(self, nodes: DataFrame) -> Pool:
        """Takes nodes that are made already (nodes.NODES, as from_table gives them) as the
        pool's own, in place of what it holds. Their ids must differ."""
        self.nodes, self._index = nodes.select(F.lit(self.name).alias("pool"), *N.COLUMNS[1:]), None
        self._next = (self.nodes.agg(F.max("seq")).first()[0] or -1) + 1
        return self

    def update(self, id: str, **patch: Any) -> DataFrame:  # noqa: A002
        return self.update_many([(id, patch)])

    def update_many(self, patches: Iterable[tuple[str, dict]]) -> DataFrame:
        patches = list(patches)
        rows = N.patches_from(self.spark, patches)
        if bad := [r.id for r in rows.join(self.nodes, "id", "left_anti").limit(5).collect()]:
            raise KeyError(f"no such node: {bad}")
        self._set(written(N.patch(self.nodes, rows, self.config.now(), self.config.tagger), "patched"), gone=rows, added=None)
        changed = N.with_ids(self.nodes, rows)
        if self._index is not None:
            self._index = self._index.add(_terms(changed))
        for node_id, patch in patches:
            if "graph" in patch:
                self._graph(node_id, patch["graph"], replace=True)
        return changed

    def evict(self, which: Column | DataFrame | Iterable[str]) -> DataFrame:
        """Takes out nodes by a condition, or by ids (those not here are passed over), in the
        pool's order. on_evict gets them first; if it raises, nothing is taken out."""
        if isinstance(which, Column):
            chosen = self.nodes.filter(which)
        else:
            chosen = N.with_ids(self.nodes, which if isinstance(which, DataFrame) else self._ids(which))
        gone = written(chosen, "evicted")
        if gone.isEmpty():
            return gone
        if self.config.on_evict:
            self.config.on_evict(gone.orderBy("seq"), self)
        self._set(N.without_ids(self.nodes, gone), gone=gone)
        return gone.orderBy("seq")

    def evict_oldest(self, count: float) -> DataFrame:
        return self.evict(N.oldest(self.nodes, count).select("id"))

    def remove(self, id: str) -> bool:  # noqa: A002
        """Takes a node out without telling on_evict."""
        return self.remove_many(self._ids([id])) > 0

    def remove_many(self, ids: DataFrame) -> int:
        """As remove, for all ids (id); gives how many nodes went."""
        n = N.with_ids(self.nodes, ids).count()
        if n:
            self._set(N.without_ids(self.nodes, ids), gone=ids)
        return n

    def clear(self) -> None:
        self.nodes, self._index = N.empty(self.spark), None

    # reading

    def get(self, id: str):  # noqa: A002
        return self.nodes.filter(F.col("id") == id).first()

    def has(self, id: str) -> bool:  # noqa: A002
        return not self.nodes.filter(F.col("id") == id).isEmpty()

    def list(self) -> DataFrame:
        return self.nodes.orderBy("seq")

    def ids(self) -> list[str]:
        return [r.id for r in self.nodes.select("id", "seq").orderBy("seq").collect()]

    @property
    def size(self) -> int:
        return self.nodes.count()

    # search

    def rank_many(self, queries: DataFrame, limit: int = 10, min_score: float = 0.0, link: bool = True) -> DataFrame:
        """Ranked hits (query_id, rank, id, score, raw) of queries (query_id, text, and an
        asker_id that may be null or missing; one that is no node counts as none). An asker
        is left out of its own results and, with link, gets an edge to each of them; what has
        expired of the edges of both is swept first."""
        if "asker_id" not in queries.columns:
            queries = queries.withColumn("asker_id", F.lit(None).cast("string"))
        asked = queries.select("query_id", F.lit(self.name).alias("pool"), self.config.tagger.query_terms(F.col("text")).alias("terms"))
        askers = queries.select("query_id", "asker_id").filter("asker_id IS NOT NULL")
        if not askers.isEmpty():
            askers = written(askers.join(self.known().select(F.col("id").alias("asker_id")).distinct(), "asker_id", "left_semi").select("query_id", "asker_id"), "askers")
        found = written(self.config.engine.search(asked, self._searched(), limit, min_score, askers), "ranked").drop("pool")
        if link and not askers.isEmpty():
            now, graph = self.config.now(), self.config.graph
            touched = askers.select(F.col("asker_id").alias("id")).unionByName(found.join(askers, "query_id", "left_semi").select("id")).distinct()
            pairs = G.search_links(found, askers, now, self.edges.next)
            self.edges.set(graph.link(graph.sweep(self.edges.log, now, touched), pairs), found.count() + 1)
        return found

    def rank(self, query: str, limit: int = 10, min_score: float = 0.0, asker: str | None = None, link: bool = True) -> DataFrame:
        """As rank_many for one query, with the nodes, in order."""
        one = self.spark.createDataFrame([("q", query, asker)], "query_id string, text string, asker_id string")
        return self.rank_many(one, limit, min_score, link).drop("query_id").join(self.nodes, "id").orderBy("rank")

    def search(self, query: str, **options: Any) -> DataFrame:
        return self.rank(query, **options).select(*N.COLUMNS, "rank").orderBy("rank").drop("rank")

    # edges

    def link(self, from_id: str, to_id: str, observed_at: int | None = None) -> bool:
        return self._link(self.nodes, from_id, to_id, observed_at)

    def _link(self, nodes: DataFrame, from_id: str, to_id: str, observed_at: int | None) -> bool:
        ends = {r.id for r in nodes.filter(F.col("id").isin(from_id, to_id)).select("id").distinct().collect()}
        if not {from_id, to_id} <= ends:
            return False
        pair = self.spark.createDataFrame([(self.edges.next, from_id, to_id, observed_at)], "edge_seq bigint, from_id string, to_id string, observed_at bigint")
        self.edges.set(self.config.graph.link(self.edges.log, pair), 1)
        return True

    def neighbors(self, id: str, existing: DataFrame | None = None) -> DataFrame:  # noqa: A002
        return self.config.graph.neighbors(self.edges.log.filter(F.col("owner") == id), self.config.now(), existing).drop("node_id").orderBy("ord")

    # snapshots

    def to_json(self) -> dict:
        from ..sources import snapshot

        return snapshot.pool_to_object(self)

    def load(self, state: dict | str) -> None:
        from ..sources import snapshot

        snapshot.load_pool(self, json.loads(state) if isinstance(state, str) else state)


class Memory:
    """Named pools, one of them the default; they share one log of edges."""

    def __init__(self, spark: SparkSession, default_pool: str = "main", config: PoolConfig | None = None) -> None:
        self.spark, self.default_pool, self.config = spark, default_pool, config or PoolConfig()
        self._pools: dict[str, Pool] = {}
        self.edges = _Edges(spark)
        self.pool(default_pool)

    def pool(self, name: str | None = None, **options: Any) -> Pool:
        """The pool of that name, made if need be. Options are those of PoolConfig; what isn't
        given stays as it is, or for a new pool is the memory's. A pool's engine stays."""
        name = self.default_pool if name is None else name
        if name not in self._pools:
            made = self._pools[name] = Pool(self.spark, name, PoolConfig(**(self.config.__dict__ | options)), self.edges)
            made.known = self.nodes
        elif options:
            own = self._pools[name]
            own.config = PoolConfig(**(own.config.__dict__ | {k: v for k, v in options.items() if k != "engine"}))
        return self._pools[name]

    def pools(self) -> list[str]:
        return list(self._pools)

    def has_pool(self, name: str) -> bool:
        return name in self._pools

    def drop_pool(self, name: str) -> bool:
        if name == self.default_pool:
            raise ValueError("the default pool stays")
        return self._pools.pop(name, None) is not None

    def nodes(self) -> DataFrame:
        """All pools' nodes, with the pool's place as pool_seq."""
        out = None
        for k, p in enumerate(self._pools.values()):
            rows = p.nodes.withColumn("pool_seq", F.lit(k))
            out = rows if out is None else out.unionByName(rows)
        return out

    def get(self, id: str):  # noqa: A002
        """The node of that id, from the first pool that has it."""
        return self.get_many(self.spark.createDataFrame([(id,)], "id string")).first()

    def get_many(self, ids: DataFrame) -> DataFrame:
        """The nodes of ids (id), each from the first pool that has it."""
        rows = N.with_ids(self.nodes(), ids)
        first = rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in N.COLUMNS if c != "id"]), "pool_seq").alias("n"))
        return first.select("id", "n.*").select(*N.COLUMNS)

    def has(self, id: str) -> bool:  # noqa: A002
        return not self.nodes().filter(F.col("id") == id).isEmpty()

    @property
    def size(self) -> int:
        return self.nodes().count()

    def stats(self) -> DataFrame:
        """(pool, n) of every pool, empty ones too."""
        names = self.spark.createDataFrame([(n,) for n in self._pools], "pool string")
        return names.join(self.nodes().groupBy("pool").agg(F.count("*").alias("n")), "pool", "left").fillna(0, "n")

    def duplicate_ids(self) -> DataFrame:
        return N.duplicate_ids(self.nodes())

    def create(self, *args: Any, **given: Any) -> DataFrame:
        return self.pool().create(*args, **given)

    def create_many(self, inputs: Iterable[dict]) -> DataFrame:
        return self.pool().create_many(inputs)

    def update(self, id: str, **patch: Any) -> DataFrame:  # noqa: A002
        return self.pool().update(id, **patch)

    def list(self) -> DataFrame:
        return self.pool().list()

    def rank(self, query: str, asker: str | None = None, **options: Any) -> DataFrame:
        """In the default pool; the asker may be of any pool, and counts only if it exists."""
        return self.pool().rank(query, asker=asker, **options)

    def search(self, query: str, asker: str | None = None, **options: Any) -> DataFrame:
        return self.pool().search(query, asker=asker, **options)

    def link(self, from_id: str, to_id: str, observed_at: int | None = None) -> bool:
        return self.pool()._link(self.nodes(), from_id, to_id, observed_at)

    def neighbors(self, id: str) -> DataFrame:  # noqa: A002
        """By the graph of the pool that has the node."""
        got = self.get(id)
        return self.pool(got.pool if got else None).neighbors(id)

    def move(self, ids: DataFrame | Iterable[str], source: str, target: str) -> DataFrame:
        """Takes nodes from one pool to the end of another in one step, tagged anew."""
        a, b = self.pool(source), self.pool(target)
        gone = written(N.with_ids(a.nodes, ids if isinstance(ids, DataFrame) else a._ids(ids)), "moved")
        if gone.isEmpty():
            return gone
        moved, n = moved_nodes(gone, target, b._next, b.config.tagger), gone.count()
        b._set(b.nodes.unionByName(moved), added=moved)
        b._next += n
        a._set(N.without_ids(a.nodes, gone), gone=gone)
        return moved

    def to_json(self) -> dict:
        from ..sources import snapshot

        return snapshot.memory_to_object(self)

    def load(self, state: dict | str) -> None:
        from ..sources import snapshot

        snapshot.load_memory(self, json.loads(state) if isinstance(state, str) else state)

    def clear(self) -> None:
        for p in self._pools.values():
            p.clear()


def moved_nodes(nodes: DataFrame, target: str, first_seq: int, tagger) -> DataFrame:
    """The nodes as ones of another pool, from first_seq on in their order, tagged anew."""
    rows = numbered(nodes, [F.col("seq"), F.col("pool"), F.col("id")], "__place", first_seq)
    node = {"id": F.col("id"), "pool": F.lit(target), "content_json": F.col("content_json"), "content_text": F.col("content_text")}
    tags, terms = N.tags_by(tagger, node, F.lit("{}"))
    return rows.select(*[{"pool": F.lit(target), "seq": F.col("__place"), "tags_json": tags, "keywords": terms}.get(c, F.col(c)).alias(c) for c in N.COLUMNS])


def _terms(nodes: DataFrame) -> DataFrame:
    return nodes.select("pool", "id", F.col("keywords").alias("terms"))
