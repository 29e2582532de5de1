import json

import pytest
from pyspark.sql import functions as F

from nodepool.operators.graph import DecayGraph
from nodepool.operators.pool import Memory, Pool, PoolConfig
from nodepool.sources import snapshot

NOTES = [
    {"id": "a", "content": "quarterly budget figures were presented"},
    {"id": "b", "content": {"user": "who fixes the sidebar", "assistant": "the frontend crew"}},
    {"id": "c", "content": None},
    {"id": "d", "content": "nothing to see", "tags": {"keywords": ["budget"]}},
]


class Clock:
    def __init__(self):
        self.t = 1000

    def __call__(self):
        return self.t


@pytest.fixture
def pool(spark):
    p = Pool(spark, "notes", PoolConfig(now=Clock()))
    p.create_many(NOTES)
    return p


def ids(df):
    return [r.id for r in df.collect()]


def test_search_and_tags(pool):
    assert set(ids(pool.search("budgets"))) == {"a", "d"}  # given tags win over content
    assert ids(pool.search("sidebars")) == ["b"] and ids(pool.search("the of")) == []
    assert pool.get("c").keywords is None and pool.size == 4


def test_batches_are_whole(pool):
    for bad in ([{"id": "e", "content": 1}, {"id": "a", "content": 2}], [{"id": "f", "content": 1}, {"id": "f", "content": 2}], [{"id": "g", "content": 1}, {"id": "h"}]):
        with pytest.raises(ValueError):
            pool.create_many(bad)
    assert pool.ids() == ["a", "b", "c", "d"]
    made = pool.create("text without an id").first()
    assert made.id.startswith("notes-") and pool.ids()[-1] == made.id
    with pytest.raises(ValueError):
        pool.create(id="x")
    with pytest.raises(ValueError):
        Pool(pool.spark, "")


def test_update(pool):
    pool.config.now.t = 2000
    pool.update("a", content="weather forecast")
    assert ids(pool.search("budget")) == ["d"] and ids(pool.search("forecasts")) == ["a"]
    row = pool.get("a")
    assert (row.created_at, row.updated_at, pool.ids()[0]) == (1000, 2000, "a")
    pool.update("d", metadata={"source": "x", "createdAt": 5})
    row = pool.get("d")
    assert row.keywords == ["budget"] and row.extra == {"source": "x"} and row.created_at == 5
    pool.update("d", tags={})
    assert "budget" not in pool.get("d").keywords
    with pytest.raises(KeyError):
        pool.update("nobody", content="x")


def test_evict(pool):
    seen = []
    pool.config.on_evict = lambda rows, p: seen.append(ids(rows))
    assert ids(pool.evict(["d", "nobody", "a", "a"])) == ["a", "d"] and seen == [["a", "d"]]
    assert ids(pool.evict(F.col("content_json").isNull())) == ["c"] and pool.ids() == ["b"]
    assert ids(pool.evict([])) == [] and len(seen) == 2
    pool.create_many([{"id": x, "content": x} for x in "xyz"])
    assert ids(pool.evict_oldest(2)) == ["b", "x"] and ids(pool.evict_oldest(0)) == [] == ids(pool.evict_oldest(float("nan")))

    def fail(rows, p):
        raise RuntimeError

    pool.config.on_evict = fail
    with pytest.raises(RuntimeError):
        pool.evict(["y"])
    assert pool.has("y")
    assert pool.remove("y") and not pool.remove("y") and pool.ids() == ["z"]
    pool.clear()
    assert pool.size == 0 and pool.list().isEmpty()


def test_removal_leaves_no_trace_in_scores(spark):
    def scores(p):
        return [(r.id, r.score) for r in p.rank("budget figures").collect()]

    p = Pool(spark, "p")
    p.create_many(NOTES)
    before = scores(p)
    p.create("budget budget figures and more", id="tmp")
    p.remove("tmp")
    assert scores(p) == before


def test_asker_gets_edges_and_is_left_out(spark):
    clock = Clock()
    m = Memory(spark, "main", PoolConfig(now=clock, graph=DecayGraph(100)))
    m.create_many([{"id": "q", "content": "budget question"}, {"id": "t", "content": "budget answer"}, {"id": "u", "content": "other"}])
    before = [(r.id, r.score) for r in m.rank("budget").collect()]
    assert [r.id for r in m.rank("budget", asker="q").collect()] == ["t"]
    assert [(r.id, r.direction, r.observed_at) for r in m.neighbors("q").collect()] == [("t", "to", 1000)]
    assert [(r.id, r.direction) for r in m.neighbors("t").collect()] == [("q", "from")]
    assert [(r.id, r.score) for r in m.rank("budget").collect()] == before  # edges don't rank
    m.rank("budget", asker="nobody").collect()
    m.rank("budget", asker="t", link=False).collect()
    assert m.neighbors("t").count() == 1
    clock.t = 1100
    assert m.neighbors("q").count() == 1  # the bound counts as in time
    clock.t = 1101
    assert m.neighbors("q").count() == 0


def test_memory(spark):
    m = Memory(spark, "main", PoolConfig(now=Clock()))
    m.create("alpha thing", id="x")
    m.pool("docs").create("beta thing", id="y")
    m.pool("docs").create("copy", id="x")
    assert m.pools() == ["main", "docs"] and m.get("x").pool == "main" and m.get("y").pool == "docs" and m.get("z") is None
    assert m.size == 3 and {r["pool"]: r.n for r in m.stats().collect()} == {"main": 1, "docs": 2}
    assert [(r.id, r.pools) for r in m.duplicate_ids().collect()] == [("x", ["docs", "main"])]
    assert m.link("x", "y", 7) and not m.link("x", "nobody") and m.link("x", "x")
    assert [(r.id, r.direction) for r in m.neighbors("x").collect()] == [("y", "to")]
    with pytest.raises(ValueError):
        m.drop_pool("main")
    assert m.pool("tmp").size == 0 and m.drop_pool("tmp") and not m.drop_pool("tmp") and not m.has_pool("tmp")
    hook = object()
    m.pool("docs", on_evict=hook)
    assert m.pool("docs").config.on_evict is hook and m.pool("docs", on_evict=None).config.on_evict is None
    m.move(["y"], "docs", "main")
    assert m.pool("main").ids() == ["x", "y"] and m.pool("docs").ids() == ["x"] and ids(m.search("betas")) == ["y"]


def test_snapshot_round_trip(spark):
    m = Memory(spark, "main", PoolConfig(now=Clock()))
    m.create_many([*NOTES, {"id": "e", "content": ["x", {"z": 1, "a": None}], "metadata": {"source": "s"}}])
    m.pool("docs").create('say "budget" twice', id="y")
    m.link("a", "y", 5)
    m.link("y", "b")
    state = m.to_json()
    assert [n["content"] for n in state["pools"][0]["nodes"]] == [*(n["content"] for n in NOTES), ["x", {"z": 1, "a": None}]]
    assert state["pools"][0]["nodes"][0]["graph"] == {"to": [{"id": "y", "observedAt": 5}], "from": []}
    assert state["pools"][0]["nodes"][2]["graph"] == {} and state["pools"][0]["nodes"][1]["graph"]["from"] == [{"id": "y"}]
    other = Memory(spark, "none", PoolConfig(now=Clock()))
    other.load(json.dumps(state))
    assert other.to_json() == state and set(ids(other.search("budget"))) == {"a", "d"}
    empty = Memory(spark)
    empty.load({})
    assert empty.size == 0 and empty.pools() == ["main"]


def test_snapshot_tables(spark, tmp_path, pool):
    snapshot.write_table(pool.nodes, str(tmp_path / "t"))
    back = snapshot.read_table(spark, str(tmp_path / "t"))
    assert sorted(map(str, back.collect())) == sorted(map(str, pool.nodes.collect()))
    assert "PartitionFilters: [isnotnull(pool" in back.filter("pool = 'notes'")._jdf.queryExecution().toString()
    snapshot.write_lines(pool.nodes, pool.edges.log, str(tmp_path / "lines"))
    lines = snapshot.read_lines(spark, str(tmp_path / "lines"), pool.config.tagger)
    assert {(r["pool"], r.id, r.content_json, tuple(r.keywords or ())) for r in lines.collect()} == {(r["pool"], r.id, r.content_json, tuple(r.keywords or ())) for r in pool.nodes.collect()}


class Fields:
    """A tagger that sees the node and writes a bucket of its own."""

    distinct = True

    def for_node(self, node):
        return F.to_json(F.struct(F.array(F.get_json_object(node["content_json"], "$.kind"), F.col("pool")).alias("fields")))

    def terms_of(self, tags_json):
        return F.from_json(F.get_json_object(tags_json, "$.fields"), "array<string>")

    def query_terms(self, text):
        return F.split(text, " ")


def test_tagger_sees_the_node(spark):
    p = Pool(spark, "zoo", PoolConfig(tagger=Fields()))
    p.create_many([{"id": "a", "content": {"kind": "cat"}}, {"id": "b", "content": {"kind": "dog"}}, {"id": "c", "content": {"kind": "cat"}, "tags": {"fields": ["bird"]}}, {"id": "d", "content": None}])
    assert ids(p.search("cat")) == ["a"] and ids(p.search("bird")) == ["c"] and json.loads(p.get("b").tags_json) == {"fields": ["dog", "zoo"]} and p.get("d").keywords is None
    p.update("a", content={"kind": "fish"})
    assert ids(p.search("fish")) == ["a"] and ids(p.search("cat")) == []


def test_graph_hook_writes_sweeps_and_reads(spark):
    seen = []

    class Graph(DecayGraph):
        def link(self, log, pairs):
            seen.append(("link", pairs.count()))
            return super().link(log, pairs.withColumn("observed_at", F.lit(77).cast("bigint")))

        def sweep(self, log, now, owners=None):
            seen.append(("sweep", sorted(r.id for r in owners.collect())))
            return super().sweep(log, now, owners)

    p = Pool(spark, "p", PoolConfig(now=Clock(), graph=Graph()))
    p.create_many([{"id": x, "content": f"budget {x}"} for x in "abc"])
    assert p.link("a", "b") and seen == [("link", 1)]
    p.rank("budget", asker="a")
    assert seen[1:] == [("sweep", ["a", "b", "c"]), ("link", 2)] and {(r.id, r.observed_at) for r in p.neighbors("a").collect()} == {("b", 77), ("c", 77)}
    seen.clear()
    assert {r.id for r in p.rank("budget", asker="nobody").collect()} == {"a", "b", "c"} and seen == []


def test_graph_bucket_of_a_node(spark):
    p = Pool(spark, "p", PoolConfig(now=Clock()))
    p.create_many([{"id": "a", "content": "x", "graph": {"to": [{"id": "b", "observedAt": 3}, {"id": "c"}], "from": [{"id": "d"}]}}, {"id": "b", "content": "y"}])
    assert [(r.id, r.direction, r.observed_at) for r in p.neighbors("a").collect()] == [("b", "to", 3), ("c", "to", None), ("d", "from", None)]
    p.update("a", graph={"to": [{"id": "z"}]})
    assert [(r.id, r.direction) for r in p.neighbors("a").collect()] == [("z", "to")]
    p.update("a", content="w")
    assert p.neighbors("a").count() == 1 and p.create("v", graph={"to": [{"id": "a"}]}).count() == 1


def test_sweep_keeps_what_is_alive(spark):
    from nodepool.operators import graph as G

    log = spark.createDataFrame([(1, "a", "to", "b", 0), (2, "a", "to", "c", 90), (3, "x", "to", "b", 0), (4, "a", "to", "b", 5), (5, "a", "to", "d", None), (6, "a", "to", "d", 1)], G.EDGES)
    graph = DecayGraph(50)
    got = graph.sweep(log, 100, spark.createDataFrame([("a",)], "id string"))
    assert sorted((r.owner, r.other, r.edge_seq) for r in got.collect()) == [("a", "c", 2), ("a", "d", 5), ("x", "b", 3)]
    many = spark.range(3000).selectExpr("id AS edge_seq", "'h' AS owner", "'to' AS direction", "'i' AS other", "id * 10 AS observed_at")
    assert [(r.edge_seq, r.observed_at) for r in graph.current(many, 30_000).collect()] == [(0, 29_990)]


def test_memory_in_batches(spark):
    m = Memory(spark, "main")
    m.create_many([{"id": x, "content": x} for x in "abc"])
    m.pool("docs").create("copy", id="a")
    asked = spark.createDataFrame([("a",), ("c",), ("nobody",)], "id string")
    assert sorted((r.id, r["pool"]) for r in m.get_many(asked).collect()) == [("a", "main"), ("c", "main")]
    assert m.pool("main").remove_many(asked) == 2 and m.pool("main").ids() == ["b"] and m.get("a").pool == "docs"


def test_exports():
    import nodepool

    assert all(hasattr(nodepool, n) for n in nodepool.__all__) and nodepool.DEFAULTS["bm25"].k1 == 1.2


def test_an_index_is_sorted_once_it_is_read_again(spark):
    pool = Pool(spark, "p")
    pool.create_many([{"id": f"d{i}", "content": "lamp river" if i % 2 else "stone river"} for i in range(6)])
    asks = spark.createDataFrame([("q", "lamp stone river")], "query_id string, text string")
    first = pool.rank_many(asks).orderBy("rank").collect()
    assert pool.index.by_term is None and len(first) == 6
    assert pool.rank_many(asks).orderBy("rank").collect() == first and pool.index.by_term is not None
