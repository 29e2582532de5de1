from nodepool.operators import graph as G


def log(spark, *links):
    rows = [(i, a, b, t) for i, (a, b, t) in enumerate(links)]
    return G.links(spark.createDataFrame(rows, "edge_seq bigint, from_id string, to_id string, observed_at bigint"))


def seen(df):
    return [(r.id, r.direction, r.observed_at) for r in df.orderBy("node_id", "ord").collect()]


def of(spark, edges, node, now=0, decay=None):
    return seen(G.DecayGraph(decay).neighbors(edges, now).filter(f"node_id = '{node}'"))


def test_two_halves_and_no_loops(spark):
    e = log(spark, ("a", "b", 1), ("c", "c", 1), ("c", "a", 2))
    assert of(spark, e, "a") == [("b", "to", 1), ("c", "from", 2)] and of(spark, e, "c") == [("a", "to", 2)]


def test_refresh_and_permanence(spark):
    e = log(spark, ("a", "b", 5), ("a", "b", 3), ("a", "c", 1), ("a", "c", None), ("a", "c", 9))
    assert of(spark, e, "a") == [("b", "to", 3), ("c", "to", None)]  # written last, not latest; permanent stays


def test_decay_is_inclusive_and_begins_anew(spark):
    e = log(spark, ("a", "b", 0), ("a", "c", 5), ("a", "b", 100))
    assert of(spark, e, "a", 110, 10) == [("b", "to", 100)]
    assert of(spark, e, "a", 111, 10) == []
    e = e.unionByName(log(spark, *[("x", "x", 0)] * 3, ("a", "c", 105)))
    assert [x[0] for x in of(spark, e, "a", 106, 10)] == ["b", "c"]  # each in the order of its new life


def test_only_existing(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    e = log(spark, ("a", "b", 1), ("a", "gone", 1))
    assert seen(G.DecayGraph().neighbors(e, 0, nodes).filter("node_id = 'a'")) == [("b", "to", 1)]
    pairs = spark.createDataFrame([(0, "a", "b", None), (1, "a", "gone", None)], "edge_seq bigint, from_id string, to_id string, observed_at bigint")
    assert G.existing(pairs, nodes).count() == 1


def test_lifetimes(spark):
    e = log(spark, ("a", "b", 0), ("a", "b", 10), ("a", "b", 21), ("a", "b", None)).filter("owner = 'a'")
    assert sorted((r.began, r.ended, r.n) for r in G.lifetimes(e, 10).collect()) == [(0, 20, 2), (21, 31, 1)]


def test_sweep_compacts(spark):
    e = log(spark, ("a", "b", 0), ("a", "b", 10), ("a", "c", 1))
    swept = G.DecayGraph(5).sweep(e, 12)
    assert swept.columns == e.columns and swept.count() == 2 and of(spark, swept, "a", 12, 5) == [("b", "to", 10)]


def test_a_sweeps_tasks_do_not_grow_with_the_log(spark, monkeypatch):
    from nodepool.sources import shared

    e = log(spark, *((f"n{i % 40}", f"m{i % 7}", i) for i in range(200)))
    owners = spark.createDataFrame([(f"n{i}",) for i in range(0, 40, 2)], "id string")
    say = lambda df: sorted(map(str, df.collect()))
    want = say(G.DecayGraph(50).sweep(e, 200, owners))
    monkeypatch.setattr(shared, "ROWS_A_TASK", 10)
    swept = G.DecayGraph(50).sweep(e, 200, owners)
    assert "hashpartitioning(owner" in (plan := swept._jdf.queryExecution().executedPlan().toString()) and ", 40), REPARTITION_BY_NUM" in plan
    assert say(swept) == want and len(want) > 100
