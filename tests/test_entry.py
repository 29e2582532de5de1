import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = Path("/root/testdata/sf0.001")


def test_every_query_of_the_engine_has_sql():
    from nodepool.plans import catalogue

    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL) and len(catalogue.QUERIES) > 40


def test_entry_without_the_llm_folder(tmp_path):
    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("nodepool.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "q_rank" in e.queries() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"] and e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["q_rank", "q_recall", "q_neighbors", "q_update"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from nodepool.plans import catalogue

    con = duckdb.connect()
    for t in ("documents", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, str(SF))
    columns = ", ".join(df.columns)
    want = con.execute(f"SELECT {columns} FROM ({catalogue.ORACLE_SQL[name]}) x").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_rank_plan_reads_only_what_it_needs(spark, monkeypatch):
    from nodepool.plans import documents
    from nodepool.sources import shared

    monkeypatch.setattr(shared, "SPREAD_BYTES", 0)  # as for tables that aren't small
    plan = documents.documents(spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan and "Python" not in plan


def test_small_tables_use_all_cores(spark):
    from nodepool.sources import shared

    assert shared.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_numbers_follow_the_order(spark):
    from pyspark.sql import functions as F

    from nodepool.sources import shared

    rows = shared.numbered(spark.range(1000).withColumn("k", F.col("id") % 7), [F.desc("k"), F.col("id")], "n", 5).collect()
    assert [r.n for r in sorted(rows, key=lambda r: (-r.k, r.id))] == list(range(5, 1005))
