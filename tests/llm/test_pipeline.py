import random
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline as P

from .test_models import TOXIC
from .test_similar import changed, text_of

SF = Path("/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, rows, labels = random.Random(12), [], []
    for i in range(400):
        text = text_of(rng, rng.randint(60, 120)) + "."
        toxic, poor = i % 8 == 0, i % 8 == 1
        if toxic:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
            text = " ".join(words)
        if poor:
            text = " ".join(rng.choice(["$$$", "###", "%%%", "!!!"]) for _ in range(150))
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(1000 + i, changed(rng, rows[i][1], 1), "en", "s", 1) for i in range(2, 400, 40)] + [(2000, None, None, None, None)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    left = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 3:
            docs, _ = P.C.written(out, "stage")
            assert docs.columns == COLUMNS
            left.append({r.doc_id for r in docs.collect()})
    bad = lambda ids, k: sum(i % 8 == k for i in ids if i < 400)
    assert bad(left[0], 0) <= 1 and len(left[0]) >= 361 - 1
    assert bad(left[1], 1) <= 1 and sum(i % 8 > 1 for i in left[1] if i < 400) == 300
    assert not {1000 + i for i in range(2, 400, 40)} & left[2]
    assert {i for i in left[1] if i < 400} == {i for i in left[2] if i < 400} and 2000 in left[0]
    packed = {d for r in out.collect() for d in r.doc_ids}
    assert packed == left[2] - {2000}
    whole = P.run(spark, sf_dir).collect()
    assert sorted(map(str, whole)) == sorted(map(str, out.collect()))


def test_clashing_columns_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 8 > 1").selectExpr("*", "'k' AS keep", "doc_id AS toxic", "'s' AS score", "1.5 AS quality_score", "array(1) AS `own.0`")
    for _, stage in P.STAGES[:3]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes
        row = out.orderBy("doc_id").filter("doc_id IS NOT NULL").first()
        assert (row.keep, row.toxic, row.score, float(row.quality_score)) == ("k", row.doc_id, "s", 1.5)


def test_stages_send_small_batches_to_python(spark, sf_dir):
    """a split went to a worker whole, with the lowered text beside the text."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    long = spark.range(4000, numPartitions=1).selectExpr("repeat('abc ', 1000) AS text", "repeat('ABC ', 1000) AS low")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for _, stage in P.STAGES[:3]:
            spark.conf.set(key, own)
            stage(spark, docs, sf_dir)
            got = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
            assert max(got) < P.C.BATCH_BYTES + 20_000 and sum(got) >= 4000 * 8000
        spark.conf.set(key, "1m")
        P.C.bound_batches(spark)
        assert spark.conf.get(key) == "1m"
        with P.C.small_batches(spark):
            pass
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, own)


def test_empty(spark, sf_dir, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
