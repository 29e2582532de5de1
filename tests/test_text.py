import pytest
from pyspark.sql import functions as F

from nodepool.functions import text as X
from nodepool.functions.flatten import flatten, flatten_json, flatten_value
from nodepool.operators.engines import KeywordTagger

STEMS = {
    "indexing": "index", "indexed": "index", "splitting": "split", "categories": "category", "boxes": "box", "classes": "class", "nodes": "nod",
    "node": "node", "times": "tim", "meetings": "meeting", "meeting": "meet", "passed": "pas", "pass": "pass", "calling": "cal", "series": "sery",
    "movies": "movy", "string": "str", "speed": "spe", "ties": "tie", "need": "need", "using": "using", "thing": "thing", "seedings": "seeding", "wills": "will",
}


def terms(spark, text, **options):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(X.terms(F.col("t"), **options).alias("k")).first().k


def test_stems(spark):
    df = spark.createDataFrame(list(STEMS.items()), "w string, s string")
    assert [r for r in df.select("w", "s", X.stem(F.col("w")).alias("got")).collect() if r.got != r.s] == []


def test_terms_keep_order_and_drop_repeats_short_and_stopped(spark):
    assert terms(spark, "The cats, an owl and CATS (owl's nest) café") == ["cat", "owl", "nest", "caf"]
    assert terms(spark, None) == [] == terms(spark, "") == terms(spark, "?! -- é")


def test_options(spark):
    assert terms(spark, "an ox and oxen", min_length=2, stopwords=()) == ["an", "ox", "and", "oxen"]
    assert terms(spark, "running dogs", stemmer=None) == ["running", "dogs"]
    assert terms(spark, "alpha beta", stemmer=lambda w: F.when(w == "beta", F.lit("")).otherwise(w)) == ["alpha"]


def test_query_and_content_share_the_steps(spark):
    t = KeywordTagger()
    df = spark.createDataFrame([("indexed splitting",)], "t string")
    row = df.select(t.keywords(F.col("t")).alias("a"), t.query_terms(F.lit("splits indexing")).alias("b")).first()
    assert set(row.a) == set(row.b) == {"index", "split"}


@pytest.mark.parametrize("value, text", [
    (None, ""), ("x", "x"), (100, "100"), (100.0, "100"), (1.5, "1.5"), (True, "true"), (["a", ["b", {"c": "d"}]], "a b d"),
    ({"user": "u", "assistant": None}, "u "), ({"b": "x", "2": "y", "1": "z"}, "z y x"), ([], ""), ({}, ""),
])
def test_flatten_value(value, text):
    assert flatten_value(value) == text


def test_flatten_by_type_and_by_json_agree(spark):
    df = spark.sql("""SELECT named_struct('a', 'x', 'n', 12345678D, 'l', array('p', NULL, 'q'), 'm', map('k', true), 'none', CAST(NULL AS STRING)) AS c""")
    typed = df.select(flatten(F.col("c"), df.schema["c"].dataType).alias("t")).first().t
    raw = spark.createDataFrame([('{"a":"x","n":12345678,"l":["p",null,"q"],"m":{"k":true},"none":null}',), (None,)], "j string")
    by_json = [r.t for r in raw.select(flatten_json(F.col("j")).alias("t")).collect()]
    assert typed == by_json[0] == "x 12345678 p  q true " and by_json[1] is None
