"""Groups of documents that are alike, from the buckets that they share.

A group is a connected component of the pairs that share a bucket and pass the check. All
such pairs count, but those that can't change a component aren't compared:

1. In each bucket the least document is the leader, and every other one is compared with
   it. Components of the pairs that pass are the first labels.
2. A bucket whose documents have one label is done: it could only add pairs inside a
   component. In the others every pair of documents with different labels is compared that
   has not been in step 1: those outside the bucket's largest label, with all that don't
   share their label. Pairs that pass join labels to the final groups.

A bucket of n documents, s of them outside its largest label, costs n comparisons in step
1 and at most s * n in step 2: n for a crowd of copies, n squared where all documents of
a bucket share it but none is like another. Large buckets are cut into blocks of BLOCK
documents, each with a task's share of the s * n, so no task gets a whole hot bucket. The
result doesn't depend on the documents' numbers or order.

Where a check of many pairs at once is given (within), step 2 sends it tiles, BLOCK
documents by BLOCK others of a bucket, in place of rows of pairs: what moves then grows
with the documents times their blocks, and a pair costs what the check of a tile makes of it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

BLOCK = 1024


def labelled(ids: DataFrame, label: DataFrame, column: str) -> DataFrame:
    """ids with `label`: the least of the component of the document in column, or itself."""
    named = label.select(F.col("b").alias(column), F.col("a").alias("label"))
    return ids.join(C.sized(named), column, "left").withColumn("label", F.coalesce("label", column))


def rest(tagged: DataFrame) -> DataFrame:
    """(a, b), a < b, once: the pairs of step 2, of rows (band, doc_id, leader, label)."""
    sizes = tagged.groupBy("band", "label").count()
    some = sizes.groupBy("band").agg(F.count("*").alias("labels"), F.sum("count").alias("n"), F.max(F.struct("count", "label")).alias("top")).filter("labels > 1")
    rows = tagged.join(some.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.col("top.label").alias("top")), "band").filter("doc_id <> leader")
    few = rows.filter("label <> top").select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("doc_id").alias("x"), F.col("label").alias("of"))
    own = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    pairs = own.join(few, ["band", "block"]).filter("label <> of AND (label = top OR doc_id < x)")
    return pairs.select(F.least("doc_id", "x").alias("a"), F.greatest("doc_id", "x").alias("b")).distinct()


def rest_in_tiles(tagged: DataFrame, values: DataFrame, within: Callable[[pa.Table], tuple[pa.Array, pa.Array]]) -> DataFrame:
    """(a, b), a < b, once: the pairs of step 2 that within finds alike. It gets tables (few,
    doc_id, label, value), and compares every row that is few with those that aren't and
    have another label; value comes from values (doc_id, value)."""
    sizes = tagged.groupBy("band", "label").count()
    some = sizes.groupBy("band").agg(F.count("*").alias("labels"), F.sum("count").alias("n"), F.max(F.struct("count", "label")).alias("top")).filter("labels > 1 AND n > 2")
    some = some.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("rows"), F.ceil((F.col("n") - F.col("top.count")) / BLOCK).cast("int").alias("columns"), F.col("top.label").alias("top"))
    held = tagged.join(some, "band").filter("doc_id <> leader").withColumn("hash", F.xxhash64("doc_id"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod("hash", F.col(n)).cast("int")
    own = held.select("band", of("rows").alias("row"), each("columns").alias("column"), F.lit(False).alias("few"), "doc_id", "label")
    few = held.filter("label <> top").select("band", each("rows").alias("row"), of("columns").alias("column"), F.lit(True).alias("few"), "doc_id", "label")
    pair = C.schema_of(tagged.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")), ["a", "b"], "none int").fields[:2]

    def run(tile: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(list(within(tile)), names=["a", "b"])

    found = own.unionByName(few).join(values, "doc_id").groupBy("band", "row", "column").applyInArrow(run, C.StructType(pair))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(rows: DataFrame, check: Callable[[DataFrame], DataFrame], values: DataFrame | None = None, within: Callable | None = None) -> DataFrame:
    """(b, a): each document that isn't the least of its group, and that least one, of
    rows (doc_id, band); check keeps of pairs (a, b), a < b, those that are alike. values
    and within, where given, do so for step 2 (see rest_in_tiles)."""
    spark = rows.sparkSession
    lead = rows.groupBy("band").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    led, led_path = C.written(rows.join(lead, "band"), "buckets")
    near, near_path = C.written(check(led.filter("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()), "pairs")
    label, _path = C.written(components(near), "labels")
    tagged = labelled(led, label, "doc_id")
    more, more_path = C.written(check(rest(tagged)) if within is None else rest_in_tiles(tagged, values, within), "pairs")
    ends = labelled(more, label, "a").select("b", F.col("label").alias("x"))
    joined = components(labelled(ends, label, "b").select(F.col("label").alias("b"), F.col("x").alias("a")))
    joined, _path = C.written(joined, "labels")
    for path in (led_path, near_path, more_path):
        C.remove_path(spark, path)
    last = C.sized(joined.select(F.col("b").alias("a"), F.col("a").alias("last")))
    moved = label.join(last, "a", "left").select("b", F.coalesce("last", "a").alias("a"))
    return moved.unionByName(joined)
