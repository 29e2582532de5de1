"""What a pool's search is made of, and how to swap it.

A tagger has keywords(content_text) -> array Column, and query_terms(text) -> array
Column. One that writes other tags has for_node(node) -> JSON text of the whole bucket, where
node is a dict of Columns (id, pool, content_json, content_text), and terms_of(tags_json)
-> array Column. An engine has search(queries, nodes, limit, min_score, askers) -> ranked
rows; one that has index(nodes) as well gives an index that a pool keeps, adds to and takes
from (add, remove), and search gets it in place of the nodes; one with sorted_by_term() as
well is sorted at the second search.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import bm25


class Tagger(Protocol):
    distinct: bool

    def keywords(self, content_text: Column) -> Column: ...

    def query_terms(self, text: Column) -> Column: ...


class Engine(Protocol):
    def search(self, queries: DataFrame, nodes: DataFrame, limit: int, min_score: float, askers: DataFrame | None) -> DataFrame: ...


@dataclass(frozen=True)
class KeywordTagger:
    min_length: int = X.MIN_LENGTH
    stopwords: frozenset = X.STOPWORDS
    stemmer: Callable[[Column], Column] | None = X.stem
    distinct: bool = True

    def keywords(self, content_text: Column) -> Column:
        return X.terms(content_text, self.min_length, self.stopwords, self.stemmer)

    query_terms = keywords


@dataclass(frozen=True)
class Bm25Engine:
    params: bm25.Bm25Params = field(default_factory=bm25.Bm25Params)
    distinct: bool = False

    def search(self, queries, nodes, limit=10, min_score=0.0, askers=None):
        """nodes: (pool, id, terms), or an index of them."""
        held = nodes if isinstance(nodes, bm25.Index) else bm25.build_index(nodes, self.distinct)
        return bm25.best(queries, held, self.params, limit, min_score, askers)

    def index(self, nodes: DataFrame) -> bm25.Index:
        return bm25.build_index(nodes, self.distinct)


@dataclass(frozen=True)
class CosineEngine:
    """Ranks by the cosine of vectors: queries (query_id, pool, vector) against nodes (pool,
    id, vector). Exact: every node of a pool is compared with each query in it, so the cost is
    queries times nodes; the query side is broadcast while small."""

    def search(self, queries, nodes, limit=10, min_score=0.0, askers=None):
        from ..sources.shared import small

        def dot(x, y):
            return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, v: t + v)

        q = queries.select("query_id", "pool", F.col("vector").alias("qv"), F.sqrt(dot("vector", "vector")).alias("qn"))
        n = nodes.select("pool", "id", F.col("vector").alias("nv"), F.sqrt(dot("vector", "vector")).alias("nn"))
        value = dot("qv", "nv") / (F.col("qn") * F.col("nn"))
        both = small(q, 10_000).join(n, "pool").filter("qn > 0 AND nn > 0").select("query_id", "pool", "id", value.alias("score"))
        return bm25.top(both.withColumn("raw", F.col("score")), limit, min_score, askers)
