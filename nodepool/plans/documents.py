"""Queries over documents: terms, the index's counts, and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.flatten import flatten, flatten_json
from ..operators import bm25
from ..operators import nodes as N
from ..operators.engines import Bm25Engine, CosineEngine, KeywordTagger
from ..operators.pool import Pool, PoolConfig
from ..sources.shared import small, spread
from . import sql as S

TAGGER = KeywordTagger()
#: Tables whose texts are worth all cores.
TEXTS = ("documents", "conversations", "pages")
QUERY = "thing ertions and the erbles that onings reing zzznowhere"
PARAMS = bm25.Bm25Params(k1=1.6, b=0.75, inflection=0.4, slope=9.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name in TEXTS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, pool="documents", tagger=TAGGER) -> DataFrame:
    """Nodes (pool, id, terms) of all documents; pool is a name or a column."""
    p = F.lit(pool) if isinstance(pool, str) else pool
    return table(spark, sf_dir, "documents").select(p.alias("pool"), F.col("doc_id").cast("string").alias("id"), tagger.keywords(F.col("text")).alias("terms"))


def asked(spark: SparkSession, texts: list[tuple[str, str, str]], tagger=TAGGER) -> DataFrame:
    """Queries (query_id, pool, terms) from (query_id, pool, text)."""
    rows = spark.createDataFrame(texts, "query_id string, pool string, text string")
    return rows.select("query_id", "pool", tagger.query_terms(F.col("text")).alias("terms"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("score", 6).alias("score"), F.round("raw", 6).alias("raw"))


NODES = "nodes AS (SELECT 'documents' AS pool, CAST(doc_id AS VARCHAR) AS id, text FROM documents)"
ONE = f"queries AS (SELECT 'q' AS query_id, 'documents' AS pool, '{QUERY}' AS text)"
DOC = S.terms("documents", "doc_id", "text", "dt")
OUT = "round(score, 6) AS score, round(raw, 6) AS raw"


def q_tokens(spark, sf_dir):
    """All token runs of each document."""
    t = X.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


def q_stem(spark, sf_dir):
    """Every distinct token and its stem."""
    words = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token")).distinct()
    return words.select("token", X.stem(F.col("token")).alias("stem"))


def q_keywords(spark, sf_dir):
    k = TAGGER.keywords(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(k).cast("bigint").alias("n_terms"), F.array_join(k, " ").alias("keywords"))


def q_keyword_options(spark, sf_dir):
    """Other options: words of five letters on, two stopwords, no stemming."""
    k = KeywordTagger(min_length=5, stopwords=frozenset({"thing", "ering"}), stemmer=None).keywords(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(k), " ").alias("keywords"))


def q_flatten(spark, sf_dir):
    """Content of a struct to text: values only."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("role", "text", F.struct(F.col("turn").cast("double").alias("n"), F.lit(None).cast("string").alias("none")).alias("more")).alias("content"))
    return df.select("conv_id", "turn", flatten(F.col("content"), df.schema["content"].dataType).alias("content_text"))


def q_tf(spark, sf_dir):
    """Term frequencies where terms may repeat: all stems of a document, not only distinct ones."""
    all_stems = F.transform(F.filter(X.tokens(F.col("text")), lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(X.STOPWORDS))), X.stem)
    nodes = table(spark, sf_dir, "documents").select(F.col("lang").alias("pool"), F.col("doc_id").cast("string").alias("id"), all_stems.alias("terms"))
    return bm25.build_index(nodes, distinct=False).postings().select("pool", "id", "term", "tf", "doc_len")


def q_df(spark, sf_dir):
    return bm25.build_index(documents(spark, sf_dir)).document_frequency()


def q_doclen(spark, sf_dir):
    return bm25.build_index(documents(spark, sf_dir)).docs.select("pool", "id", "doc_len")


def q_stats(spark, sf_dir):
    return bm25.build_index(documents(spark, sf_dir, F.col("lang"))).stats()


def q_idf(spark, sf_dir):
    index = bm25.build_index(documents(spark, sf_dir))
    rows = index.document_frequency().join(small(index.stats()), "pool")
    return rows.select("term", "df", F.round(bm25.idf(F.col("n_docs"), F.col("df")), 9).alias("idf"))


def _rank(spark, sf_dir, params=bm25.Bm25Params(), limit=10, min_score=0.0, text=QUERY):
    found = bm25.score(asked(spark, [("q", "documents", text)]), bm25.build_index(documents(spark, sf_dir)), params)
    return rounded(bm25.top_one_query(found, limit, min_score), "id")


def _rank_sql(params=bm25.Bm25Params(), limit=10, min_score=0.0):
    return f"WITH {NODES}, {ONE}, {S.scored('nodes', 'queries', params)}, {S.ranked('TRUE', limit, min_score)} SELECT id, {OUT} FROM ranked"


def q_rank(spark, sf_dir):
    """The flagship: the ten best documents for one query."""
    return _rank(spark, sf_dir)


def q_rank_raw(spark, sf_dir):
    return _rank(spark, sf_dir, bm25.Bm25Params(calibrated=False))


def q_rank_params(spark, sf_dir):
    return _rank(spark, sf_dir, PARAMS)


def q_minscore(spark, sf_dir):
    return _rank(spark, sf_dir, limit=1000, min_score=0.25)


def q_no_match(spark, sf_dir):
    """Stopwords and unknown words only: no rows."""
    return _rank(spark, sf_dir, text="the and zzznowhere of")


def q_search(spark, sf_dir):
    """Search gives the nodes themselves."""
    hits = _rank(spark, sf_dir, limit=5)
    docs = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    return docs.join(small(hits), "id").select("id", "lang", "source", "text")


def q_rank_batch(spark, sf_dir):
    """Every benchmark item as a query, the five best documents of each."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.lit("documents").alias("pool"), TAGGER.query_terms(F.col("text")).alias("terms"))
    found = Bm25Engine(distinct=True).search(queries, documents(spark, sf_dir), 5)
    return rounded(found, "query_id", "rank", "id")


def q_exclude_asker(spark, sf_dir):
    """Every benchmark item asks for the document of its number: that one counts in the
    pool's figures, but isn't among the three results."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    queries = items.select("query_id", F.lit("documents").alias("pool"), TAGGER.query_terms(F.col("text")).alias("terms"))
    found = Bm25Engine(distinct=True).search(queries, documents(spark, sf_dir), 3, 0.0, items.select("query_id", F.col("query_id").alias("asker_id")))
    return rounded(found, "query_id", "rank", "id")


LANGS = ("en", "de", "fr", "es")
POOL_QUERIES = [("q", lang, QUERY + " nicht mente queque") for lang in LANGS]


def _pools(spark, sf_dir):
    return Bm25Engine(distinct=True).search(asked(spark, POOL_QUERIES), documents(spark, sf_dir, F.col("lang")), 5)


def q_pools(spark, sf_dir):
    """One query in four pools: each has counts of its own."""
    return rounded(_pools(spark, sf_dir), "pool", "rank", "id")


def q_merge(spark, sf_dir):
    """Results of the four pools on one scale."""
    return bm25.merged(_pools(spark, sf_dir)).select("pool", "id", F.round("relative", 6).alias("relative"))


def q_structural(spark, sf_dir):
    """Nodes without content are there but neither counted nor found."""
    docs = table(spark, sf_dir, "documents").withColumn("content", F.when(F.col("source") != "src0", F.col("text")))
    pool = Pool(spark, "documents").adopt(N.from_table(docs, "documents", F.col("doc_id"), "content", F.col("doc_id"), TAGGER))
    return rounded(pool.rank_many(one_query(spark)), "id")


def q_vector(spark, sf_dir):
    """Another engine: the five nearest vectors by cosine of each label's first."""
    vectors = table(spark, sf_dir, "embeddings").select(F.lit("v").alias("pool"), F.col("vec_id").cast("string").alias("id"), "vec_id", "label", F.col("embedding").alias("vector"))
    first = vectors.groupBy("label").agg(F.min_by("vector", "vec_id").alias("vector"), F.min("vec_id").cast("string").alias("asker_id"))
    queries = first.select(F.col("label").cast("string").alias("query_id"), F.lit("v").alias("pool"), "vector", "asker_id")
    found = CosineEngine().search(queries, vectors, 5, -1.0, queries.select("query_id", "asker_id"))
    return found.select("query_id", "rank", "id", F.round("score", 5).alias("score"))


class FieldTagger:
    """Tags a node with two fields of its content, and finds it by them."""

    distinct = True

    def for_node(self, node):
        value = lambda k: F.get_json_object(node["content_json"], f"$.{k}")
        return F.to_json(F.struct(F.array(value("lang"), value("source")).alias("fields")))

    def terms_of(self, tags_json):
        return F.from_json(F.get_json_object(tags_json, "$.fields"), "array<string>")

    def query_terms(self, text):
        return F.split(text, " ")


def q_custom_tagger(spark, sf_dir):
    """Another tagger: terms are the language and source of a document, from its tags."""
    docs = table(spark, sf_dir, "documents").withColumn("content", F.struct("lang", "source", "text"))
    nodes = N.from_table(docs, "d", F.col("doc_id"), "content", F.col("doc_id"), FieldTagger())
    pool = Pool(spark, "d", PoolConfig(tagger=FieldTagger())).adopt(nodes)
    return rounded(pool.rank_many(spark.createDataFrame([("q", "fr src5")], "query_id string, text string")), "rank", "id")


def one_query(spark):
    return spark.createDataFrame([("q", QUERY)], "query_id string, text string")


def _pool_of_documents(spark, sf_dir, **config):
    docs = table(spark, sf_dir, "documents")
    return Pool(spark, "documents", PoolConfig(**config)).adopt(N.from_table(docs, "documents", F.col("doc_id"), "text", F.col("doc_id"), TAGGER))


def q_pool_rank(spark, sf_dir):
    """A pool's own search: the asker is left out, one that is no node counts as none."""
    pool = _pool_of_documents(spark, sf_dir, now=lambda: 5)
    asks = spark.createDataFrame([("known", QUERY, "7"), ("stranger", QUERY, "nobody"), ("none", QUERY, None)], "query_id string, text string, asker_id string")
    found = pool.rank_many(asks, 50)
    edges = pool.edges.log.groupBy(F.col("other").alias("id")).agg(F.count("*").alias("n_edges"))
    return rounded(found.join(edges, "id", "left").fillna(0, "n_edges"), "query_id", "rank", "id", "n_edges")


def q_index_upkeep(spark, sf_dir):
    """An index that a search made, and that follows what is added, changed and taken out."""
    docs = N.from_table(table(spark, sf_dir, "documents"), "documents", F.col("doc_id"), "text", F.col("doc_id"), TAGGER)
    first = docs.filter("seq % 3 <> 0")
    index = Bm25Engine(distinct=True).index(first.select("pool", "id", F.col("keywords").alias("terms")))
    index = index.add(docs.filter("seq % 3 = 0").select("pool", "id", F.col("keywords").alias("terms"))).remove(docs.filter("seq % 5 = 0").select("id"))
    found = Bm25Engine(distinct=True).search(asked(spark, [("q", "documents", QUERY)]), index, 20)
    return rounded(found, "rank", "id").withColumn("n_docs", F.lit(index.size).cast("bigint"))


def q_raw_json(spark, sf_dir):
    """Content that is JSON text: flattened by its own order of keys, numbers as JavaScript writes them."""
    return table(spark, sf_dir, "events").select("event_id", flatten_json(F.concat(F.lit('{"type":"'), "event_type", F.lit('","list":[1,2.0,null,{"z":true}],"n":'), F.col("event_id").cast("string"), F.lit("}"))).alias("content_text"))


_ALL_STEMS = f"SELECT lang AS pool, CAST(doc_id AS VARCHAR) AS id, {S.stem('w')} AS term FROM (SELECT lang, doc_id, unnest({S.tokens('text')}) AS w FROM documents) x WHERE length(w) >= 3 AND w NOT IN ({S.STOP})"
_ITEMS = "queries AS (SELECT CAST(item_id AS VARCHAR) AS query_id, 'documents' AS pool, text FROM benchmark)"
_POOLS = "VALUES " + ", ".join(f"('{q}', '{p}', '{t}')" for q, p, t in POOL_QUERIES)
_POOL_CTE = f"nodes AS (SELECT lang AS pool, CAST(doc_id AS VARCHAR) AS id, text FROM documents), queries AS (SELECT * FROM ({_POOLS}) v(query_id, pool, text)), {S.scored('nodes', 'queries')}, {S.ranked('TRUE', 5)}"
_DOT = "list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"

QUERIES = {f.__name__: f for f in (
    q_tokens, q_stem, q_keywords, q_keyword_options, q_flatten, q_tf, q_df, q_doclen, q_stats, q_idf, q_rank, q_rank_raw, q_rank_params, q_minscore,
    q_no_match, q_search, q_rank_batch, q_exclude_asker, q_pools, q_merge, q_structural, q_vector, q_custom_tagger, q_pool_rank, q_index_upkeep, q_raw_json,
)}

_ASKS = "queries AS (SELECT * FROM (VALUES " + ", ".join(f"('{q}', 'documents', '{QUERY}')" for q in ("known", "stranger", "none")) + ") v(query_id, pool, text))"
_UPKEEP = "nodes AS (SELECT 'documents' AS pool, CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE doc_id % 5 <> 0)"

ORACLE_SQL = {
    "q_pool_rank": f"WITH {NODES}, {_ASKS}, {S.scored('nodes', 'queries')}, {S.ranked("NOT (query_id = 'known' AND id = '7')", 50)} SELECT query_id, rank, id, CAST(CASE WHEN id IN (SELECT id FROM ranked WHERE query_id = 'known') THEN 1 ELSE 0 END AS BIGINT) AS n_edges, {OUT} FROM ranked",
    "q_index_upkeep": f"WITH {_UPKEEP}, {ONE}, {S.scored('nodes', 'queries')}, {S.ranked('TRUE', 20)} SELECT rank, id, {OUT}, (SELECT count(*) FROM lens) AS n_docs FROM ranked",
    "q_raw_json": "SELECT event_id, event_type || ' 1 2  true ' || event_id AS content_text FROM events",
    "q_tokens": f"SELECT doc_id, CAST(len({S.tokens('text')}) AS BIGINT) AS n_tokens, array_to_string({S.tokens('text')}, ' ') AS tokens FROM documents",
    "q_stem": f"SELECT token, {S.stem('token')} AS stem FROM (SELECT DISTINCT unnest({S.tokens('text')}) AS token FROM documents) x",
    "q_keywords": f"WITH {DOC} SELECT d.doc_id, CAST(count(term) AS BIGINT) AS n_terms, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS keywords FROM documents d LEFT JOIN dt USING (doc_id) GROUP BY d.doc_id",
    "q_keyword_options": f"WITH {S.terms('documents', 'doc_id', 'text', 'dt', stemmed=False, min_length=5, stop="'thing', 'ering'")} SELECT d.doc_id, coalesce(string_agg(term, ' ' ORDER BY term), '') AS keywords FROM documents d LEFT JOIN dt USING (doc_id) GROUP BY d.doc_id",
    "q_flatten": "SELECT conv_id, turn, role || ' ' || text || ' ' || CAST(turn AS VARCHAR) || ' ' AS content_text FROM conversations",
    "q_tf": f"WITH s AS ({_ALL_STEMS}), l AS (SELECT pool, id, count(*) AS doc_len FROM s GROUP BY pool, id) SELECT s.pool, s.id, s.term, count(*) AS tf, any_value(l.doc_len) AS doc_len FROM s JOIN l ON l.pool = s.pool AND l.id = s.id GROUP BY s.pool, s.id, s.term",
    "q_df": f"WITH {DOC} SELECT 'documents' AS pool, term, count(*) AS df FROM dt GROUP BY term",
    "q_doclen": f"WITH {DOC} SELECT 'documents' AS pool, CAST(doc_id AS VARCHAR) AS id, count(*) AS doc_len FROM dt GROUP BY doc_id",
    "q_stats": f"WITH {S.terms('documents', 'lang, doc_id', 'text', 'dt')} SELECT lang AS pool, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total_len FROM (SELECT lang, doc_id, count(*) AS n FROM dt GROUP BY lang, doc_id) x GROUP BY lang",
    "q_idf": f"WITH {DOC}, n AS (SELECT count(DISTINCT doc_id) AS n FROM dt) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM (SELECT term, count(*) AS df FROM dt GROUP BY term) x CROSS JOIN n",
    "q_rank": _rank_sql(),
    "q_rank_raw": _rank_sql(bm25.Bm25Params(calibrated=False)),
    "q_rank_params": _rank_sql(PARAMS),
    "q_minscore": _rank_sql(limit=1000, min_score=0.25),
    "q_no_match": "SELECT CAST(doc_id AS VARCHAR) AS id, 0.0::DOUBLE AS score, 0.0::DOUBLE AS raw FROM documents WHERE FALSE",
    "q_search": f"WITH {NODES}, {ONE}, {S.scored('nodes', 'queries')}, {S.ranked('TRUE', 5)} SELECT r.id, d.lang, d.source, d.text FROM ranked r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.id",
    "q_rank_batch": f"WITH {NODES}, {_ITEMS}, {S.scored('nodes', 'queries')}, {S.ranked('TRUE', 5)} SELECT query_id, rank, id, {OUT} FROM ranked",
    "q_exclude_asker": f"WITH {NODES}, {_ITEMS}, {S.scored('nodes', 'queries')}, {S.ranked('id <> query_id', 3)} SELECT query_id, rank, id, {OUT} FROM ranked",
    "q_pools": f"WITH {_POOL_CTE} SELECT pool, rank, id, {OUT} FROM ranked",
    "q_merge": f"WITH {_POOL_CTE} SELECT pool, id, round(score / max(score) OVER (PARTITION BY pool), 6) AS relative FROM ranked",
    "q_structural": f"WITH nodes AS (SELECT 'documents' AS pool, CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE source <> 'src0'), {ONE}, {S.scored('nodes', 'queries')}, {S.ranked()} SELECT id, {OUT} FROM ranked",
    "q_vector": f"WITH f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label), s AS (SELECT CAST(f.label AS VARCHAR) AS query_id, CAST(n.vec_id AS VARCHAR) AS id, {_DOT.format('q.embedding', 'n.embedding')} / (sqrt({_DOT.format('q.embedding', 'q.embedding')}) * sqrt({_DOT.format('n.embedding', 'n.embedding')})) AS score FROM f JOIN embeddings q ON q.vec_id = f.vec_id JOIN embeddings n ON n.vec_id <> f.vec_id) SELECT query_id, rank, id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) x WHERE rank <= 5",
    "q_custom_tagger": """WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
c AS (SELECT CAST(count(*) FILTER (WHERE lang = 'fr') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE source = 'src5') AS DOUBLE) AS b FROM documents),
w AS (SELECT ln(1 + (n - a + 0.5) / (a + 0.5)) AS wa, ln(1 + (n - b + 0.5) / (b + 0.5)) AS wb FROM n, c),
s AS (SELECT CAST(doc_id AS VARCHAR) AS id, wa + wb AS achievable, (CASE WHEN lang = 'fr' THEN wa * (2.2 / (1 + 1.2 * (0.6 + 0.4 * 2.0 / 2.0))) ELSE 0 END) + (CASE WHEN source = 'src5' THEN wb * (2.2 / (1 + 1.2 * (0.6 + 0.4 * 2.0 / 2.0))) ELSE 0 END) AS raw FROM documents, w WHERE lang = 'fr' OR source = 'src5'),
t AS (SELECT id, raw, 1.0 / (1.0 + exp(-6.0 * (raw / achievable - 0.5))) AS score FROM s)
SELECT rank, id, round(score, 6) AS score, round(raw, 6) AS raw FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM t) x WHERE rank <= 10""",
}
