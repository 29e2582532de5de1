"""Pieces of DuckDB SQL that say independently what the engine computes."""

from __future__ import annotations

from ..functions.text import MIN_LENGTH, STOPWORDS
from ..operators.bm25 import Bm25Params

STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))


def _undouble(x: str) -> str:
    return f"CASE WHEN length({x}) > 1 AND right({x}, 1) = substr({x}, length({x}) - 1, 1) AND right({x}, 1) NOT IN ('a','e','i','o','u') THEN left({x}, length({x}) - 1) ELSE {x} END"


def stem(w: str) -> str:
    return (
        f"CASE WHEN length({w}) <= 3 THEN {w} "
        f"WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN {_undouble(f'left({w}, length({w}) - 3)')} "
        f"WHEN {w} LIKE '%ed' AND length({w}) > 4 THEN {_undouble(f'left({w}, length({w}) - 2)')} "
        f"WHEN {w} LIKE '%es' AND length({w}) > 4 THEN left({w}, length({w}) - 2) "
        f"WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def terms(source: str, key: str, text: str, name: str = "terms_of", stemmed: bool = True, min_length: int = MIN_LENGTH, stop: str = STOP) -> str:
    """CTE of (key..., term, pos): distinct terms and where each is first seen."""
    word = stem("w") if stemmed else "w"
    drop = f" AND w NOT IN ({stop})" if stop else ""
    return (
        f"{name}_w AS (SELECT {key}, unnest(l) AS w, unnest(range(len(l))) AS p FROM (SELECT {key}, {tokens(text)} AS l FROM {source}) x), "
        f"{name} AS (SELECT {key}, term, min(p) AS pos FROM (SELECT {key}, {word} AS term, p FROM {name}_w WHERE length(w) >= {min_length}{drop}) y WHERE term <> '' GROUP BY {key}, term)"
    )


def scored(nodes: str, queries: str, params: Bm25Params = Bm25Params(), text: str = "text") -> str:
    """CTEs up to scored(query_id, pool, id, score, raw), of nodes(pool, id, text) and
    queries(query_id, pool, text)."""
    p = params
    score = f"1.0 / (1.0 + exp(-{p.slope!r} * (raw / achievable - {p.inflection!r})))" if p.calibrated else "raw"
    return f"""
{terms(nodes, 'pool, id', text, 'nt')},
{terms(queries, 'query_id, pool', text, 'qt')},
lens AS (SELECT pool, id, CAST(count(*) AS DOUBLE) AS doc_len FROM nt GROUP BY pool, id),
stats AS (SELECT pool, CAST(count(*) AS DOUBLE) AS n, sum(doc_len) / count(*) AS mean FROM lens GROUP BY pool),
dfs AS (SELECT pool, term, CAST(count(*) AS DOUBLE) AS df FROM nt GROUP BY pool, term),
wt AS (SELECT q.query_id, q.pool, q.term, q.pos, ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) AS idf, s.mean
       FROM qt q JOIN dfs d USING (pool, term) JOIN stats s USING (pool)),
reach AS (SELECT query_id, pool, sum(idf ORDER BY pos) AS achievable FROM wt GROUP BY query_id, pool),
raws AS (SELECT w.query_id, w.pool, t.id,
                sum(w.idf * ({p.k1 + 1!r} / (1 + {p.k1!r} * ({1 - p.b!r} + {p.b!r} * l.doc_len / w.mean))) ORDER BY w.pos) AS raw
         FROM wt w JOIN nt t USING (pool, term) JOIN lens l ON l.pool = t.pool AND l.id = t.id GROUP BY w.query_id, w.pool, t.id),
scored AS (SELECT r.query_id, r.pool, r.id, {score} AS score, r.raw FROM raws r JOIN reach USING (query_id, pool))"""


def ranked(where: str = "TRUE", limit: int = 10, min_score: float = 0.0) -> str:
    """CTE ranked: the best of scored for each query and pool."""
    return (
        f"ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pool ORDER BY score DESC, id) AS rank FROM scored WHERE {where}) z "
        f"WHERE rank <= {limit} AND score >= {min_score!r})"
    )
