"""Deterministic, explainable retrieval over pools of nodes, on Spark."""

from .functions.flatten import flatten, flatten_json, flatten_value
from .functions.text import STOPWORDS, stem, terms
from .operators.bm25 import Bm25Params, Index, build_index
from .operators.engines import Bm25Engine, CosineEngine, KeywordTagger
from .operators.graph import DecayGraph
from .operators.nodes import generated_id
from .operators.pool import Memory, Pool, PoolConfig

#: Every tunable value in one place to read; each lives with the code that uses it.
DEFAULTS = {"bm25": Bm25Params(), "keywords": KeywordTagger(), "graph": DecayGraph()}

__all__ = [
    "DEFAULTS", "STOPWORDS", "Bm25Engine", "Bm25Params", "CosineEngine", "DecayGraph", "Index", "KeywordTagger", "Memory", "Pool", "PoolConfig",
    "build_index", "flatten", "flatten_json", "flatten_value", "generated_id", "stem", "terms",
]
