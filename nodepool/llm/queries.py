"""The registered queries of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from .bpe import op4_byte_bpe
from .chroma import op1_chroma_fingerprints
from .digest import op9_improbable_features
from .lexicon import op7_toxicity_lexicon
from .mil import op6_quality_mil
from .oddsketch import op8_minhash_odd_sketch
from .packing import op10_retrieval_packing
from .tokens import op5_token_parquet
from .warc import OP3_SQL, op3_warc_revisits
from .wrapper import op2_wrapper_induction

QUERIES = {
    "op1_chroma_fingerprints": op1_chroma_fingerprints,
    "op2_wrapper_induction": op2_wrapper_induction,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_parquet": op5_token_parquet,
    "op6_quality_mil": op6_quality_mil,
    "op7_toxicity_lexicon": op7_toxicity_lexicon,
    "op8_minhash_odd_sketch": op8_minhash_odd_sketch,
    "op9_improbable_features": op9_improbable_features,
    "op10_retrieval_packing": op10_retrieval_packing,
}

ORACLE_SQL: dict[str, str] = {"op3_warc_revisits": OP3_SQL}
