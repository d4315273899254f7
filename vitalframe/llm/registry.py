"""Queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import oracles
from .bpe_tree import op5_bpe_tree
from .embedding_dedup import op9_embedding_dedup
from .fingerprints import op7_fingerprints
from .kd_sharding import op10_kd_sharding
from .language_id import op3_language_id
from .mixing import op4_mixing
from .near_dedup import op1_minhash_dedup
from .packing import op13_packing
from .pii_surrogates import op8_pii_surrogates
from .prefix_trie import op12_prefix_trie
from .spelling import op11_spelling_variants
from .token_files import op6_token_files
from .toxicity import op2_toxicity

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_mixing": op4_mixing,
    "op5_bpe_tree": op5_bpe_tree,
    "op6_token_files": op6_token_files,
    "op7_fingerprints": op7_fingerprints,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_kd_sharding": op10_kd_sharding,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": oracles.NEAR_DUPLICATES,
    "op9_embedding_dedup": oracles.EMBEDDINGS,
    "op11_spelling_variants": oracles.SPELLING,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
}
