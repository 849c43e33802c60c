"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import OP2_SQL, op2_one_bit_neighbours
from .bpe import op4_bpe_round_trip
from .centroids import OP12_SQL, op12_ptolemaic_clusters
from .simhash import op5_simhash_components
from .lattice import op6_lattice_scores
from .mixing import OP7_SQL, op7_mix_sources
from .quality import OP3_SQL, op3_line_frequency_rules
from .rollup import op9_token_rollup
from .secrets import op11_secret_spans
from .sharding import OP10_SQL, op10_extendible_shards
from .suffix import op8_suffix_removal
from .token_store import op1_token_id_output
from .whitening import op13_whitened_embeddings

QUERIES = {
    "op1_token_id_output": op1_token_id_output,
    "op2_one_bit_neighbours": op2_one_bit_neighbours,
    "op3_line_frequency_rules": op3_line_frequency_rules,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_simhash_components": op5_simhash_components,
    "op6_lattice_scores": op6_lattice_scores,
    "op7_mix_sources": op7_mix_sources,
    "op8_suffix_removal": op8_suffix_removal,
    "op9_token_rollup": op9_token_rollup,
    "op10_extendible_shards": op10_extendible_shards,
    "op11_secret_spans": op11_secret_spans,
    "op12_ptolemaic_clusters": op12_ptolemaic_clusters,
    "op13_whitened_embeddings": op13_whitened_embeddings,
}

ORACLE_SQL = {
    "op2_one_bit_neighbours": OP2_SQL,
    "op3_line_frequency_rules": OP3_SQL,
    "op7_mix_sources": OP7_SQL,
    "op10_extendible_shards": OP10_SQL,
    "op12_ptolemaic_clusters": OP12_SQL,
}
