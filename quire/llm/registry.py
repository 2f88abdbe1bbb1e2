"""Queries of the training-data operators and their DuckDB twins, by name."""

from __future__ import annotations

from quire.llm.bpe import op8_byte_bpe
from quire.llm.decontaminate import OP3_SQL, op3_decontamination
from quire.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from quire.llm.jaccard import OP7_SQL, op7_jaccard_join
from quire.llm.licenses import op2_license_scan
from quire.llm.neighbours import op12_nearest_neighbours
from quire.llm.pii import op4_pii
from quire.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from quire.llm.quality import OP9_SQL, op9_quality_rules
from quire.llm.sharding import op1_sharding
from quire.llm.substrings import OP10_SQL, op10_substring_dedup
from quire.llm.token_counts import op5_token_counts
from quire.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_pii": op4_pii,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
