"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import license_scan
from .chat_pairs import OP5_SQL, op5_preference_format
from .conversation_repair import op13_conversation_repair
from .decontaminate import op1_decontaminate
from .minhash_dedup import op11_minhash_dedup
from .packing import op3_length_buckets
from .quality_rules import op7_mcd_quality
from .simhash import op8_simhash_dedup
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op6_suffix_dedup
from .token_files import op9_token_files
from .toxicity import op4_toxicity_chain
from .va_file import op12_va_file_clusters

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_length_buckets": op3_length_buckets,
    "op4_toxicity_chain": op4_toxicity_chain,
    "op5_preference_format": op5_preference_format,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mcd_quality": op7_mcd_quality,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_token_files": op9_token_files,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_va_file_clusters": op12_va_file_clusters,
    "op13_conversation_repair": op13_conversation_repair,
}

#: The others are held against brute force in tests/llm.
ORACLES = {"op5_preference_format": OP5_SQL, "op10_license_scan": license_scan.oracle()}
