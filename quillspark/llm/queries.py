"""The training-data queries, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, quality_rules
from .chat import op7_chat_formatting
from .decontaminate import op9_benchmark_decontamination
from .license_scan import op3_license_scan
from .line_crf import op5_quality_classifier
from .minhash_dedup import op10_minhash_near_dedup
from .packing import op8_best_fit_packing
from .quality_rules import op2_quality_rules
from .sharding import op6_sharding
from .substring_dedup import op4_substring_dedup
from .unigram import op1_token_counts

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scan": op3_license_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_sharding": op6_sharding,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

#: The others hold trained models, hashes, alignments, tokenizers, seeded generators or lookaround, which SQL can't express;
#: their tests compare them with brute force, exact round trips or held-out labels.
ORACLE_SQL = {
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op7_chat_formatting": chat.ORACLE_SQL,
}
