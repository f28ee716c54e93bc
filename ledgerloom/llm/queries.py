"""The numbered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embeddings import OP2_SQL, op2_embedding_near_dedup
from .langid import op8_language_id
from .lines import OP12_SQL, op12_line_dedup
from .mixing import OP9_SQL, op9_mixing
from .packing import op7_best_fit_packing
from .prefixtrie import OP11_SQL, op11_conversation_prefix_trie
from .quality import OP10_SQL, op10_quality_rules
from .resampling import OP13_SQL, op13_importance_resampling
from .sharding import op6_sharding
from .simhash import op4_simhash_near_dedup
from .substring import OP3_SQL, op3_substring_dedup
from .toolcalls import OP1_SQL, op1_tool_call_linking
from .urlfilter import OP5_SQL, op5_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tool_call_linking": op1_tool_call_linking,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_sharding": op6_sharding,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_line_dedup": op12_line_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}

#: The others need XXH64, a tokenizer, a learned model or a hashed permutation; they are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_tool_call_linking": OP1_SQL,
    "op2_embedding_near_dedup": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op5_url_filters": OP5_SQL,
    "op9_mixing": OP9_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_conversation_prefix_trie": OP11_SQL,
    "op12_line_dedup": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
