"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhound.llm.bpe import op3_speculative_bpe
from tallyhound.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from tallyhound.llm.language_id import op10_ftrl_language
from tallyhound.llm.lexical_search import OP13_SQL, op13_impact_search
from tallyhound.llm.line_dedup import OP11_SQL, op11_line_runs
from tallyhound.llm.media_sniff import op8_signature_sniffing
from tallyhound.llm.near_dedup import op9_lsh_forest
from tallyhound.llm.packing import op5_conflict_best_fit
from tallyhound.llm.phrases import OP12_SQL, op12_pivot_phrases
from tallyhound.llm.pii_surrogates import op1_surrogates
from tallyhound.llm.reshard import op2_flow_reshard
from tallyhound.llm.secret_scan import OP7_SQL, op7_secret_ownership
from tallyhound.llm.suffix_tree_lm import op4_suffix_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_surrogates, op2_flow_reshard, op3_speculative_bpe, op4_suffix_tree, op5_conflict_best_fit, op6_exact_dedup, op7_secret_ownership, op8_signature_sniffing,
        op9_lsh_forest, op10_ftrl_language, op11_line_runs, op12_pivot_phrases, op13_impact_search,
    )
}
ORACLE: dict[str, str] = {"op6_exact_dedup": OP6_SQL, "op7_secret_ownership": OP7_SQL, "op11_line_runs": OP11_SQL, "op12_pivot_phrases": OP12_SQL, "op13_impact_search": OP13_SQL}
