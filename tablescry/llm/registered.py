"""Queries of the training-text operators, and their SQL twins where SQL is quick enough over whole tables."""

from __future__ import annotations

from tablescry.llm.conversation_trie import OP11_SQL, op11_conversation_trie
from tablescry.llm.decontaminate import op4_decontaminate
from tablescry.llm.exact_search import OP5_SQL, op5_exact_search
from tablescry.llm.language_id import op6_language_id
from tablescry.llm.line_dedup import OP9_SQL, op9_line_dedup
from tablescry.llm.lm_scoring import op1_lm_scoring
from tablescry.llm.mixing import OP3_SQL, op3_mixing
from tablescry.llm.near_dup import op7_near_dup
from tablescry.llm.periodic_runs import op12_periodic_runs
from tablescry.llm.quality import op10_quality
from tablescry.llm.secret_scan import op13_secret_scan
from tablescry.llm.substring_dedup import op2_substring_dedup
from tablescry.llm.token_output import op8_token_output

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mixing": op3_mixing,
    "op4_decontaminate": op4_decontaminate,
    "op5_exact_search": op5_exact_search,
    "op6_language_id": op6_language_id,
    "op7_near_dup": op7_near_dup,
    "op8_token_output": op8_token_output,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_secret_scan": op13_secret_scan,
}
ORACLES: dict[str, str] = {"op3_mixing": OP3_SQL, "op5_exact_search": OP5_SQL, "op9_line_dedup": OP9_SQL, "op11_conversation_trie": OP11_SQL}
