"""Queries of the corpus operators and their oracles."""

from __future__ import annotations

from triagewright.llm.alignment import op12_token_alignment
from triagewright.llm.chat import OP2_SQL, op2_chat_format
from triagewright.llm.decontaminate import OP4_SQL, op4_decontaminate
from triagewright.llm.fingerprints import op1_fingerprints
from triagewright.llm.language import op9_language
from triagewright.llm.lm import op13_lm_scores
from triagewright.llm.mixing import op10_mixing
from triagewright.llm.repair import OP11_SQL, op11_repair
from triagewright.llm.secrets import op6_secrets
from triagewright.llm.simhash import op8_simhash
from triagewright.llm.suffix_dedup import op3_suffix_dedup
from triagewright.llm.token_counts import op5_token_counts
from triagewright.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_chat_format": op2_chat_format,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_language": op9_language,
    "op10_mixing": op10_mixing,
    "op11_repair": op11_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_lm_scores": op13_lm_scores,
}
ORACLE_SQL = {"op2_chat_format": OP2_SQL, "op4_decontaminate": OP4_SQL, "op11_repair": OP11_SQL}
