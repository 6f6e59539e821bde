"""Queries of the corpus operators, by name, and their SQL where there is one."""

from __future__ import annotations

from graphloom.llm.alignment import op13_token_alignment
from graphloom.llm.decontaminate import op1_decontamination
from graphloom.llm.html_text import op5_html_text
from graphloom.llm.language import op10_language_id
from graphloom.llm.minhash import op7_near_duplicates
from graphloom.llm.mixing import OP2_SQL, op2_mixing
from graphloom.llm.periodic import op11_periodic_runs
from graphloom.llm.private import op3_personal_data
from graphloom.llm.quotes import op9_chat_threads
from graphloom.llm.token_counts import op4_token_counts
from graphloom.llm.token_output import op8_token_output
from graphloom.llm.trie_bpe import op12_bpe_round_trip
from graphloom.llm.vectors import op6_near_vectors

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_personal_data": op3_personal_data,
    "op4_token_counts": op4_token_counts,
    "op5_html_text": op5_html_text,
    "op6_near_vectors": op6_near_vectors,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_token_output": op8_token_output,
    "op9_chat_threads": op9_chat_threads,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": OP2_SQL,
}
