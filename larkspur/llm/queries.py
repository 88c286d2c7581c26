"""The queries of this subpackage, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from larkspur.llm import chat, neardup, quality
from larkspur.llm.chat import op2_chat_formatting
from larkspur.llm.fingerprints import op7_document_fingerprints
from larkspur.llm.mixing import op4_source_mixing
from larkspur.llm.neardup import op10_minhash_near_duplicates
from larkspur.llm.packing import op5_best_fit_packing
from larkspur.llm.quality import op9_host_quality
from larkspur.llm.secrets import op3_secret_scan
from larkspur.llm.sstable import op1_sorted_token_tables
from larkspur.llm.suffixes import op8_repeated_strings
from larkspur.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_sorted_token_tables": op1_sorted_token_tables,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_secret_scan": op3_secret_scan,
    "op4_source_mixing": op4_source_mixing,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_repeated_strings": op8_repeated_strings,
    "op9_host_quality": op9_host_quality,
    "op10_minhash_near_duplicates": op10_minhash_near_duplicates,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": chat.OP2_SQL,
    "op9_host_quality": quality.OP9_SQL,
    "op10_minhash_near_duplicates": neardup.OP10_SQL,
}
