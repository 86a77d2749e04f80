"""The queries of this package and the SQL that each must agree with."""

from __future__ import annotations

from tessera.llm import chat_format, decontaminate, exact_dedup, html_extract, line_dedup, packing, pii, simhash, token_counts, toxicity

QUERIES = {
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_token_counts": token_counts.op7_token_counts,
    "op1_packing": packing.op1_packing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op5_html_extract": html_extract.op5_html_extract,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op8_pii": pii.op8_pii,
}
ORACLES = {
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op3_chat_format": chat_format.OP3_SQL,
}
