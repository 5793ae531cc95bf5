"""Queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from sourcewise.llm import byte_bpe, chat_format, collocations, decontaminate, fill_in_middle, html_text, licenses, near_dup, pii, quality, substring_dedup, suffix_dedup, token_files

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_html_text": html_text.op2_html_text,
    "op3_chat_format": chat_format.op3_chat_format,
    "tool_call_links": chat_format.tool_call_links,
    "op4_pii": pii.op4_pii,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_token_files": token_files.op7_token_files,
    "op8_near_dup": near_dup.op8_near_dup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_licenses": licenses.op10_licenses,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}
ORACLE_SQL = {
    "tool_call_links": chat_format.TOOL_CALL_LINKS_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op11_suffix_dedup": suffix_dedup.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
