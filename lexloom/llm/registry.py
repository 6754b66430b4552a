"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, html_text, language_id, line_dedup, mixing, paragraph_dedup, quality_classifier, quality_rules, simhash, substring_dedup

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_suffix_dedup": substring_dedup.op2_suffix_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_html_text": html_text.op4_html_text,
    "op5_simhash": simhash.op5_simhash,
    "op6_mixing": mixing.op6_mixing,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_paragraph_dedup": paragraph_dedup.op8_paragraph_dedup,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
SQL = {
    "op3_line_dedup": line_dedup.SQL,
    "op6_mixing": mixing.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op10_quality_rules": quality_rules.SQL,
}
