"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, conversation_repair, fingerprint, language_id, line_dedup, near_dedup, neighbours, packing, pii, sp_dropout, token_store, url_filter, weak_rules

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_pii": pii.op2_pii,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_sp_dropout": sp_dropout.op4_sp_dropout,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_token_store": token_store.op6_token_store,
    "op7_quality_classifier": neighbours.op7_quality_classifier,
    "op8_quality_rules": weak_rules.op8_quality_rules,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_packing": packing.op10_packing,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_alignment": alignment.op12_alignment,
    "op13_language_id": language_id.op13_language_id,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.ORACLE_SQL,
    "op9_near_dedup": near_dedup.ORACLE_SQL,
}
