"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import bm25, chat, filter_audit, fingerprints, line_dedup, mixing, near_dedup, oracle, packing, pii, secrets, substring_dedup, toxicity, whitening


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_pii": pii.op2_pii,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_bm25": bm25.op4_bm25,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_minhash": near_dedup.op6_minhash,
        "op7_mixing": mixing.op7_mixing,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_chat": chat.op9_chat,
        "op10_fingerprints": fingerprints.op10_fingerprints,
        "op11_secrets": secrets.op11_secrets,
        "op12_whitening": whitening.op12_whitening,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": oracle.SUBSTRINGS,
        "op4_bm25": oracle.BM25,
        "op5_line_dedup": oracle.LINE_DEDUP,
        "op6_minhash": oracle.MINHASH,
        "op7_mixing": oracle.MIXING,
        "op13_filter_audit": oracle.FILTER_AUDIT,
    }
