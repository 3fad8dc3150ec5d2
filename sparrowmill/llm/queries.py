"""Queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, fingerprints, language_id, lexical_search, license_scan, lm_scoring, mixing, near_dedup, quality, secret_scan, spelling, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "fingerprint_neighbours": fingerprints.fingerprint_neighbours,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_warc": warc.op5_warc,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality": quality.op10_quality,
    "op11_lm_scoring": lm_scoring.op11_lm_scoring,
    "op12_spelling": spelling.op12_spelling,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLE_SQL = {
    "op3_chat_format": chat_format.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
    "op8_license_scan": license_scan.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op11_lm_scoring": lm_scoring.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
