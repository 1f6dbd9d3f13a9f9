"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, exact_dedup, fuzzy_lines, language_id, license_scan, ngram_join, piece_codec, secret_scan, suffix_dedup, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_fuzzy_lines": fuzzy_lines.op9_fuzzy_lines,
    "op10_piece_codec": piece_codec.op10_piece_codec,
}

SQL = {"op3_exact_dedup": exact_dedup.OP3_SQL}
