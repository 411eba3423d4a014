"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from . import exact_dedup, fingerprints, language_id, mixing, pieces, pii, repeats, simhash, token_counts, url_filter

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_repeats": repeats.op4_repeats,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_mixing": mixing.op6_mixing,
    "op7_pii": pii.op7_pii,
    "op8_simhash": simhash.op8_simhash,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_language_id": language_id.op10_language_id,
}
SQL = {"op1_url_filters": url_filter.OP1_SQL, "op2_exact_dedup": exact_dedup.OP2_SQL, "op7_pii": pii.OP7_SQL}
