"""The queries of this subpackage and their SQL, as the entry point registers them."""

from __future__ import annotations

from . import exact_dedup, fingerprints, language, mixing, near_dedup, pieces, repeats, secrets, token_counts, token_files

QUERIES = {
    "op1_fingerprints": fingerprints.query,
    "op2_pieces": pieces.query,
    "op3_token_files": token_files.query,
    "op4_near_dedup": near_dedup.query,
    "op5_secrets": secrets.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_language": language.query,
    "op8_token_counts": token_counts.query,
    "op9_repeats": repeats.query,
    "op10_mixing": mixing.query,
}

#: A vocabulary, a lattice, a trained model or all windows of all texts are beyond SQL: those queries are
#: tested against brute force.
ORACLES = {
    "op4_near_dedup": near_dedup.ORACLE,
    "op5_secrets": secrets.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
