"""Queries and SQL of the operators of this subpackage, for the driver."""

from __future__ import annotations

from scribe.llm import exact_dedup, language, licenses, packing, pieces, secrets, simhash, substrings, syncmers, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_language_id": language.op5_language_id,
    "op6_closed_syncmers": syncmers.op6_closed_syncmers,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_packing": packing.op9_packing,
    "op10_secret_scan": secrets.op10_secret_scan,
}
#: What plain SQL can say of them; the others are tested against brute force.
ORACLES = {"op3_exact_dedup": exact_dedup.ORACLE}
