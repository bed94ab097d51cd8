"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from strataloom.llm import decontaminate, exact_dedup, langid, license_scan, lm_score, ngram_join, pii, secrets, sentencepiece_codec, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_ngram_jaccard": ngram_join.op4_ngram_jaccard,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_language_id": langid.op6_language_id,
    "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
    "op8_pii_surrogates": pii.op8_pii_surrogates,
    "op9_lm_score": lm_score.op9_lm_score,
    "op10_secret_scan": secrets.op10_secret_scan,
}
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op4_ngram_jaccard": ngram_join.SQL,
}
