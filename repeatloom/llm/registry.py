"""Queries and SQL of this subpackage."""

from repeatloom.llm import bpe, dedup, jaccard, language, media, packing, secretscan, sharding, tokencount, toxicity

QUERIES = {
    "op1_bpe_codec": bpe.query,
    "op2_minimax_shards": sharding.query,
    "op3_language_id": language.query,
    "op4_secret_scan": secretscan.query,
    "op5_exact_dedup": dedup.query,
    "op6_ngram_jaccard": jaccard.query,
    "op7_toxicity": toxicity.query,
    "op8_token_counts": tokencount.query,
    "op9_best_fit_packing": packing.query,
    "op10_media_columns": media.query,
}
ORACLES: dict[str, str] = {"op5_exact_dedup": dedup.SQL}
