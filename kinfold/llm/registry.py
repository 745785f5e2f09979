"""Queries and SQL of the training-data operators."""

from kinfold.llm import lines, media, minhash, packing, pieces, quality, suffixes, tokencounts, toxicity, warc

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_suffix_array_dedup": suffixes.op4_suffix_array_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_token_counts": tokencounts.op6_token_counts,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_media_columns": media.op8_media_columns,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_warc": warc.op10_warc,
}
ORACLES = {"op2_minhash_near_dedup": minhash.OP2_SQL, "op5_quality_rules": quality.OP5_SQL, "op10_warc": warc.OP10_SQL}
