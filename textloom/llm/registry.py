"""The queries of this subpackage, by the names under which they are registered."""

from . import html_text, langid, line_dedup, media, packing, pieces, quality, simhash, substring_dedup, token_counts, topk, variants, vector_codes

QUERIES = {
    "op1_exact_topk": topk.query,
    "op2_sentencepiece": pieces.query,
    "op3_quality_classifier": quality.query,
    "op4_best_fit_packing": packing.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_media_columns": media.query,
    "op7_token_counts": token_counts.query,
    "op8_language_id": langid.query,
    "op9_simhash_near_dedup": simhash.query,
    "op10_line_dedup": line_dedup.query,
    "op11_vector_codes": vector_codes.query,
    "op12_html_extraction": html_text.query,
    "op13_spelling_variants": variants.query,
}

ORACLES = {
    "op1_exact_topk": topk.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
}
