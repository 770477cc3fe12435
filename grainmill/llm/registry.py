"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from grainmill.llm import fingerprint, html_text, jaccard, language_id, mixing, search, token_counts, token_files, unigram, url_filter


def queries() -> dict:
    return {
        "op1_sentencepiece": unigram.op1_sentencepiece,
        "op2_top_k_search": search.op2_top_k_search,
        "op3_html_text": html_text.op3_html_text,
        "op4_url_filters": url_filter.op4_url_filters,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_language_id": language_id.op6_language_id,
        "op7_jaccard_join": jaccard.op7_jaccard_join,
        "op8_mixing": mixing.op8_mixing,
        "op10_fingerprints": fingerprint.op10_fingerprints,
        "op9_token_files": token_files.op9_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": url_filter.OP4_SQL}
