"""Queries and SQL of this subpackage."""

from __future__ import annotations

from orbweave.llm import collocations, conversation_repair, decontaminate, exact_dedup, hmm_lm, html_extract, jaccard_join, license_scan, packing, piece_sampling, token_files, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_token_files": token_files.op3_token_files,
        "op4_piece_sampling": piece_sampling.op4_piece_sampling,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_hmm_scores": hmm_lm.op8_hmm_scores,
        "op9_html_extraction": html_extract.op9_html_extraction,
        "op10_ngram_jaccard": jaccard_join.op10_ngram_jaccard,
        "op11_collocations": collocations.op11_collocations,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_packing": packing.op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.SQL, "op7_url_filter": url_filter.SQL, "op11_collocations": collocations.SQL, "op12_conversation_repair": conversation_repair.SQL}
