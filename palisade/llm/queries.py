"""The registered queries of this subpackage: opN_<name>, and the pipeline."""

from __future__ import annotations

from . import byte_bpe, decontamination, embedding_dedup, hard_negatives, katz, license_scan, line_dedup, ngram_join, oracles, packing, phrases, quality, substring_dedup, token_counts


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.query,
        "op2_ngram_jaccard_join": ngram_join.query,
        "op3_embedding_near_dedup": embedding_dedup.query,
        "op4_katz_scoring": katz.query,
        "op5_substring_dedup": substring_dedup.query,
        "op6_vector_bin_packing": packing.query,
        "op7_license_scans": license_scan.query,
        "op8_token_counts": token_counts.query,
        "op9_quality_classifier": quality.query,
        "op10_benchmark_decontamination": decontamination.query,
        "op11_byte_bpe": byte_bpe.query,
        "op12_hard_negatives": hard_negatives.query,
        "op13_phrase_mining": phrases.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": oracles.NEAR_DUPLICATES,
        "op3_embedding_near_dedup": oracles.EMBEDDINGS,
        "op5_substring_dedup": oracles.REPEATS,
        "op12_hard_negatives": oracles.HARD_NEGATIVES,
        "op13_phrase_mining": oracles.PHRASES,
    }
