"""Queries of this folder, and SQL where it can express them."""

from __future__ import annotations

from . import alignment, decontaminate, line_dedup, media, mixing, near_duplicates, periodic, pseudonyms, quality_model, quality_rules, secrets, sentencepiece, sharding, sql


def queries() -> dict:
    return {
        "op1_interleaved_media": media.op1_interleaved_media,
        "op2_jaccard_join": near_duplicates.op2_jaccard_join,
        "op3_feistel_pseudonyms": pseudonyms.op3_feistel_pseudonyms,
        "op4_format_automata": secrets.op4_format_automata,
        "op5_cube_mix": mixing.op5_cube_mix,
        "op6_zstd_quality": quality_model.op6_zstd_quality,
        "op7_sentencepiece": sentencepiece.op7_sentencepiece,
        "op8_crf_lines": quality_rules.op8_crf_lines,
        "op9_shard_tree": sharding.op9_shard_tree,
        "op10_template_tree": line_dedup.op10_template_tree,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_benchmark_windows": decontaminate.op13_benchmark_windows,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": sql.JACCARD_JOIN, "op9_shard_tree": sql.SHARD_TREE, "op13_benchmark_windows": sql.BENCHMARK_WINDOWS}
