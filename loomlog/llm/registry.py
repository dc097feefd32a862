"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from loomlog.llm import align, backoff, decontaminate, line_dedup, mixing, quality, resample, secrets, sharding, simhash, span_dedup, suffixes, toxicity


def queries() -> dict:
    from corpus_pipeline import run

    return {
        "op1_stupid_backoff": backoff.op1_stupid_backoff,
        "op2_simhash_dedup": simhash.op2_simhash_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_span_dedup": span_dedup.op4_span_dedup,
        "op5_suffix_dedup": suffixes.op5_suffix_dedup,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_interleaved_shards": sharding.op11_interleaved_shards,
        "op12_target_resample": resample.op12_target_resample,
        "op13_token_alignment": align.op13_token_alignment,
        "pipeline": run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_stupid_backoff": backoff.OP1_SQL,
        "op4_span_dedup": span_dedup.OP4_SQL,
        "op5_suffix_dedup": suffixes.OP5_SQL,
        "op7_decontaminate": decontaminate.OP7_SQL,
        "op10_line_dedup": line_dedup.OP10_SQL,
        "op11_interleaved_shards": sharding.OP11_SQL,
        "op12_target_resample": resample.OP12_SQL,
    }
