"""Query registry: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.operators import (backoff, chat, distill, grading, haystack, inference, lm, losses, lowrank, metrics,
                             nearest, packing, permute, quant, resumable, splits, student, tokens)
from quire.sources import files
from quire.streaming import grader

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    # M0 — grading and scores
    "grade_responses": grading.grade_responses,
    "suite_score": grading.suite_score,
    "failure_report": grading.failure_report,
    "rule_catalog": grading.rule_catalog,
    # M1 — scoreboard
    "word_counts": metrics.word_counts,
    "token_fallback": metrics.token_fallback,
    "speed_mean_of_rates": metrics.speed_mean_of_rates,
    "speed_ratio_of_sums": metrics.speed_ratio_of_sums,
    "head_to_head": metrics.head_to_head,
    "common_suites": metrics.common_suites,
    "resolve_model": metrics.resolve_model,
    "summary_pivot": metrics.summary_pivot,
    "run_delta": metrics.run_delta,
    "response_preview": metrics.response_preview,
    "quality_samples": metrics.quality_samples,
    "side_by_side": inference.side_by_side,
    "suite_filter": metrics.suite_filter,
    "model_filter": metrics.model_filter,
    "result_json": metrics.result_json,
    "result_json_filtered": metrics.result_json_filtered,
    # M2 — data production
    "chat_prompt": chat.chat_prompt,
    "chat_example": chat.chat_example,
    "chat_conversation": chat.chat_conversation,
    "strip_think": chat.strip_think,
    "temperature_plan": chat.temperature_plan,
    "progress_index": splits.progress_index,
    "seeded_shuffle": splits.seeded_shuffle,
    "group_split": splits.group_split,
    "ordered_split": splits.ordered_split,
    "split_counts": splits.split_counts,
    "split_leakage": splits.split_leakage,
    "batch_plan": splits.batch_plan,
    "permuted_batch_plan": permute.permuted_batch_plan,
    "jsonl_roundtrip": files.jsonl_roundtrip,
    "materialize_if_absent": files.materialize_if_absent,
    "present_sources": files.present_sources,
    "storage_footprint": files.storage_footprint,
    # M3 — tokens and language models
    "token_windows": tokens.token_windows,
    "next_token_pairs": tokens.next_token_pairs,
    "unigram_perplexity": lm.unigram_perplexity,
    "bigram_perplexity": lm.bigram_perplexity,
    "perplexity_by_group": lm.perplexity_by_group,
    "temperature_distribution": lm.temperature_distribution,
    "temperature_probabilities": lm.temperature_probabilities,
    "nucleus_filter": lm.nucleus_filter,
    "greedy_next": lm.greedy_next,
    "kl_unigram": lm.kl_unigram,
    "heldout_text_perplexity": lm.heldout_text_perplexity,
    "heldout_perplexity": lm.heldout_perplexity,
    "backoff_perplexity": backoff.backoff_perplexity,
    # M4 — losses
    "softmax_rows": losses.softmax_rows,
    "ce_logits": losses.ce_logits,
    "kl_logits": losses.kl_logits,
    "blended_loss": losses.blended_loss,
    # M5 — needles
    "filler_sample": haystack.filler_sample,
    "haystack_build": haystack.haystack_build,
    "haystack_text": haystack.haystack_text,
    "needle_find": haystack.needle_find,
    "needle_score": haystack.needle_score,
    # M6 — vectors
    "precision_policy": quant.precision_policy,
    "quantize_groupwise": quant.quantize_groupwise,
    "quant_error_by_bits": quant.quant_error_by_bits,
    "quantize_mixed": quant.quantize_mixed,
    "quantize_nf4": quant.quantize_nf4,
    "topk_fidelity": quant.topk_fidelity,
    "neighbour_recall": nearest.neighbour_recall,
    "neighbour_recall_lists": nearest.neighbour_recall_lists,
    "footprint_by_bits": quant.footprint_by_bits,
    "pack_codes": packing.pack_codes,
    "unpack_codes": packing.unpack_codes,
    "packed_footprint": packing.packed_footprint,
    "lowrank_correction": quant.lowrank_correction,
    "lowrank_factors": lowrank.lowrank_factors,
    "lowrank_checks": lowrank.lowrank_checks,
    # M7 — models
    "batch_generate": inference.batch_generate,
    "resumed_generate": resumable.resumed_generate,
    "generated_scores": inference.generated_scores,
    "context_scores": inference.context_scores,
    "run_summary": inference.run_summary,
    "distill_student": distill.distill_student,
    "param_sweep": distill.param_sweep,
    "valid_loss": distill.valid_loss,
    "train_student": student.train_student,
    "student_gradient": student.student_gradient,
    # streaming form of the grader
    "stream_suite_score": grader.stream_suite_score,
}

# Queries whose result is checked by row count only (file sizes, numpy kernels).
ROWS_ONLY: set[str] = {"storage_footprint", "lowrank_correction", "lowrank_factors"}
