"""All queries of the review engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausemill.plans import bindings as B

#: Queries whose SQL has their name in capitals.
NAMES = (
    "lines_offsets", "numbered_lines", "heading_levels", "section_paths", "fold_normalize", "param_cards", "param_discarded", "param_guards", "lines_scanned", "text_param_first", "cards_unpivot",
    "rule_skipped", "findings_summary", "verdict_counts", "missing_params", "findings_order", "tokens_tf", "cjk_bigrams", "cosine_topk", "threshold_match", "ask_route", "search_order", "embedding_cosine",
    "pii_hits", "pii_by_kind", "pii_conversations", "crlf_docs", "commit_hits", "gap_candidates", "gap_validate", "gap_cards", "gap_prompts", "eval_prf", "eval_close", "detection_rate", "false_positives",
    "corpus_prf", "corpus_detection", "corpus_false_positives", "inventory_by_category", "json_value_variant", "log_resume", "rule_inventory", "rule_violations", "rule_enabled", "rule_overdue",
)
CHECKS = {
    "rule_required": (("E-REQ",), B.RULE_REQUIRED),
    "rule_threshold": (("E-MAX", "E-MIN"), B.RULE_THRESHOLD),
    "rule_range": (("E-RNG",), B.RULE_RANGE),
    "rule_enum": (("E-ENUM",), B.RULE_ENUM),
    "rule_conditional": (("E-COND",), B.RULE_CONDITIONAL),
    "rule_checklist": (("E-CHK",), B.RULE_CHECKLIST),
}
QUERIES = {n: getattr(B, n) for n in NAMES} | {n: B.rule_query(*ids) for n, (ids, _) in CHECKS.items()}
SQL = {n: getattr(B, n.upper()) for n in NAMES} | {n: sql for n, (_, sql) in CHECKS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all orders against all rules: findings of every check type."""
    return B.rule_query()(spark, sf_dir)
