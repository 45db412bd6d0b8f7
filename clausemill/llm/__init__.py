"""Operators for large text corpora: licence scans, toxicity, quality, language, near and exact duplicates, PII, mixing, decontamination and language-model scoring."""
