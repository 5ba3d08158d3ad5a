"""Operators for large training-data pipelines: extraction, packing, PII, deduplication,
quality scoring, chat rendering, secret scanning, decontamination, hard negatives, alignment of
tokenizers and web archives.

Nothing outside this subpackage imports it.
"""
