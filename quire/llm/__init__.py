"""Operators of a training-data pipeline: sharding, licences, decontamination, PII,
token counts, toxicity, similarity joins, byte-level BPE, quality rules, substring dedup.

``quire.llm.registry`` names their queries; nothing outside this subpackage
(but ``corpus_pipeline.py`` and the guarded import of ``__spark_entry__.py``) uses it.
"""
