"""Imports the modules that register queries."""

from . import corpus_queries, metric_queries, model_queries, record_queries, storage_queries, text_queries  # noqa: F401
