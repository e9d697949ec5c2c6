"""Queries by name; importing this package registers them."""

from . import event_queries, model_queries, report_queries, star, text_queries  # noqa: F401
