"""Corpus and event-log analytics as PySpark DataFrame jobs."""

from scrollwork.session import cut_lineage, get_session

__all__ = ["cut_lineage", "get_session"]
