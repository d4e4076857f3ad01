"""All registered jobs."""

from scrollwork.plans import (  # noqa: F401
    audit_jobs, corpus_jobs, index_jobs, log_jobs, mechanics_jobs, retrieval_jobs, segment_jobs, source_jobs, stream_jobs, view_jobs,
)
from scrollwork.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
