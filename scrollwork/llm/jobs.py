"""All registered queries of this folder."""

from scrollwork.llm import collocations, conversations, decontaminate, exact_dedup, id_shards, language_id, line_dedup, lm_score, near_dedup, packing, quality, substring_dedup, warc  # noqa: F401
from scrollwork.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
