"""All queries of this package."""

from textquarry.llm import chat_format, decontamination, exact_dedup, html_extraction, jaccard_join, language_id, line_dedup, lm_scoring, nearest_neighbours, packing, ranked_search, secret_scan, vector_codes  # noqa: F401
from textquarry.llm.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
