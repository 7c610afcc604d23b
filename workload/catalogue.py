"""All registered queries."""

from workload import catalog_queries, dialogue_queries, extract_queries, search_queries, section_queries, text_queries  # noqa: F401
from workload.kit import ORACLES, QUERIES  # noqa: F401
