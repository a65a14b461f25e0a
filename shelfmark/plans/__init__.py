from shelfmark.plans import catalog_queries, note_queries, search_queries, text_queries
from shelfmark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalog_queries", "note_queries", "search_queries", "text_queries"]
