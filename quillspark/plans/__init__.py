"""Every operator as a query over whole tables, and the SQL that gives the same rows."""

from . import evaluation, indexing, ingest, retrieval, statutes, texts
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "evaluation", "indexing", "ingest", "retrieval", "statutes", "texts"]
