"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import account_queries, document_queries, page_queries, record_queries, scan_queries, search_queries, stream_queries, text_queries, value_queries

_ALL = (text_queries, record_queries, value_queries, stream_queries, account_queries, document_queries, page_queries, search_queries, scan_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _ALL for k, q in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _ALL for k, s in m.SQL.items()}
