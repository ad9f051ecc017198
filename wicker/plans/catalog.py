"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wicker.operators import packed_values, unit_convert
from wicker.plans import basket_queries, evaluation_queries, graph_queries, stream_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "answer_items"
#: name -> (query, SQL or None where SQL can't say it)
REGISTERED: dict[str, tuple[Query, str | None]] = {
    "p1_found": (packed_values.found, None),
    "p3_found": (unit_convert.found, None),
    **basket_queries.QUERIES,
    **text_queries.QUERIES,
    **graph_queries.QUERIES,
    **evaluation_queries.QUERIES,
    **stream_queries.QUERIES,
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
