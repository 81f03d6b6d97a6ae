"""All registered queries of the library proper."""

from . import adaptive_queries, bar_queries, extra_queries, ingest_queries, label_queries, market_queries, matrix_queries, micro_queries, model_queries, view_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
