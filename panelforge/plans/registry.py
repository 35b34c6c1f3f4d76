"""Every registered query with its DuckDB twin."""

from . import io_queries, model_queries, panel_queries, spatial_queries, stats_queries  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
