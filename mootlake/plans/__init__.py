"""Queries over the given tables; importing this package registers them."""

from . import (item_queries, pulse_queries, record_queries, state_queries, stream_queries,
               transcript_queries)  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
