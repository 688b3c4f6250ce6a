"""Importing this module registers every query."""

from verification import (  # noqa: F401
    alert_queries,
    behaviour_queries,
    core_queries,
    evaluation_queries,
    model_queries,
    scalar_queries,
    source_queries,
    stream_queries,
    window_queries,
)
from verification.registry import ORACLE, QUERIES  # noqa: F401
