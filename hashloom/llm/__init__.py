"""Operators of a training-data pipeline.  Nothing else in the library imports this package."""

from hashloom.llm import (
    chat,
    contamination,
    exact,
    fill_middle,
    html_text,
    language_model,
    near,
    packing,
    periodic,
    pii,
    quality,
    sharding,
    substring,
)
from hashloom.llm.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "chat",
    "contamination",
    "exact",
    "fill_middle",
    "html_text",
    "language_model",
    "near",
    "packing",
    "periodic",
    "pii",
    "quality",
    "sharding",
    "substring",
]
