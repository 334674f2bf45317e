"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import graph, text  # noqa: F401

QUERIES = graph.Q
ORACLES = graph.SQL
